"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import bpe, common, decontaminate, ftrl, linededup, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labelled documents of this stage's input."""
    return ftrl.keep_quality(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line blocks that an earlier document has go from the later one; documents left without text go."""
    return linededup.without_common_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with the digests of the round trip."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("benchmark_decontamination", decontaminate_stage), ("byte_level_bpe", encode_stage)]
#: Learning, alignment and tokenizing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; what lies between is written below the session's shared checkpoint folder, and removed when the next stage is written."""
    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{n}-{name}")
        docs = spark.read.parquet(out)
        if before:  # no later stage reads it
            common.remove(spark, before)
        before = out
    return docs
