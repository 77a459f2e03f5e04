"""The engine's tables over the star-schema test data: every derived column is integer arithmetic on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RELATIONS = ("next", "supports", "contradicts", "refines", "related")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.unix_date(ts.cast("date")) * F.lit(86400.0) + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, embedding, user_id, agent_id, created_at, access_count, trust, parents, ord."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    i = F.col("doc_id")
    return docs.join(vecs.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(
        i.alias("id"), F.col("text").alias("content"), "embedding", F.col("source").alias("user_id"), F.col("lang").alias("agent_id"), (i * F.lit(86400.0)).alias("created_at"),
        (i % 7).cast("int").alias("access_count"), (i % 5).cast("int").alias("trust"), F.when(i % 10 == 9, F.array(i - 1, i - 2)).otherwise(F.array().cast("array<bigint>")).alias("parents"), i.alias("ord"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories without vectors: one row for each document."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("text").alias("content"), F.col("source").alias("user_id"), F.col("lang").alias("agent_id"), (i * F.lit(86400.0)).alias("created_at"),
        (i % 7).cast("int").alias("access_count"), (i % 5).cast("int").alias("trust"), F.when(i % 10 == 9, F.array(i - 1, i - 2)).otherwise(F.array().cast("array<bigint>")).alias("parents"), i.alias("ord"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding: the benchmark items."""
    items, vecs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return items.join(vecs.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_id, fact_type, value, valid_from, believed_by, source_memory_id, seq (arrival, out of order)."""
    return facts_of(table(spark, sf_dir, "events"))


def facts_of(events: DataFrame) -> DataFrame:
    """The facts of a table or a stream of events."""
    e = F.col("event_id")
    return events.select(
        e.alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("fact_type"), F.format_string("%.2f", "value").alias("value"), epoch(F.col("ts")).alias("valid_from"),
        F.when(e % 3 != 0, (e % 3).cast("string")).alias("believed_by"), (e % 1000).alias("source_memory_id"), (e * 7919 % 1000003).alias("seq"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory to the next id, with a relation by its id; ids ascend without gaps in the data's tables or the edge dangles."""
    i = F.col("doc_id")
    relation = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("id"), i.alias("from_id"), (i + 1).alias("to_id"), relation.alias("relation"), ((i % 10) / F.lit(10.0)).alias("weight"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, user_id, entity: capitalised names in the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("memory_id"), F.col("source").alias("user_id"), F.explode(T.capital_spans(F.col("text"))).alias("entity"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, category, a_correct, b_correct: two systems on the same questions."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang"), "doc_id").select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), (F.col("quality") == 1).cast("int").alias("a_correct"), (F.col("toxic") == 0).cast("int").alias("b_correct"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An op log over the documents: add each; update some with a new owner, later delete some; edges added and some deleted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    base = {"op": none, "id": i, "content": none, "user_id": none, "from_id": F.lit(None).cast("bigint"), "to_id": F.lit(None).cast("bigint"), "relation": none, "seq": i}

    def ops(rows: DataFrame, **own: Column) -> DataFrame:
        return rows.select(*[c.alias(k) for k, c in (base | own).items()])

    parts = [
        ops(d, op=F.lit("add"), content=F.col("text"), user_id=F.col("source"), seq=i * 10 + 1),
        ops(d.where("doc_id % 4 = 1"), op=F.lit("update"), user_id=F.col("lang"), seq=i * 10 + 23),
        ops(d.where("doc_id % 6 = 1"), op=F.lit("update"), content=F.lower("text"), seq=i * 10 + 45),
        ops(d.where("doc_id % 9 = 0"), op=F.lit("delete"), seq=i * 10 + 67),
        ops(d, op=F.lit("add_edge"), id=i + 1000000000, from_id=i, to_id=i + 1, relation=F.lit("next"), seq=i * 10 + 34),
        ops(d.where("doc_id % 7 = 0"), op=F.lit("delete_edge"), id=i + 1000000000, seq=i * 10 + 56),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
