"""Models as callables: what embeds, answers, judges, reranks or summarises is handed in and runs on the executors.

A model is made once for each task by a factory without arguments, so that a client or weights aren't shipped with the
plan. It works on lists: ``embed`` gets texts and gives vectors, ``respond`` gets prompts and gives answers. A call that
fails for a passing reason is tried again, each time after a longer wait; anything else ends the task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evals, retrieval
from ..session import ship

#: Texts of one call.
CHUNK = 2048
#: Failures that pass: a name or a message with one of these.
PASSING = ("timeout", "ratelimit", "rate limit", "connection", "temporar", "429", "502", "503", "504")


def retried(call: Callable[[list], list], items: list, attempts: int = 5, wait: float = 1.0, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list:
    for n in range(attempts):
        try:
            return call(items)
        except Exception as e:  # noqa: BLE001  (what passes is told by its words)
            said = f"{type(e).__name__} {e}".lower()
            if n == attempts - 1 or not any(x in said for x in PASSING):
                raise
            sleep(min(most_wait, wait * 2**n))
    return []


def _calls(model: Callable[[list], list], items: list, **how) -> list:
    out: list = []
    for lo in range(0, len(items), CHUNK):
        part = items[lo : lo + CHUNK]
        made = list(retried(model, part, **how))
        if len(made) != len(part):
            raise ValueError(f"{len(made)} results for {len(part)} inputs")
        out += made
    return out


def embed(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list]], column: str = "content", **how) -> DataFrame:
    """``rows`` with ``embedding`` (floats). Null and empty texts get the zero vector without a call; if a batch has no other text, an empty one."""
    ship(rows.sparkSession)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            asked = [t for t in texts if t]
            made = [np.asarray(v, dtype=np.float32) for v in _calls(model, asked, **how)]
            zero = np.zeros(len(made[0]) if made else 0, dtype=np.float32)
            found = iter(made)
            yield batch.append_column("embedding", pa.array([next(found) if t else zero for t in texts], type=pa.list_(pa.float32())))

    return rows.mapInArrow(run, _with(rows, "embedding array<float>"))


def respond(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list]], prompt: str = "prompt", name: str = "response", **how) -> DataFrame:
    """``rows`` with a model's answer to each prompt, as text; a null prompt has none."""
    ship(rows.sparkSession)
    at = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            prompts = batch.column(at).to_pylist()
            found = iter(_calls(model, [p for p in prompts if p is not None], **how))
            yield batch.append_column(name, pa.array([None if p is None else str(next(found)) for p in prompts], type=pa.string()))

    return rows.mapInArrow(run, _with(rows, f"{name} string"))


def _with(rows: DataFrame, column: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*rows.schema.fields, *_parse_datatype_string(column).fields])


def judged(rows: DataFrame, factory: Callable, **how) -> DataFrame:
    """rows: question, gold, answer and others. Adds label and score by a judge's answers; what the answer declines scores as incorrect without a call."""
    prompt = F.concat(F.lit("Question: "), "question", F.lit("\nGold: "), "gold", F.lit("\nAnswer: "), "answer", F.lit("\nLabel:"))
    said = respond(rows.withColumn("_prompt", F.when(~T.abstains(F.col("answer")), prompt)), factory, "_prompt", "_verdict", **how)
    label = F.when(F.col("_verdict").isNull(), "INCORRECT").otherwise(T.judge_label_lines(F.col("_verdict")))
    return said.withColumn("label", label).withColumn("score", T.judge_score(F.col("label"))).drop("_prompt", "_verdict")


def reranked(candidates: DataFrame, factory: Callable, k: int, **how) -> DataFrame:
    """candidates: query_id, text, id, rank, content. The order by a cross-encoder's scores (a call gets pairs of query and content), fused with the order that was."""
    pairs = candidates.withColumn("_pair", F.concat(F.col("text"), F.lit("\x1f"), F.col("content")))
    scored = respond(pairs, lambda: _paired(factory()), "_pair", "_score", **how).withColumn("rerank_score", F.col("_score").cast("double"))
    return retrieval.rerank(scored.select("query_id", "id", "rank", "rerank_score"), k)


def _paired(model: Callable[[list[tuple[str, str]]], list]) -> Callable[[list[str]], list]:
    return lambda items: model([tuple(x.split("\x1f", 1)) for x in items])


def compared(questions: DataFrame, systems: dict[str, Callable[[DataFrame], DataFrame]], judge: Callable, **how) -> DataFrame:
    """questions: question_id, question, gold, category. Each system answers every question (question_id, answer); one judge labels them all. question_id, config (the system's name), category, label, score, ready for ``evals``."""
    out = None
    for name, answers in systems.items():
        part = questions.join(answers(questions), "question_id").withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return judged(out, judge, **how).select("question_id", "config", "category", "label", "score")


def compared_systems(results: DataFrame) -> DataFrame:
    """The headline of each system, and its mean over all."""
    return evals.headline(results).join(results.groupBy("config").agg(F.round(F.avg("score"), 6).alias("mean_score")), "config")
