"""What a service asks before it answers: guards on requests, a cache of answers, tool calls, and a chat's history, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bytes of a request.
MOST_BYTES = 1 << 20
# The tools of an agent, and the arguments that each must have.
TOOLS = {"core_append": ("label", "content"), "core_replace": ("label", "old", "new"), "archival_insert": ("content",), "archival_search": ("query",), "archival_delete": ("memory_id",), "synthesize_memories": ("parent_ids",)}


def guarded(requests: DataFrame, require_scope: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """requests: user_id, agent_id, op, n_bytes, confirm. Adds ``refused``: the first reason that a request is turned away for, or null.

    A request that is too large; one without an owner where one is required; a reset of everything that isn't confirmed.
    """
    blank = lambda c: F.coalesce(T.stripped(F.col(c)), F.lit("")) == ""
    nobody = blank("user_id") & blank("agent_id")
    reason = F.when(F.coalesce("n_bytes", F.lit(0)) > most_bytes, "too large")
    if require_scope:
        reason = reason.when(nobody & (F.col("op") != "reset"), "no scope")
    reason = reason.when(nobody & (F.col("op") == "reset") & ~F.coalesce("confirm", F.lit(False)), "not confirmed")
    return requests.withColumn("refused", reason)


def cache_key(epoch) -> F.Column:
    """Of a search: query, owner, limit, parents, mode, and the epoch of what it reads. Nulls differ from any text."""
    return F.sha2(F.to_json(F.array(*[F.to_json(F.struct(c.alias("v"))) for c in (T.norm(F.col("text")), F.col("user_id"), F.col("agent_id"), F.col("limit").cast("string"), F.col("filter_parents").cast("string"), F.col("mode"), epoch.cast("string"))])), 256)


def cached(searches: DataFrame, writes: DataFrame) -> DataFrame:
    """searches: seq, at, text, user_id, agent_id, limit, filter_parents, mode; writes: user_id, agent_id, at. Adds ``hit``: whether an earlier search asked the same of the same state.

    A search with an owner reads that owner's state, one without reads all. The state of an owner is the number of writes
    to it before; two searches see the same state exactly if no such write lies between them.
    """
    scoped = F.col("user_id").isNotNull() | F.col("agent_id").isNotNull()
    marks = searches.select("seq", "at", "user_id", "agent_id", F.lit(0).alias("write")).where(scoped)
    steps = writes.select(F.lit(None).cast("bigint").alias("seq"), "at", "user_id", "agent_id", F.lit(1).alias("write"))
    count = F.sum("write").over(Window.partitionBy("user_id", "agent_id").orderBy("at", F.desc("write"), "seq").rowsBetween(Window.unboundedPreceding, 0))
    own = marks.unionByName(steps).withColumn("epoch", count).where("write = 0").select("seq", "epoch")
    # all writes in buckets of time: the count before a bucket, and the count within it
    bucket = F.floor(F.col("at") / 3600)
    loose = searches.where(~scoped).select("seq", "at", F.lit(0).alias("write")).unionByName(writes.select(F.lit(None).cast("bigint").alias("seq"), "at", F.lit(1).alias("write"))).withColumn("b", bucket)
    before = loose.groupBy("b").agg(F.sum("write").alias("w")).withColumn("base", F.coalesce(F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "base")
    inside = F.sum("write").over(Window.partitionBy("b").orderBy("at", F.desc("write"), "seq").rowsBetween(Window.unboundedPreceding, 0))
    every = loose.withColumn("n", inside).where("write = 0").join(before, "b").select("seq", (F.col("n") + F.col("base")).alias("epoch"))
    keyed = searches.join(own.unionByName(every), "seq").withColumn("key", cache_key(F.col("epoch")))
    return keyed.withColumn("hit", F.row_number().over(Window.partitionBy("key").orderBy("at", "seq")) > 1)


def tool_calls(calls: DataFrame) -> DataFrame:
    """calls: call_id, name, arguments (JSON text). Adds ``error``: the first thing wrong with a call (an unknown tool, arguments that are no JSON object, one that is missing), or null."""
    keys = F.json_object_keys("arguments")
    error = F.when(~F.col("name").isin(*TOOLS), F.concat(F.lit("unknown tool "), "name")).when(keys.isNull(), "arguments are no object")
    for name, needed in TOOLS.items():
        for k in needed:
            error = error.when((F.col("name") == name) & ~F.array_contains(keys, k), f"{k} is missing")
    return calls.withColumn("error", error)


def chat_history(memories: DataFrame, by: str = "user_id") -> DataFrame:
    """memories: created_at, ord, metadata with a role, content. Each owner's messages in the order they were said: place 1.. , role (human without one), content."""
    role = F.coalesce(F.get_json_object("metadata", "$.role"), F.lit("human"))
    return memories.select(by, F.row_number().over(Window.partitionBy(by).orderBy("created_at", "ord")).alias("place"), role.alias("role"), "content")
