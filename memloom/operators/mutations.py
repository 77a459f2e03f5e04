"""Changes as rewrites: each takes the tables and a table of wishes, and gives the tables after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """An id that is there already is an error."""
    taken = new.select("id").join(rows.select("id"), "id", "left_semi").agg(F.min("id").alias("_taken"))  # one row; ids alone are shuffled
    ok = F.when(F.col("_taken").isNotNull(), F.raise_error(F.concat(F.lit("id is taken: "), F.col("_taken").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.unionByName(new.crossJoin(F.broadcast(taken)).where(ok).drop("_taken"))


def update(rows: DataFrame, patches: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """patches: id, and a column for each of ``columns``; null keeps what was. Metadata is replaced whole."""
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(p, "id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def delete(rows: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows go, and every edge that touches them."""
    gone = ids.select("id").distinct()
    left = edges
    for side in ("from_id", "to_id"):
        left = left.join(gone.withColumnRenamed("id", side), side, "left_anti")
    return rows.join(gone, "id", "left_anti"), left.select(*edges.columns)


def reset(rows: DataFrame, user_id: str | None = None, agent_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left, and the number that went; a reset without a scope takes everything."""
    hit = F.lit(True)
    for name, value in (("user_id", user_id), ("agent_id", agent_id)):
        if value is not None:
            hit = hit & F.coalesce(F.col(name) == value, F.lit(False))
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("n"))


def touch(rows: DataFrame, log: DataFrame) -> DataFrame:
    """log: id, at, a row for each time that a memory was shown. Counts add up, the last time stays."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    return rows.join(seen, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("accessed_at", F.coalesce("_at", F.lit(None).cast("double"))).drop("_n", "_at")


def route(new: DataFrame, decisions: DataFrame, candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """new: new_id, trust; decisions: new_id, kind, target_id; candidates: new_id, id that were offered. What each new fact comes to.

    An update or delete counts only for a target that was offered and whose trust isn't above the new fact's; else the
    fact is added.
    """
    offered = candidates.select("new_id", F.col("id").alias("target_id"), F.lit(True).alias("offered"))
    target = memories.select(F.col("id").alias("target_id"), F.col("trust").alias("target_trust"))
    d = new.join(decisions, "new_id", "left").join(offered, ["new_id", "target_id"], "left").join(target, "target_id", "left")
    wants = F.col("kind").isin("UPDATE", "DELETE")
    allowed = F.coalesce("offered", F.lit(False)) & (F.coalesce("trust", F.lit(3)) >= F.coalesce("target_trust", F.lit(3)))
    action = F.when(F.col("kind") == "NONE", "NONE").when(wants & allowed, F.col("kind")).otherwise("ADD")
    return d.select("new_id", action.alias("action"), F.when(action.isin("UPDATE", "DELETE"), F.col("target_id")).alias("target_id"))


def resolved(rows: DataFrame, new: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows: id, content, trust; new: new_id, content, trust; the others as for ``route``. The rows after the new facts: additions under their own ids, updates in place, deletions gone.

    Of several facts that go to one row, a deletion wins, then the update of the largest id.
    """
    routed = route(new.select("new_id", "trust"), decisions, candidates, rows).join(new.select("new_id", "content", F.col("trust").alias("new_trust")), "new_id")
    added = routed.where("action = 'ADD'").select(F.col("new_id").alias("id"), "content", F.col("new_trust").alias("trust"))
    hits = routed.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.bool_or(F.col("action") == "DELETE").alias("_gone"), F.max_by("content", "new_id").alias("_content"))
    kept = rows.join(hits, "id", "left").where(~F.coalesce("_gone", F.lit(False))).select("id", F.coalesce("_content", "content").alias("content"), "trust")
    return kept.unionByName(added)


def block_append(blocks: DataFrame, additions: DataFrame, cap: int = 2000) -> DataFrame:
    """blocks: name, text; additions: name, added. A line more for each, unless the block would be too long (then it stays and says so)."""
    out = blocks.join(additions, "name", "left")
    longer = F.when(F.col("text") == "", F.col("added")).otherwise(F.concat("text", F.lit("\n"), "added"))
    fits = F.length(longer) <= cap
    return out.select("name", F.when(F.col("added").isNotNull() & fits, longer).otherwise(F.col("text")).alias("text"), (F.col("added").isNotNull() & ~fits).alias("refused"))


def block_replace(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: name, old, new. The first place only."""
    out = blocks.join(edits, "name", "left")
    at = F.position("old", "text")
    new = F.concat(F.substr("text", F.lit(1), at - 1), F.col("new"), F.substr("text", at + F.length("old")))
    return out.select("name", F.when(F.col("old").isNotNull() & (F.col("old") != "") & (at > 0), new).otherwise(F.col("text")).alias("text"))
