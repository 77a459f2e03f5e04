"""Fitness, consolidation, recombination and summary trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpointed
from .scan import episodic

DAY = 86400.0


def centroid(rows: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group. Sums are partial in every task; nothing is gathered but one number for each place."""
    each = rows.select(by, F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def fitness(rows: DataFrame, now: float, half_life_days: float = 30.0, by: str = "user_id", places: int = 6) -> DataFrame:
    """ln(uses + 1) by age, and a tenth of the cosine to the scope's centroid where that is positive."""
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("created_at")) / DAY)
    recency = F.exp(-age / half_life_days) if half_life_days > 0 else F.lit(1.0)
    near = F.greatest(F.lit(0.0), V.cosine(F.col("embedding"), F.col("centroid")))
    return rows.join(centroid(rows, by), by).withColumn("fitness", F.round(F.log(F.col("access_count") + 1.0) * recency + 0.1 * near, places)).drop("centroid")


#: Parts of a scope by fitness, for each whole number of it, that are ordered apart.
PARTS = 1024


def consolidate(scored: DataFrame, most: int, by: str = "user_id") -> DataFrame:
    """Adds ``keep`` and ``pair``: the fittest ``most`` of each scope stay; the others pair up, neighbours in fitness, an odd last one stays single (null).

    Rows of protected kinds take no part and always stay. A row's place in its scope is its place among the rows of like
    fitness and the number of rows in the parts before: no task orders a whole scope, only the counts of its parts.
    """
    if "operator" not in scored.columns:
        scored = scored.withColumn("operator", F.lit(None).cast("string"))
    rows = checkpointed(scored.withColumn("_free", episodic()).withColumn("_part", F.floor(F.col("fitness") * PARTS)))  # read twice
    before = lambda *order: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where("_free").groupBy(by, "_part").agg(F.count("*").alias("_c")).withColumn("_free", F.lit(True))
    parts = parts.withColumn("_above", F.coalesce(F.sum("_c").over(before(F.desc("_part"))), F.lit(0)))
    parts = parts.withColumn("_go", F.least(F.greatest(F.col("_above") + F.col("_c") - most, F.lit(0)), F.col("_c")))
    parts = parts.withColumn("_below", F.coalesce(F.sum("_go").over(before("_part")), F.lit(0))).withColumn("_n", F.sum("_go").over(Window.partitionBy(by)))
    # part by part, so that a scope of many rows spreads
    placed = rows.join(parts.drop("_c", "_go"), [by, "_part", "_free"], "left")
    place = F.row_number().over(Window.partitionBy(by, "_part", "_free").orderBy(F.desc("fitness"), "id")) + F.col("_above")
    kept = placed.withColumn("keep", ~F.col("_free") | (place <= most))
    worst = F.row_number().over(Window.partitionBy(by, "_part", "_free", "keep").orderBy("fitness", "id")) + F.col("_below")
    out = kept.withColumn("_worst", worst)
    pair = F.when(~F.col("keep") & (F.col("_worst") <= F.floor(F.col("_n") / 2) * 2), F.floor((F.col("_worst") - 1) / 2))
    return out.withColumn("pair", pair).drop("_free", "_part", "_above", "_below", "_n", "_worst")


def hybrids(consolidated: DataFrame, operator: str = "frequency_crossover", dim: int = 64, by: str = "user_id") -> DataFrame:
    """One row for each pair: its two parents' recombined vector, a text of both, and the smaller trust."""
    rows = consolidated.where("pair is not null")
    member = F.sort_array(F.collect_list(F.struct("fitness", "id", "content", "embedding", "trust")))
    pairs = rows.groupBy(by, "pair").agg(member.alias("m")).where(F.size("m") == 2)
    a, b = F.col("m")[0], F.col("m")[1]
    return pairs.select(
        by, "pair", F.array(a["id"], b["id"]).alias("parents"), F.lit(operator).alias("operator"), V.recombine(operator, a["embedding"], b["embedding"], dim).alias("embedding"),
        F.concat(F.lit("consolidated: "), F.substring(a["content"], 1, 60), F.lit(" + "), F.substring(b["content"], 1, 60)).alias("content"), F.least(a["trust"], b["trust"]).alias("trust"),
    )


def consolidation_summary(consolidated: DataFrame, by: str = "user_id") -> DataFrame:
    """before, kept, pruned, pairs of each scope; where nothing is pruned, kept counts all."""
    return consolidated.groupBy(by).agg(F.count("*").alias("before"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("pruned"), F.count_distinct("pair").alias("pairs"))


def synthesis_inputs(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: hybrid_id, parent_id. Parents found, owners among them, the least trust and the first parent that has it."""
    p = memories.select(F.col("id").alias("parent_id"), "user_id", "trust")
    return asked.join(p, "parent_id").groupBy("hybrid_id").agg(F.count("*").alias("n_parents"), F.count_distinct("user_id").alias("n_owners"), F.min("trust").alias("trust"), F.min(F.struct("trust", "parent_id"))["parent_id"].alias("least_trusted"))


def due(memories: DataFrame, threshold: int, by: str = "user_id", running: DataFrame | None = None) -> DataFrame:
    """Scopes over the threshold, all kinds counted, but those that a consolidation is ``running`` for."""
    over = memories.groupBy(by).count().where(F.col("count") > threshold)
    return over if running is None else over.join(running.select(by), by, "left_anti")


def level_counts(rows: DataFrame) -> DataFrame:
    """level, n: rows of each level of a tree; rows without one are its leaves."""
    return rows.groupBy(F.coalesce("level", F.lit(0)).alias("level")).agg(F.count("*").alias("n"))


def within_budget(scored: DataFrame, tokens: int, by: str = "user_id") -> DataFrame:
    """The fittest rows of each scope whose sizes fit a budget of tokens; the fittest always, none after the first that overflows."""
    from .retrieval import budget_take

    placed = scored.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fitness"), "id")))
    return budget_take(placed, tokens, by, "_rank", "tokens").drop("_rank", "used")


def synthesized(memories: DataFrame, asked: DataFrame, operator: str, dim: int, parents: int) -> DataFrame:
    """asked: hybrid_id, pos, parent_id. One row for each hybrid whose ``parents`` parents are there and of one owner: their recombined vector, the parents in order, the least trust."""
    p = memories.select(F.col("id").alias("parent_id"), "user_id", "embedding", "trust")
    member = F.sort_array(F.collect_list(F.struct("pos", "parent_id", "embedding", "trust", "user_id")))
    rows = asked.join(p, "parent_id").groupBy("hybrid_id").agg(member.alias("m"))
    whole = (F.size("m") == parents) & F.forall("m", lambda x: x["user_id"].eqNullSafe(F.col("m")[0]["user_id"]))
    vectors = F.transform("m", lambda x: x["embedding"])
    return rows.where(whole).select(
        "hybrid_id", F.transform("m", lambda x: x["parent_id"]).alias("parents"), V.synthesize(operator, vectors, parents, dim).alias("embedding"), F.array_min(F.transform("m", lambda x: x["trust"])).alias("trust"),
    )
