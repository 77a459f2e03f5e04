"""Connected components of a link table by alternating stars; every step is a join or an aggregate, none gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, loose


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: u, v (long). Returns node, root: each node that has a link, and the smallest node of its component.

    A round links every node's larger neighbours to its smallest neighbour, then its smaller neighbours likewise
    (large star, small star), until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Minima are taken by aggregates with partial sums and joined back, so that a hub's rows are never in one task's group.
    Each round's table is checkpointed.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = loose(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = loose(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
