"""Compression of scopes to a budget of rows or tokens: the first rows alone, with recombined pairs of the others, or with summaries of clusters of the others.

rows: scope, id, rank (1 comes first; places count by rank, then id), content, embedding, tokens. The result has scope, id, content, embedding, kind
(``kept``, ``hybrid`` or ``summary``). A scope may hold a third of all rows: the first rows of a count are limited in
every task before they meet, those of a token budget in 64 parts of the scope; k-means is partial sums by cluster and a
join with the scopes' centres; a cluster's members stay a table of links, and no array of them is made.

Defined results: null tokens count 0; a null content is an empty text; rows without a vector belong to the first cluster
and don't move it; a scope that fits the budget is kept whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpointed
from . import trees
from .lifecycle import centroid

#: Parts of a scope in which a budget of tokens is taken first.
PARTS = 64
#: Rounds of k-means; members whose texts a summary is made of; tokens that a summary is planned with.
ROUNDS, SHOWN, SUMMARY_TOKENS = 5, 40, 200
#: Scopes' centres that are broadcast; more are joined by shuffle, each dealt to ``SALT`` keys.
MOST_CENTRES, SALT = 4096, 64
COLUMNS = ("scope", "id", "content", "embedding", "kind")


def _placed(rows: DataFrame, most: int, name: str = "_place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("scope").orderBy("rank", "id"))).where(F.col(name) <= most)


def first_tokens(rows: DataFrame, budget: int) -> DataFrame:
    """The first rows of each scope whose tokens fit the budget, the first always, none after the first that overflows. Adds ``used``.

    A row that fits in its scope fits in its part of the scope: parts are cut first.
    """
    size, part = F.coalesce("tokens", F.lit(0)), F.pmod(F.xxhash64("id"), F.lit(PARTS))
    rows = rows.withColumn("_part", part)
    for keys in (("scope", "_part"), ("scope",)):
        order = Window.partitionBy(*keys).orderBy("rank", "id")
        rows = rows.withColumn("used", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order)).where((F.col("used") <= budget) | (F.col("_n") == 1))
    return rows.drop("_part", "_n")


def _as(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("kind", F.lit(kind)).select(*COLUMNS)


def pruned(rows: DataFrame, count: int | None = None, tokens: int | None = None) -> DataFrame:
    """The first ``count`` rows of each scope, or those that fit ``tokens``."""
    if (count is None) == (tokens is None):
        raise ValueError("give count or tokens")
    return _as(first_tokens(rows, tokens) if count is None else _placed(rows, count), "kept")


def paired(rows: DataFrame, count: int, operator: str = "frequency_crossover", dim: int = 64) -> DataFrame:
    """The first ``count // 2`` rows of each scope, and for the rest of the count a hybrid of each two that follow, named by both ids. A last row without a partner goes."""
    keep = count // 2
    near = _placed(rows, keep + 2 * (count - keep))
    n = F.col("_place") - 1 - keep
    member = F.struct("_place", "id", "content", "embedding")
    pairs = near.where(n >= 0).groupBy("scope", F.floor(n / 2).alias("pair")).agg(F.min(member).alias("a"), F.max(member).alias("b")).where("a._place < b._place")
    text = lambda c: F.substring(F.coalesce(F.col(f"{c}.content"), F.lit("")), 1, 60)
    made = pairs.select("scope", F.concat_ws("+", "a.id", "b.id").alias("id"), F.concat(F.lit("consolidated: "), text("a"), F.lit(" + "), text("b")).alias("content"), V.recombine(operator, F.col("a.embedding"), F.col("b.embedding"), dim).alias("embedding"))
    return _as(near.where(n < 0).withColumn("id", F.col("id").cast("string")), "kept").unionByName(_as(made, "hybrid"))


def _nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with ``cluster``: the nearest centre of the scope, by distances to nine places; of equal ones the first."""
    one = centres.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("_centres"))  # k at most
    if centres.count() <= MOST_CENTRES:
        both = rows.join(F.broadcast(one), "scope", "left")
    else:
        salted = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["scope", "_salt"], "left").drop("_salt")
    far = lambda c: F.round(V.dot(c["centroid"], c["centroid"]) - 2 * V.dot(F.col("embedding"), c["centroid"]), 9)
    near = F.array_min(F.transform("_centres", lambda c: F.struct(far(c).alias("far"), c["cluster"].alias("cluster"))))
    return both.withColumn("cluster", F.when(F.col("embedding").isNull(), 0).otherwise(F.coalesce(near["cluster"], F.lit(0)))).drop("_centres")


def _means(rows: DataFrame) -> DataFrame:
    means = centroid(rows.withColumn("_own", F.struct("scope", "cluster")), "_own")
    return checkpointed(means.select("_own.scope", "_own.cluster", "centroid"))


def grouped(rows: DataFrame, k: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """k: scope, k (``most`` at most). Adds ``cluster``, from 0: k-means within each scope. The first centres are the rows with the least MD5 of their ids; a centre that has lost its rows goes."""
    seeds = rows.where("embedding IS NOT NULL").withColumn("_seed", F.row_number().over(Window.partitionBy("scope").orderBy(F.md5(F.col("id").cast("string")), "id"))).where(F.col("_seed") <= most)
    centres = checkpointed(seeds.join(k, "scope").where(F.col("_seed") <= F.col("k")).select("scope", (F.col("_seed") - 1).alias("cluster"), F.col("embedding").alias("centroid")))
    for _ in range(rounds):
        centres = _means(_nearest(rows, centres))
    return _nearest(rows, centres)


def clustered(rows: DataFrame, count: int | None = None, tokens: int | None = None, factory: Callable | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The compressed scopes, and node_id, member_id: the links of each summary.

    By count, half of it (rounded up) are the first rows and the other half summaries of clusters of all others. By tokens,
    the first rows fit half the budget, and there are summaries for what is left at ``SUMMARY_TOKENS`` each, for two rows
    each at least; where fewer than four rows are left, those that fit are kept. Summaries past the budget go, from the first that overflows on.
    A summary's text comes from its first ``SHOWN`` members: from ``factory`` (see ``trees``), else ``trees.plain_summary``;
    its vector is the mean of all members.
    """
    if (count is None) == (tokens is None):
        raise ValueError("give count or tokens")
    rows = checkpointed(rows.select("scope", "id", "rank", "content", "embedding", F.coalesce("tokens", F.lit(0)).alias("tokens")))
    half = first_tokens(rows, tokens // 2) if count is None else _placed(rows, count - count // 2).withColumn("used", F.lit(0))
    half = half.select("scope", "id", "content", "embedding", "rank", "used")
    last = half.groupBy("scope").agg(F.max("used").alias("used"), F.count("*").alias("n_kept"))
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n")).join(last, "scope", "left").select("scope", (F.col("n") - F.coalesce("n_kept", F.lit(0))).alias("rest"), F.coalesce("used", F.lit(0)).alias("used"))
    if count is None:
        most = max(1, tokens // SUMMARY_TOKENS)
        k = F.when(F.col("rest") >= 4, F.greatest(F.lit(1), F.least(F.floor(F.col("rest") / 2), F.floor((tokens - F.col("used")) / SUMMARY_TOKENS)))).otherwise(0)
    else:
        most = count // 2
        k = F.when(F.col("rest") >= max(1, most), most).otherwise(0)
    sizes = checkpointed(sizes.withColumn("k", k))
    rest = rows.join(half.select("scope", "id"), ["scope", "id"], "left_anti")
    whole = rest.join(sizes.where("k = 0"), "scope")
    if count is None:  # few rows are left: fewer than four a scope
        order = Window.partitionBy("scope").orderBy("rank", "id")
        whole = whole.withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order)).where((F.col("_sum") <= tokens - F.col("used")) | (F.col("_n") == 1))
    else:
        whole = _placed(whole, most)
    rest = checkpointed(grouped(checkpointed(rest.join(sizes.where("k > 0").select("scope"), "scope", "left_semi")), sizes.where("k > 0").select("scope", "k"), max(1, most), rounds))
    rest = rest.withColumn("node_id", F.concat_ws("/", "scope", "cluster"))
    shown = rest.withColumn("_n", F.row_number().over(Window.partitionBy("node_id").orderBy("rank", "id"))).where(F.col("_n") <= SHOWN)
    texts = shown.groupBy("scope", "cluster", "node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.coalesce("content", F.lit("")).alias("text")))), lambda s: s["text"]).alias("texts"))
    named = texts.withColumn("text", trees.plain_summary(F.col("texts"))) if factory is None else texts.drop("texts").join(trees._summarised(texts, factory), "node_id")
    nodes = named.join(_means(rest), ["scope", "cluster"], "left").select("scope", "cluster", F.col("node_id").alias("id"), F.col("text").alias("content"), F.col("centroid").alias("embedding"))
    if count is None:
        said = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
        order = Window.partitionBy("scope").orderBy("cluster")
        nodes = nodes.join(sizes.select("scope", "used"), "scope").withColumn("_sum", F.sum(said).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(order))
        nodes = checkpointed(nodes.where((F.col("_sum") <= tokens - F.col("used")) | (F.col("_n") == 1)))
    links = rest.select("node_id", F.col("id").alias("member_id")).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    kept = _as(half, "kept").unionByName(_as(whole, "kept")).withColumn("id", F.col("id").cast("string"))
    return kept.unionByName(_as(nodes, "summary")), links
