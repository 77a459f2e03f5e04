"""Summary trees: the rows of every scope in clusters, the clusters in clusters, each with a text that sums it up.

All scopes are built in one plan and by one algorithm. A scope's rows are cut into cells of at most ``CELL`` rows, as long
as a cell has more: through the cell's mean, along the line between two of its rows. Every round cuts all cells that
are too large, by partial sums and a join with the cells' cuts, so no task holds a scope. Each cell is then clustered in
one task, by k-means into groups of about ``branching`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpointed, ship
from .lifecycle import centroid

#: The kind of a row that a tree made.
SUMMARY = "raptor_summary"
#: Rows that are clustered together, and rounds of cuts after which a cell that is still too large is dealt by hash.
CELL, ROUNDS = 2048, 48
#: Cells' cuts that are broadcast; more are joined by shuffle, each dealt to ``SALT`` keys.
MOST_CUTS, SALT = 4096, 64


def _cuts(rows: DataFrame, large: DataFrame, turn: int) -> DataFrame:
    """scope, cell, at, along: for each large cell a line between two of its rows, and the product of its mean and that line."""
    own = rows.join(large, ["scope", "cell"], "left_semi").withColumn("_own", F.struct("scope", "cell"))
    key = F.struct(F.xxhash64("id", F.lit(turn)), "id")
    ends = own.groupBy("_own").agg(F.min_by("embedding", key).alias("a"), F.max_by("embedding", key).alias("b"))
    along = F.zip_with("b", "a", lambda x, y: x - y)
    both = ends.join(centroid(own, "_own"), "_own").select("_own.scope", "_own.cell", along.alias("along"), "centroid")
    return both.select("scope", "cell", V.dot(F.col("centroid"), F.col("along")).alias("at"), "along")


def cells(rows: DataFrame, cell: int = CELL, seed: int = 42) -> DataFrame:
    """rows: scope (not null), id, embedding and others. Adds ``cell``, of which none has more than ``cell`` rows of a scope.

    Rows on a cut (as in a cell of equal vectors) go to a side by hash. A cell that is too large after ``ROUNDS`` rounds is
    dealt by hash too, and dealt again while a part is too large.
    """
    rows = checkpointed(rows.withColumn("cell", F.lit("c")))
    turn = 0
    while True:
        large = checkpointed(rows.groupBy("scope", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("scope", "cell"))
        n = large.count()
        if not n:
            return rows
        bit = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2))
        if turn < ROUNDS:
            cuts = checkpointed(_cuts(rows, F.broadcast(large) if n <= MOST_CUTS else large, seed + turn))
            away = V.dot(F.col("embedding"), F.col("along")) - F.col("at")
            side = F.when(away > 0, F.lit(1)).when(away < 0, F.lit(0)).otherwise(bit)
        else:
            cuts, side = large, bit
        cuts = cuts.withColumn("_cut", F.lit(True))
        if n <= MOST_CUTS:
            both = rows.join(F.broadcast(cuts), ["scope", "cell"], "left")
        else:
            salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            both = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["scope", "cell", "_salt"], "left")
        named = F.when(F.col("_cut"), F.concat("cell", side.cast("string"))).otherwise(F.col("cell"))
        rows = checkpointed(both.withColumn("cell", named).select(*rows.columns))
        turn += 1


def clustered(rows: DataFrame, branching: int, seed: int = 42, cell: int = CELL) -> DataFrame:
    """rows: scope, id, text, embedding. Adds ``cluster``: k-means groups of about ``branching`` rows each, within a scope.

    The first centres are drawn by their distance from those already drawn, over the rows by id, with a fixed seed: the
    same rows give the same clusters, however they are spread.
    """
    ship(rows.sparkSession)

    def one(group):
        import numpy as np

        group = group.sort_values("id", kind="stable")
        x = np.array(group["embedding"].tolist(), dtype=np.float64)
        k, rng = max(1, len(x) // branching), np.random.default_rng(seed)
        far, chosen = np.full(len(x), np.inf), [int(rng.integers(len(x)))]
        while len(chosen) < k:
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            total = far.sum()
            if total <= 0:
                break
            chosen.append(int(rng.choice(len(x), p=far / total)))
        centres, own = x[chosen], None
        for _ in range(20):
            near = np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * (x[lo : lo + 512] @ centres.T), axis=1) for lo in range(0, len(x), 512)])
            if own is not None and (near == own).all():
                break
            own, counts, sums = near, np.bincount(near, minlength=len(centres)), np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        name = group["cell"].iloc[0]
        return group[["scope", "id", "text", "embedding"]].assign(cluster=[f"{name}-{c}" for c in own.tolist()])

    return cells(rows, cell, seed).groupBy("scope", "cell").applyInPandas(lambda group: one(group), "scope string, id string, text string, embedding array<double>, cluster string")


def plain_summary(texts: Column) -> Column:
    """The text of a cluster without a model: 80 characters each of its first six members."""
    return F.concat(F.lit("summary of: "), F.array_join(F.transform(F.slice(texts, 1, 6), lambda t: F.substring(t, 1, 80)), " ; "))


def _summarised(clusters: DataFrame, factory: Callable[[], Callable[[list[str]], str]]) -> DataFrame:
    """clusters: node_id, texts. node_id, text: what the model says of each cluster's texts; ``factory`` makes it once a task."""
    ship(clusters.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            said = [str(model(texts)) for texts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["node_id", "text"])

    return clusters.select("node_id", "texts").mapInArrow(run, "node_id string, text string")


def summary_tree(
    memories: DataFrame, branching: int = 4, most_levels: int = 3, seed: int = 42, cell: int = CELL, by: tuple[str, ...] = (), summariser: Callable[[], Callable[[list[str]], str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, level, ``by``, embedding, size, text) and edges (node_id, member_id, weight) of the trees of all scopes.

    memories: id, content, embedding and the columns of ``by``, whose values (null is one) make a scope; without any, all
    rows are one scope. Rows that a tree made before (operator ``SUMMARY``) and rows without a vector take no part. In
    each scope a level clusters the one below while that has 2 * branching rows or more; clusters of one row are
    skipped. A node's vector is the mean of its members', an edge weighs 1 / members. ``summariser()`` makes, once a
    task, the function from a cluster's whole texts, by id (null: empty), to the node's text; else ``plain_summary``
    does. The loop is over levels; each is checkpointed, so a model is asked once.
    """
    if isinstance(branching, bool) or not isinstance(branching, int) or branching < 2:
        raise ValueError(f"branching must be a whole number of at least 2, not {branching!r}")
    if isinstance(most_levels, bool) or not isinstance(most_levels, int) or most_levels < 1:
        raise ValueError(f"most_levels must be a whole number of at least 1, not {most_levels!r}")
    if "operator" in memories.columns:
        memories = memories.where(~F.col("operator").eqNullSafe(F.lit(SUMMARY)))
    scope = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    level_rows = memories.where(F.size("embedding") > 0).select(
        scope.alias("scope"), F.col("id").cast("string").alias("id"), F.coalesce("content", F.lit("")).alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )
    keys = memories.select(scope.alias("scope"), *by).distinct() if by else None
    nodes = edges = None
    for level in range(1, most_levels + 1):
        counts = checkpointed(level_rows.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * branching).select("scope"))
        if nodes is not None and counts.isEmpty():
            break
        found = checkpointed(clustered(level_rows.join(counts, "scope", "left_semi"), branching, seed, cell))
        name = F.concat(F.lit(f"level{level}/"), F.substring(F.sha2("scope", 256), 1, 16), F.lit("/"), "cluster")
        named = found.withColumn("node_id", name)
        texts = F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda s: s["text"])  # a cluster lies in one cell
        groups = named.groupBy("node_id").agg(F.min("scope").alias("scope"), F.count("*").alias("size"), texts.alias("texts")).where("size >= 2")
        if summariser is None:
            groups = groups.withColumn("text", plain_summary(F.col("texts"))).drop("texts")
        else:
            groups = checkpointed(groups)
            groups = groups.drop("texts").join(_summarised(groups, summariser), "node_id")
        made = checkpointed(groups.join(centroid(named, "node_id"), "node_id").select("node_id", F.lit(level).alias("level"), "scope", F.col("centroid").alias("embedding"), "size", "text"))
        members = named.join(made.select("node_id", "size"), "node_id").select("node_id", F.col("id").alias("member_id"), (1 / F.col("size")).alias("weight"))
        nodes, edges = (made, members) if nodes is None else (nodes.unionByName(made), edges.unionByName(members))
        level_rows = made.select("scope", F.col("node_id").alias("id"), "text", "embedding")
    if by:
        nodes = nodes.join(keys, "scope")
    return nodes.select("node_id", "level", *by, "embedding", "size", "text"), edges
