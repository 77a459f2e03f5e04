"""The typed relation graph: joins of edges and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def related(edges: DataFrame, memories: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """anchor, neighbour: distinct neighbours that are there."""
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    out = edges.select(F.col("from_id").alias("anchor"), F.col("to_id").alias("neighbour"))
    into = edges.select(F.col("to_id").alias("anchor"), F.col("from_id").alias("neighbour"))
    pairs = {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()
    return pairs.join(memories.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").join(memories.select(F.col("id").alias("anchor")), "anchor", "left_semi")


def check_links(links: DataFrame, memories: DataFrame) -> DataFrame:
    """links: id, from_id, to_id with the reason that each is refused for, or null: a missing end, or ends of two owners."""
    a = memories.select(F.col("id").alias("from_id"), F.struct("user_id", "agent_id").alias("a"))
    b = memories.select(F.col("id").alias("to_id"), F.struct("user_id", "agent_id").alias("b"))
    both = links.join(a, "from_id", "left").join(b, "to_id", "left")
    reason = F.when(F.col("a").isNull(), "missing from").when(F.col("b").isNull(), "missing to").when(~F.col("a").eqNullSafe(F.col("b")), "two scopes")
    return both.withColumn("refused", reason).drop("a", "b")


def linked(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def unlinked(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("id"), "id", "left_anti").select(*edges.columns)


def co_mentions(mentions: DataFrame) -> DataFrame:
    """How many names a memory shares with others: rows of names that two memories or more mention."""
    shared = mentions.groupBy("entity").agg(F.count_distinct("memory_id").alias("n")).where("n > 1")
    return mentions.join(shared, "entity").groupBy("memory_id").agg(F.count_distinct("entity").alias("n_shared"))


def persist_entities(mentions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions: memory_id, scope, type, name. New entity nodes (one for each scope, type and normalised name) and the mention edges of all."""
    keyed = mentions.withColumn("key", T.norm(F.col("name")))
    old = known.select("scope", "type", T.norm(F.col("name")).alias("key"), "entity_id")
    own = F.substring(F.sha2(F.concat_ws("\x1f", "scope", "type", "key"), 256), 1, 12)
    nodes = keyed.groupBy("scope", "type", "key").agg(F.min("name").alias("name")).join(old, ["scope", "type", "key"], "left")
    nodes = nodes.withColumn("is_new", F.col("entity_id").isNull()).withColumn("entity_id", F.coalesce("entity_id", own))
    edges = keyed.join(nodes.select("scope", "type", "key", "entity_id"), ["scope", "type", "key"]).select(F.col("memory_id").alias("from_id"), F.col("entity_id").alias("to_id"), F.lit("mentions").alias("relation")).distinct()
    return nodes.where("is_new").select("scope", "type", "name", "entity_id"), edges


def persist_relations(relations: DataFrame, entity_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations: memory_id, from_name, to_name, relation; an edge only where the same memory mentions both names."""
    own = entity_edges.select(F.col("from_id").alias("memory_id"), F.col("to_id").alias("entity_id")).join(nodes.select("entity_id", T.norm(F.col("name")).alias("key")), "entity_id")
    a, b = own.select("memory_id", F.col("key").alias("ka"), F.col("entity_id").alias("from_id")), own.select("memory_id", F.col("key").alias("kb"), F.col("entity_id").alias("to_id"))
    r = relations.withColumn("ka", T.norm(F.col("from_name"))).withColumn("kb", T.norm(F.col("to_name")))
    return r.join(a, ["memory_id", "ka"]).join(b, ["memory_id", "kb"]).select("memory_id", "from_id", "to_id", "relation")


def ancestors(memories: DataFrame, most: int = 10) -> DataFrame:
    """id, ancestor, depth: parents of parents, up to ``most`` steps; the smallest depth counts."""
    one = memories.select("id", F.explode("parents").alias("ancestor"))
    step = one.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    out, front = one.withColumn("depth", F.lit(1)), one
    for depth in range(2, most + 1):
        front = front.join(step, "ancestor").select("id", F.col("next").alias("ancestor")).distinct()
        out = out.unionByName(front.withColumn("depth", F.lit(depth)))
    return out.groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))
