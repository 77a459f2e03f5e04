"""Scans, filters and predicates over the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

# Trust of a source, the least trust that recall shows, the trust of what has no tag.
TIERS = {"system": 4, "user": 3, "agent": 2, "tool": 1, "web": 0}
RECALL_MIN, UNTAGGED = 2, 3
# Kinds that pruning leaves alone.
PROTECTED = ("entity", "entity_fact", "raptor_summary", "core_memory")
MOST_CONTENT, MOST_KEYS = 100_000, 100


def scope(rows: DataFrame, user_id: str | None = None, agent_id: str | None = None) -> DataFrame:
    """Rows of a scope; a part of the scope that isn't named filters nothing (so null owners show unscoped only)."""
    for name, value in (("user_id", user_id), ("agent_id", agent_id)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def owned(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows fetched by id on behalf of a scope (asked: id, user_id): another owner's rows, and ownerless ones, are refused."""
    a = asked.select(F.col("id"), F.col("user_id").alias("asker"))
    return rows.join(a, "id").where(F.col("asker").isNull() | (F.col("user_id") == F.col("asker"))).drop("asker")


def fetched(rows: DataFrame, asked: DataFrame, at: float) -> DataFrame:
    """What an owner's fetch by id shows, held-back rows left out, with the fetch counted: one use more, used last ``at``."""
    return owned(rows, asked).where(~quarantined()).withColumn("access_count", F.col("access_count") + 1).withColumn("accessed_at", F.lit(float(at)))


def tier_of(source: Column) -> Column:
    """A source's trust; an unknown source is an error."""
    found = F.lit(None).cast("int")
    for name, tier in TIERS.items():
        found = F.when(source == name, tier).otherwise(found)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown source "), source)).cast("int"))


def trust(column: str = "trust", untagged: int = UNTAGGED) -> Column:
    return F.coalesce(F.col(column), F.lit(untagged))


def quarantined(column: str = "trust", least: int = RECALL_MIN, untagged: int = UNTAGGED) -> Column:
    return trust(column, untagged) < least


def hidden_parents(rows: DataFrame) -> DataFrame:
    """id of each row that another row of the same owner names as its parent."""
    return rows.select("user_id", F.explode("parents").alias("id")).distinct()


def without_parents(rows: DataFrame) -> DataFrame:
    return rows.join(hidden_parents(rows).select("id").distinct(), "id", "left_anti")


def kind(rows: DataFrame, operator: str, entity_type: str | None = None) -> DataFrame:
    rows = rows.where(F.col("operator") == operator)
    return rows if entity_type is None else rows.where(F.upper("entity_type") == entity_type.upper())


def episodic() -> Column:
    """Rows that pruning may touch; a null kind is one."""
    return F.col("operator").isNull() | ~F.col("operator").isin(*PROTECTED)


def archival(rows: DataFrame) -> DataFrame:
    """What an agent's archival search and count see: all but its core blocks."""
    return rows.where(F.col("operator").isNull() | (F.col("operator") != "core_memory"))


def shown(rows: DataFrame) -> DataFrame:
    """What a listing shows: rows of enough trust, without their vectors."""
    return public(rows.where(~quarantined()))


def record_rules(dim: int) -> dict[str, Column]:
    """The rules that a row to be stored must meet, each true where it is met."""
    c, e, p = F.col("content"), F.col("embedding"), F.col("parents")
    return {
        "id": F.col("id").isNotNull() & (F.col("id").cast("string") != ""),
        "content_present": c.isNotNull() & (T.stripped(c) != ""),
        "content_size": F.length(c) <= MOST_CONTENT,
        "content_utf8": F.is_valid_utf8(c),
        "content_no_nul": ~F.contains(c, F.lit("\0")),
        "vector_present": e.isNotNull() & (F.size(e) > 0),
        "vector_size": F.size(e) == dim,
        "vector_finite": V.is_finite(e),
        "access_count": F.col("access_count") >= 0,
        "parents_named": F.coalesce(F.forall(p, lambda x: x.isNotNull() & (x.cast("string") != "")), F.lit(True)),
        "parents_kind": (F.coalesce(F.size(p), F.lit(0)) <= 0) | F.col("operator").isNotNull(),
        "metadata": F.col("metadata").isNull() | (F.coalesce(F.size(F.json_object_keys("metadata")), F.lit(MOST_KEYS + 1)) <= MOST_KEYS),
    }


def edge_rules() -> dict[str, Column]:
    named = lambda n: F.col(n).isNotNull() & (F.col(n).cast("string") != "")
    return {"from": named("from_id"), "to": named("to_id"), "relation": named("relation"), "weight": F.col("weight").between(0, 1) & ~F.isnan("weight")}


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of the rules that they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def public(rows: DataFrame) -> DataFrame:
    return rows.drop("embedding")


def edges_of(edges: DataFrame, anchor: Column | int, relation: str | None = None, direction: str = "both") -> DataFrame:
    """Edges out of, into, or on either side of an anchor; a self-loop is on both sides and shows twice."""
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    out, into = edges.where(F.col("from_id") == anchor), edges.where(F.col("to_id") == anchor)
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def edges_for(edges: DataFrame, memories: DataFrame, asked: DataFrame, direction: str = "both") -> DataFrame:
    """asked: anchor, user_id. The edges of each anchor that is the asker's own (an asker without a name sees all), with the side that the anchor is on."""
    own = owned(memories.select("id", "user_id"), asked.select(F.col("anchor").alias("id"), "user_id")).select(F.col("id").alias("anchor"))
    sides = {"out": ("from_id",), "in": ("to_id",), "both": ("from_id", "to_id")}[direction]
    out = None
    for side in sides:
        part = edges.withColumn("anchor", F.col(side)).join(own, "anchor").withColumn("side", F.lit("out" if side == "from_id" else "in"))
        out = part if out is None else out.unionByName(part)
    return out
