"""A thin store over the operators: tables in, tables out. Every change gives a new store; nothing is changed in place."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph, lifecycle, mutations, retrieval, scan, temporal
from .session import written

MEMORIES = "id bigint, content string, embedding array<float>, user_id string, agent_id string, created_at double, accessed_at double, access_count int, parents array<bigint>, operator string, metadata string, trust int"
EDGES = "id bigint, from_id bigint, to_id bigint, relation string, weight double, created_at double"
#: Rows found that are broadcast to the memories.
MOST_FOUND = 1_000_000
FACTS = "id bigint, entity_id bigint, fact_type string, value string, valid_from double, believed_by string, source_memory_id bigint, seq bigint"


@dataclass(frozen=True)
class MemoryStore:
    """Memories, edges, facts and their explicit closings."""

    memories: DataFrame
    edges: DataFrame
    facts: DataFrame
    closings: DataFrame
    dim: int = 64

    @classmethod
    def empty(cls, spark: SparkSession, dim: int = 64) -> MemoryStore:
        none = lambda schema: spark.createDataFrame([], schema)
        return cls(none(MEMORIES), none(EDGES), none(FACTS), none("id bigint, at double, seq bigint"), dim)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, dim: int = 64) -> MemoryStore:
        load = lambda name: spark.read.parquet(f"{folder}/{name}")
        return cls(load("memories"), load("edges"), load("facts"), load("closings"), dim)

    def write(self, folder: str) -> None:
        """Memories lie by owner, so that a scope's reads touch its own files only."""
        self.memories.write.partitionBy("user_id").parquet(f"{folder}/memories")
        for name in ("edges", "facts", "closings"):
            getattr(self, name).write.parquet(f"{folder}/{name}")

    # ------------------------------------------------------------ memories

    def add(self, rows: DataFrame) -> MemoryStore:
        """Rows that break a rule are an error, as is an id that is taken. The rows are written once; the check and every later read start from there."""
        rows, _ = written(rows)
        _, bad = scan.split_valid(rows, scan.record_rules(self.dim))
        if worst := bad.select("id", "broken").first():
            raise ValueError(f"record {worst.id} breaks {', '.join(worst.broken)}")
        return replace(self, memories=mutations.insert(self.memories, rows))

    def get(self, ids: DataFrame, show_quarantined: bool = False) -> DataFrame:
        found = scan.owned(self.memories, ids)
        return found if show_quarantined else found.where(~scan.quarantined())

    def list(self, user_id: str | None = None, agent_id: str | None = None, show_quarantined: bool = False) -> DataFrame:
        rows = scan.scope(self.memories, user_id, agent_id)
        return scan.public(rows if show_quarantined else rows.where(~scan.quarantined()))

    def count(self, user_id: str | None = None, agent_id: str | None = None) -> int:
        return scan.scope(self.memories, user_id, agent_id).count()

    def update(self, patches: DataFrame, columns: tuple[str, ...] = ("content", "metadata")) -> MemoryStore:
        if "content" in columns and (blank := patches.where(F.col("content").isNotNull() & (T.stripped(F.col("content")) == "")).first()):
            raise ValueError(f"record {blank.id} would be blank")
        return replace(self, memories=mutations.update(self.memories, patches, columns))

    def delete(self, ids: DataFrame) -> MemoryStore:
        memories, edges = mutations.delete(self.memories, self.edges, ids)
        return replace(self, memories=memories, edges=edges)

    def reset(self, user_id: str | None = None, agent_id: str | None = None) -> MemoryStore:
        left, _ = mutations.reset(self.memories, user_id, agent_id)
        gone = self.memories.join(left.select("id"), "id", "left_anti").select("id")
        return self.delete(gone)

    def touch(self, log: DataFrame) -> MemoryStore:
        return replace(self, memories=mutations.touch(self.memories.drop("accessed_at"), log).select(*self.memories.columns))

    def search(self, queries: DataFrame, limit: int = 10, filter_parents: bool = True, mode: str = "dense", mentions: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank, and the shown columns of each memory."""
        if mode == "graph":
            found = retrieval.graph_search(self.memories.where(~scan.quarantined()), queries, mentions, limit)
        else:
            found = retrieval.search(self.memories, queries, limit, filter_parents, mode=mode)
        few = queries.count() * retrieval.check_limit(limit) <= MOST_FOUND  # then the memories aren't shuffled for it
        return (F.broadcast(found) if few else found).join(scan.public(self.memories), "id")

    def search_quarantined(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return retrieval.search_quarantined(self.memories, queries, limit)

    def explain(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return retrieval.explain(self.memories, queries, limit)

    # ------------------------------------------------------------ relations

    def link(self, links: DataFrame) -> MemoryStore:
        checked = graph.check_links(links, self.memories)
        if bad := checked.where("refused is not null").first():
            raise ValueError(f"link {bad.id}: {bad.refused}")
        return replace(self, edges=self.edges.unionByName(checked.drop("refused"), allowMissingColumns=True))

    def unlink(self, ids: DataFrame) -> MemoryStore:
        return replace(self, edges=self.edges.join(ids.select("id"), "id", "left_anti"))

    def related(self, direction: str = "both", relation: str | None = None) -> DataFrame:
        return graph.related(self.edges, self.memories, direction, relation)

    def entities(self, entity_type: str | None = None) -> DataFrame:
        rows = self.memories.where("operator = 'entity'").withColumn("entity_type", F.get_json_object("metadata", "$.entity_type")).withColumn("entity_name", F.get_json_object("metadata", "$.entity_name"))
        return scan.kind(rows, "entity", entity_type)

    # ------------------------------------------------------------ facts

    def record(self, facts: DataFrame) -> MemoryStore:
        return replace(self, facts=self.facts.unionByName(facts, allowMissingColumns=True))

    def invalidate(self, closings: DataFrame) -> MemoryStore:
        return replace(self, closings=self.closings.unionByName(closings))

    def held(self) -> DataFrame:
        return temporal.invalidate(temporal.intervals(self.facts), self.closings)

    def current_facts(self, now: float) -> DataFrame:
        return temporal.current(self.held(), now)

    def facts_valid_at(self, asked: DataFrame) -> DataFrame:
        return temporal.as_of(self.held(), asked)

    def timeline(self) -> DataFrame:
        return temporal.timeline(self.held())

    def conflicts(self, now: float) -> DataFrame:
        return temporal.conflicts(self.held(), now)

    # ------------------------------------------------------------ upkeep

    def consolidate(self, most: int, now: float, half_life_days: float = 30.0) -> MemoryStore:
        """Each owner keeps its fittest ``most`` memories; the others go, with the edges that touch them."""
        marked = lifecycle.consolidate(lifecycle.fitness(self.memories, now, half_life_days), most)
        return self.delete(marked.where(~F.col("keep")).select("id"))

    def register(self) -> None:
        """The tables as temporary views, for SQL."""
        for name in ("memories", "edges", "facts"):
            getattr(self, name).createOrReplaceTempView(name)
        self.held().createOrReplaceTempView("held")
