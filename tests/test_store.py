"""The store: changes give new stores, reads follow them."""

import pytest
from pyspark.sql import functions as F

from memloom.sources import views
from memloom.store import MEMORIES, MemoryStore


def record(n, user="u", trust=3, parents=(), operator=None, uses=0):
    return (n, f"memory number {n}", [float(n), 1.0], user, None, float(n), None, uses, list(parents), operator, None, trust)


@pytest.fixture
def store(spark):
    rows = [record(1), record(2, uses=5), record(3, "w"), record(4, trust=0), record(5, parents=[1], operator="simple_average")]
    return MemoryStore.empty(spark, 2).add(spark.createDataFrame(rows, MEMORIES))


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_reads(store, spark):
    assert store.count() == 5 and store.count("u") == 4 and store.count("u", "a") == 0
    assert ids(store.list("u")) == [1, 2, 5] and ids(store.list("u", show_quarantined=True)) == [1, 2, 4, 5]
    asked = spark.createDataFrame([(1, "u"), (3, "u"), (4, "u"), (3, None)], "id long, user_id string")
    assert ids(store.get(asked)) == [1, 3]
    q = spark.createDataFrame([(1, "memory", [1.0, 1.0])], "query_id long, text string, embedding array<float>")
    assert {r.id for r in store.search(q, 10).collect()} == {2, 3, 5} and ids(store.search_quarantined(q)) == [4]
    assert {r.id for r in store.search(q, 10, mode="hybrid").collect()} == {2, 3, 5}
    assert store.explain(q).count() == 5


def test_bad_records_and_taken_ids_are_refused(store, spark):
    for bad in ((9, " ", [1.0, 1.0]), (9, "x", [1.0]), (9, "x", [1.0, float("nan")])):
        row = list(record(9))
        row[1], row[2] = bad[1], bad[2]
        with pytest.raises(ValueError):
            store.add(spark.createDataFrame([tuple(row)], MEMORIES))
    with pytest.raises(Exception, match="taken"):
        store.add(spark.createDataFrame([record(1)], MEMORIES)).memories.collect()


def test_changes_give_new_stores(store, spark):
    linked = store.link(spark.createDataFrame([(1, 1, 2, "next", 0.5), (2, 2, 5, "next", 0.5)], "id long, from_id long, to_id long, relation string, weight double"))
    assert store.edges.count() == 0 and linked.related().count() == 4
    with pytest.raises(ValueError):
        store.link(spark.createDataFrame([(3, 1, 3, "next", 0.5)], "id long, from_id long, to_id long, relation string, weight double"))
    gone = linked.delete(spark.createDataFrame([(2,)], "id long"))
    assert ids(gone.memories) == [1, 3, 4, 5] and gone.edges.count() == 0 and ids(linked.unlink(spark.createDataFrame([(1,)], "id long")).edges) == [2]
    assert ids(store.reset("u").memories) == [3]
    renamed = store.update(spark.createDataFrame([(1, "new", None)], "id long, content string, metadata string"))
    assert renamed.memories.where("id = 1").first().content == "new"
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([(1, "  ", None)], "id long, content string, metadata string"))
    seen = store.touch(spark.createDataFrame([(1, 5.0), (1, 7.0)], "id long, at double")).memories.where("id = 1").first()
    assert (seen.access_count, seen.accessed_at) == (2, 7.0)
    assert ids(store.consolidate(1, 10.0).memories) == [2, 3]


def test_facts_and_files(spark, sf, tmp_path, store):
    full = store.record(views.facts(spark, sf))
    first = full.facts.first().id
    closed = full.invalidate(spark.createDataFrame([(first, 1.0, 1)], "id long, at double, seq long"))
    assert closed.held().where(F.col("id") == first).first().valid_until == 1.0
    now = full.facts.agg(F.max("valid_from")).first()[0]
    assert 0 < full.current_facts(now).count() < full.facts.count() == full.timeline().count()
    assert full.conflicts(now).count() >= 0
    full.write(str(tmp_path / "s"))
    again = MemoryStore.read(spark, str(tmp_path / "s"), 2)
    assert again.count("u") == 4 and again.held().count() == full.held().count()
    again.register()
    assert spark.sql("select count(*) from held").first()[0] == full.facts.count()
