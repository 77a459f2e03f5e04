"""Models as callables, guards and caches."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memloom.operators import guards, retrieval
from memloom.sources import models


def test_a_passing_failure_is_tried_again():
    calls, waits = [], []

    def model(items):
        calls.append(len(items))
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return items

    assert models.retried(model, [1, 2], sleep=waits.append) == [1, 2] and calls == [2, 2, 2] and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        models.retried(lambda items: (_ for _ in ()).throw(RuntimeError("HTTP 503")), [1], attempts=2, sleep=waits.append)
    with pytest.raises(ValueError):  # a failure that stays is raised at once
        models.retried(lambda items: (_ for _ in ()).throw(ValueError("bad key")), [1], sleep=waits.append)
    assert len(waits) == 3


def test_embedding_and_answers(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "b")], "id long, content string").coalesce(1)
    got = {r.id: list(r.embedding) for r in models.embed(rows, lambda: lambda texts: [[t.count("a"), t.count("b")] for t in texts]).collect()}
    assert got == {1: [1, 1], 2: [0, 0], 3: [0, 0], 4: [0, 1]}
    said = {r.id: r.response for r in models.respond(rows, lambda: lambda prompts: [p.upper() for p in prompts], "content").collect()}
    assert said == {1: "AB", 2: "", 3: None, 4: "B"}
    with pytest.raises(PySparkException):
        models.respond(rows, lambda: lambda prompts: prompts[1:], "content").collect()
    assert models.embed(rows.limit(0), lambda: lambda texts: []).count() == 0


def test_a_declined_answer_isnt_judged(spark):
    rows = spark.createDataFrame([(1, "q", "Rome", "It is Rome"), (2, "q", "Rome", "I don't know")], "question_id long, question string, gold string, answer string")

    def judge():
        def one(prompts):
            assert all("know" not in p for p in prompts)
            return ["CORRECT"] * len(prompts)

        return one

    assert {r.question_id: (r.label, r.score) for r in models.judged(rows, judge).collect()} == {1: ("CORRECT", 1.0), 2: ("INCORRECT", 0.0)}


def test_a_cross_encoder_reorders(spark):
    rows = spark.createDataFrame([(1, "query", n, n, f"text {n}") for n in range(1, 7)], "query_id long, text string, id long, rank int, content string")
    found = models.reranked(rows, lambda: lambda pairs: [float(c.split()[1]) if q == "query" else -1.0 for q, c in pairs], 6)
    scores = rows.withColumn("rerank_score", F.col("id").cast("double"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in retrieval.rerank(scores, 6).select(*found.columns).collect())


def test_guards_in_order(spark):
    rows = spark.createDataFrame([(1, None, None, "search", 10, None), (2, " ", None, "search", 10, None), (3, None, "a", "search", 10, None), (4, None, None, "reset", 10, True), (5, None, None, "reset", 10, None), (6, "u", None, "add", 2_000_000, None)], "n int, user_id string, agent_id string, op string, n_bytes int, confirm boolean")
    assert {r.n: r.refused for r in guards.guarded(rows).collect()} == {1: "no scope", 2: "no scope", 3: None, 4: None, 5: "not confirmed", 6: "too large"}
    assert {r.n: r.refused for r in guards.guarded(rows, require_scope=False).collect()}[1] is None


def test_a_write_ends_what_was_cached(spark):
    search = lambda seq, at, text, user: (seq, float(at), text, user, None, 5, True, "dense")
    rows = [search(1, 1, "Hi ", "u"), search(2, 2, "hi", "u"), search(3, 4, "hi", "u"), search(4, 5, "hi", "v"), search(5, 5, "hi", None), search(6, 6, "hi", None), search(7, 9000, "hi", None), search(8, 9001, "hi", "v"), search(9, 9002, "hi|", "v")]
    searches = spark.createDataFrame(rows, "seq long, at double, text string, user_id string, agent_id string, limit int, filter_parents boolean, mode string")
    writes = spark.createDataFrame([("u", None, 3.0), ("u", None, 8000.0)], "user_id string, agent_id string, at double")
    assert {r.seq for r in guards.cached(searches, writes).where("hit").collect()} == {2, 6, 8}
