"""Compression of scopes against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from memloom.operators import compress

SCHEMA = "scope string, id long, rank double, content string, embedding array<double>, tokens int"


def table(spark, rng, sizes):
    rows = []
    for scope, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 30)))
            rows.append((scope, i, float(rng.randint(0, 9)), text, [rng.gauss(0, 1) for _ in range(4)], len(text.split())))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def by_scope(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def until(rows, budget):
    out, used = [], 0
    for r in rows:
        if out and used + r[5] > budget:
            break
        out.append(r)
        used += r[5]
    return out, used


def k_means(rows, k):
    centres = [np.array(r[4]) for r in sorted(rows, key=lambda r: hashlib.md5(str(r[1]).encode()).hexdigest())[:k]]
    names = list(range(len(centres)))
    for turn in range(compress.ROUNDS + 1):
        own = {r[1]: names[int(np.argmin([np.round(c @ c - 2 * c @ np.array(r[4]), 9) for c in centres]))] for r in rows}
        if turn < compress.ROUNDS:
            names = sorted(set(own.values()))
            centres = [np.mean([r[4] for r in rows if own[r[1]] == n], axis=0) for n in names]
    return own


def test_first_rows_of_a_count_and_of_tokens(spark):
    df, rows = table(spark, random.Random(1), {"a": 700, "b": 3, "c": 40})
    for count in (0, 1, 7, 50):
        assert {r.id for r in compress.pruned(df, count=count).collect()} == {r[1] for x in by_scope(rows).values() for r in x[:count]}
    for tokens in (0, 5, 100, 900):
        assert {r.id for r in compress.pruned(df, tokens=tokens).collect()} == {r[1] for x in by_scope(rows).values() for r in until(x, tokens)[0]}
    for how in ({}, {"count": 1, "tokens": 1}):
        for arm in (compress.pruned, compress.clustered):
            with pytest.raises(ValueError):
                arm(df, **how)


def test_pairs_of_what_follows(spark):
    df, rows = table(spark, random.Random(2), {"a": 30, "b": 4, "c": 1, "d": 8})
    for count in (0, 1, 5, 10):
        keep, want = count // 2, set()
        for x in by_scope(rows).values():
            want |= {str(r[1]) for r in x[:keep]}
            after = x[keep : keep + 2 * (count - keep)]
            want |= {f"{a[1]}+{b[1]}" for a, b in zip(after[::2], after[1::2])}
        assert {r.id for r in compress.paired(df, count, dim=4).collect()} == want


def test_clusters_by_count(spark):
    df, rows = table(spark, random.Random(3), {"a": 120, "b": 9, "c": 10, "d": 2})
    made, links = compress.clustered(df, count=10)
    made, links = made.collect(), {(r.node_id, r.member_id) for r in links.collect()}
    want, members = set(), set()
    for scope, x in by_scope(rows).items():
        want |= {("kept", str(r[1])) for r in (x[:5] if len(x) >= 10 else x)}
        if len(x) >= 10:
            own = k_means(x[5:], 5)
            members |= {(f"{scope}/{c}", i) for i, c in own.items()}
            want |= {("summary", f"{scope}/{c}") for c in own.values()}
    assert {(r.kind, r.id) for r in made} == want and links == members
    vectors = {r[1]: np.array(r[4]) for r in rows}
    for r in made:
        if r.kind == "summary":
            assert np.allclose(r.embedding, np.mean([vectors[i] for n, i in links if n == r.id], axis=0))
    assert {r.id for r in compress.clustered(df, count=1)[0].collect()} == {str(x[0][1]) for x in by_scope(rows).values()}


def test_clusters_by_tokens_and_a_model(spark):
    df, rows = table(spark, random.Random(4), {"a": 300, "b": 30, "c": 3, "d": 1})
    budget = 900

    def factory():
        return lambda texts: f"{len(texts)} texts " + "word " * 150

    made, links = compress.clustered(df, tokens=budget, factory=factory)
    made, links = made.collect(), links.collect()
    for scope, x in by_scope(rows).items():
        kept, used = until(x, budget // 2)
        rest, want = x[len(kept) :], set()
        if len(rest) < 4:
            kept = kept + until(rest, budget - used)[0]
        else:
            own = k_means(rest, max(1, min(len(rest) // 2, (budget - used) // compress.SUMMARY_TOKENS)))
            names = sorted(set(own.values()))
            want = {f"{scope}/{c}" for c in names[: max(1, (budget - used) // 152)]}
        assert {r.id for r in made if r.scope == scope and r.kind == "kept"} == {str(r[1]) for r in kept}
        assert {r.id for r in made if r.scope == scope and r.kind == "summary"} == want == {r.node_id for r in links if r.node_id.startswith(scope)}
    texts = {r.id: r.content for r in made if r.kind == "summary"}
    assert all(texts[n].startswith(f"{min(compress.SHOWN, sum(r.node_id == n for r in links))} texts") for n in texts)


def test_nulls_and_empty_tables(spark):
    rows = [("a", i, 0.0, None, None if i % 2 else [1.0, float(i)], None) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert compress.pruned(df, tokens=0).count() == 12  # null tokens count 0
    made, links = compress.clustered(df, count=4)
    assert made.where("kind = 'kept'").count() == 2 and links.count() == 10
    for done in (compress.pruned(df.limit(0), count=3), compress.paired(df.limit(0), 4), *compress.clustered(df.limit(0), count=4), *compress.clustered(df.limit(0), tokens=400)):
        assert done.count() == 0
