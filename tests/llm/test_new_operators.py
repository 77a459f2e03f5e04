"""Operators 11 to 13 against brute force, SQL and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from memloom.llm import fim, licenses, periodic, queries

SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", "a", "é", "<", "<P", "<P>", "x <S> y", "ab" * 3000, "Ünïcode ß 漢字 \U0001f600 end", "a\x00b\tc\n", "<M", "1 2 3"]


def odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id here"), (None, None), (3, "a"), (3, "a")]
    return spark.createDataFrame(rows, SCHEMA)


def same_rows(ours, theirs):
    return sorted(map(repr, ours)) == sorted(map(repr, theirs))


# ---------------------------------------------------------------- fill in middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_units_one_by_one(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["ab", "C", " ", "é", "漢", "\U0001f600", "<", ">", "P", "\n", "9"]) for _ in range(rng.randrange(60)))) for k in range(300)]
    for docs in (spark.createDataFrame(rows, SCHEMA), odd_rows(spark)):
        made = fim.restored(fim.fill_in_middle(docs))
        ours, given = made.collect(), docs.collect()
        assert same_rows([tuple(r)[:6] for r in ours], [plain_fim(*r) for r in given])
        assert sorted(r.restored for r in ours) == sorted(r.text or "" for r in given)


def test_fim_places_every_unit():
    scan = fim.automaton()
    for text in ODD:
        units, text = fim.Units((text or "").encode(), scan), text or ""
        parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        assert units.n == len(parts)
        assert [units.place(k) for k in range(len(parts) + 1)] == [len("".join(parts[:k]).encode()) for k in range(len(parts) + 1)]


# ---------------------------------------------------------------- periodic runs


def plain_runs(words, least=24, periods=3):
    """Every stretch grown from every start for every period, kept where no shorter period holds."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, k, q) for (s, k), q in found.items())


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, runs, " ".join(w for i, w in enumerate(words) if i not in gone))


def periodic_texts():
    rng = random.Random(5)
    texts = list(ODD[:6]) + ["a " * n for n in (23, 24, 25, 400)]
    for _ in range(160):
        words = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 30))]
            words += unit * rng.choice((1, 1, 2, 3, 4, 9)) + unit[: rng.randrange(len(unit) + 1)] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
        texts.append(" \n".join(words))
    return texts


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.mark.parametrize("spread", [1 << 22, 0, 200])
def test_periodic_runs_equal_brute_force_however_lags_are_dealt(spark, spread):
    texts = periodic_texts()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (7, texts[7])], SCHEMA)
    ours = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs, spread=spread).collect()]
    assert same_rows(ours, [(i, *plain_row(split_words(t))) for i, t in docs.collect()])


def test_lag_ranges_hold_every_lag_once_and_split_scans_agree():
    for n in (24, 100, 1000, 5000):
        for most in (1, 50, 4 * n, 1 << 20):
            lags = [q for lo, hi in periodic.lag_ranges(n, most) for q in range(lo, hi)]
            assert lags == list(range(1, n // 3 + 1))
    ids = periodic.ids_of(("a b a b a c " * 40 + "q " * 90 + "a b c d e f g " * 30).encode().split())
    whole = periodic.scan(ids, 1, len(ids) // 3 + 1)
    parts = {r for lo, hi in periodic.lag_ranges(len(ids), 64) for r in periodic.scan(ids, lo, hi)}
    assert sorted(parts) == whole and len(whole) == 3


def test_planted_tails_follow_the_rule():
    words = [b"%d" % k for k in range(50)]
    for doc_id in (*range(60), None):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g = h // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        expected = [words[i] if h % 10 or i < a else words[a + (i - a) % p] for i in range(50)]
        assert periodic.planted_tail(doc_id, words) == expected
        assert periodic.planted_tail(doc_id, []) == []


def test_periodic_query_has_runs_on_every_planted_document(spark, sf):
    made = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("n_chars < 3000").limit(60).collect():
        n, *best, runs, text = plain_row([w.decode() for w in periodic.planted_tail(doc_id, [w.encode() for w in split_words(text)])])
        row = made[doc_id]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (n, *best)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_of_one_word_or_one_period_stay_cheap():
    ids = periodic.ids_of(b"a ".split() * 60_000)
    assert periodic.scan(ids, 1, 20_001) == [(0, 60_000, 1)]
    ids = periodic.ids_of(b"a b c d e f g h i j k".split() * 6_000)
    assert periodic.scan(ids, 1, len(ids) // 3 + 1) == [(0, 66_000, 11)]


# ---------------------------------------------------------------- licenses

LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by cc by CC-BY", "All rights reserved. all   RIGHTS\nreserved", "the GNU General Public License v2 or later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "http://www.apache.org/licenses/LICENSE-2.0", "MIT License", "mit", "under the terms of the GNU Lesser General Public License version 2.1",
    "É cc byé cc by", "license " * 300, "All rights" + " x" * 50 + " reserved", "BSD 3-Clause License or new BSD License; Copyright (c) 2020-2024", "Keep cc by", "Redistribution and use in source and binary forms, with or without modification, are permitted",
]


def plain_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    base = [(i, v) for p, v in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = []
    if set(words) & set(licenses.GATE):
        for n, r in enumerate(licenses.rules()):
            for i, w in enumerate(words):
                if w in r.first and (m := re.match(f"(?:{r.pattern}) ", " ".join(words[i : i + licenses.WINDOW]) + " ")):
                    found.append((i, i + m[0].count(" "), r.priority, n, r.label))
    kept = [d for d in found if not any(c[0] <= d[0] and c[1] >= d[1] and c[2] >= d[2] and (c[:2] != d[:2] or c[2] > d[2] or c[3] < d[3]) for c in found)]
    places = [i for i, _ in base]
    own = [licenses.STRENGTH[d[2]] for d in kept] + [licenses.STRENGTH[licenses.NAME]] * bool(base)
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({v for _, v in base})), ",".join(sorted({v for _, v in base} | {d[4] for d in kept})), max(own, default=0.0)


def test_licenses_equal_plain_rules(spark):
    rng = random.Random(9)
    pool = " ".join(LICENSE_TEXTS[:10] + LICENSE_TEXTS[13:]).split()
    texts = [*ODD, *LICENSE_TEXTS, *(" ".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(60))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (1, texts[1])], SCHEMA)
    ours = [tuple(r) for r in licenses.scan_licenses(docs).drop("detections").collect()]
    assert same_rows(ours, [(i, *plain_licenses(t)) for i, t in docs.collect()])


def test_contained_detections_go_and_higher_priorities_stay(spark):
    row = licenses.scan_licenses(spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0")], SCHEMA)).first()
    assert row.labels == "apache-2.0,unknown" and row.score == 0.95
    assert {(d.start, d.end, d.label) for d in row.detections} >= {(1, 8, "apache-2.0"), (3, 8, "apache-2.0"), (3, 5, "apache")}


def test_every_rule_can_match_within_the_window_and_begins_with_a_first_word():
    table = licenses.rules()
    assert len(table) > 300 and all(r.first and "(" not in re.sub(r"\(\?:", "", r.pattern) for r in table)
    assert all(r.pattern.count(" ") + 12 * ("{" in r.pattern) < licenses.WINDOW for r in table)


def test_license_plan_is_native(spark, sf):
    plan = queries.op13_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapElements|Exchange|Join", plan)


# ---------------------------------------------------------------- all three


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_license_scan"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, sf)
    assert sorted(ours.columns) == sorted(columns)
    assert same_rows([tuple(r) for r in ours.select(*columns).collect()], theirs.fetchall())


@pytest.mark.parametrize("operator", [fim.fill_in_middle, periodic.periodic_runs, licenses.scan_licenses])
def test_empty_tables_and_clashing_columns(spark, operator):
    clash = ["n", "form", "output", "key", "lo", "hi", "ids", "runs", "words", "found", "places", "base", "labels", "score", "parts"]
    plain = operator(odd_rows(spark))
    more = operator(odd_rows(spark).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)]))
    assert more.columns == plain.columns
    assert same_rows(more.collect(), plain.collect())
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
