"""Operators over whole tables: suffix dedup, classifiers, SimHash, line dedup, components, the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import components, ftrl, linededup, queries, simhash, suffixdedup, suffixes


def test_suffix_array_by_sorting():
    rng = random.Random(1)
    for _ in range(2000):
        x = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(256)), b"a"])
def test_repeated_windows_by_counting(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        size = rng.choice([3, 10, 30, 60])
        regions = [bytes(rng.choices(alphabet, k=rng.randint(size, 200))) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 6)):
            a = rng.choice(regions)
            i = rng.randrange(len(a))
            regions.append(bytes(rng.choices(alphabet, k=rng.randint(0, 60))) + a[i : rng.randrange(i, len(a) + 1)] + bytes(rng.choices(alphabet, k=rng.randint(0, 60))) + b"z" * size)
        counts = [rng.randint(1, len(r) - size + 1) for r in regions]
        times = Counter(r[q : q + size] for r, k in zip(regions, counts) for q in range(k))
        assert [x.tolist() for x in suffixes.repeated_windows(regions, counts, size)] == [[times[r[q : q + size]] > 1 for q in range(k)] for r, k in zip(regions, counts)]


def slow_dedup(texts):
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[q : q + 400] for b in raw for q in range(len(b) - 399))
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for q in range(len(b) - 399):
            if times[b[q : q + 400]] > 1:
                gone[q : q + 400] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        yield len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("most", [100, 2])
def test_suffix_dedup_of_odd_texts(spark, most):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(100) for _ in range(3)]
    texts = [None, "", "short", "a" * 1500, "ab" * 900, "x" * 399, "x" * 400, "same " * 200, "same " * 200]
    texts += [prose(rng.randint(0, 60)) + " " + rng.choice(shared)[: rng.randint(300, 700)] + prose(rng.randint(0, 60)) for _ in range(30)]
    copy = prose(300)
    texts += [copy, copy, copy[:700] + "!" + copy[701:], shared[0] * 3]
    ids = [None if n % 7 == 0 else n // 2 for n in range(len(texts))]  # ids repeat
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts)], "doc_id bigint, text string, anchor int, k1 string")
    rows = suffixdedup.suffix_dedup(docs, most).collect()
    assert all(r.has_repeat == (r.n_removed > 0) for r in rows)
    got = Counter(tuple(r)[:-1] for r in rows)
    assert got == Counter((i, *x) for i, x in zip(ids, slow_dedup(texts)))
    assert suffixdedup.suffix_dedup(docs.limit(0), most).count() == 0


def test_suffix_dedup_over_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in rows), slow_dedup([r.text for r in rows])))
    assert {r[0]: tuple(r)[1:-1] for r in queries.op2_suffix_dedup(spark, sf).collect()} == want


def test_ftrl_learns_words_and_forgets_noise():
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=60)) for _ in range(600)]
    labels = [n % 3 == 0 for n in range(600)]
    texts = [t + " vile" if y else t for t, y in zip(texts, labels)]
    model = ftrl.learn(texts[:500], labels[:500], ftrl.TOXIC_GRAMS, ftrl.TOXIC_RATES)
    scores = model.scores(texts[500:], ftrl.Words(), model.dense())
    assert ((scores >= 0.5) == np.array(labels[500:])).mean() > 0.95 and len(model.slots) < 3000
    assert 0 < model.scores([None], ftrl.Words(), model.dense())[0] == model.scores([""], ftrl.Words(), model.dense())[0] < 1


def check_fold(rows, truth, predicted_from, least):
    hits = [(r.score >= predicted_from) == (truth[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= predicted_from) for r in rows)
    assert sum(hits) >= least * len(hits)


def test_classifiers_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    check_fold(queries.op5_toxicity(spark, sf).collect(), {r.doc_id: r.toxic for r in labels}, 0.5, 0.85)
    check_fold(queries.op6_quality(spark, sf).collect(), {r.doc_id: r.quality for r in labels}, 0.3, 0.85)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "x", 0.2), (2, "good text", 0.3), (2, "good text", 0.3)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in ftrl.quality(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(2, 1, None), (2, 0, None), (None, 1, 1), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    assert ftrl.toxicity(docs, odd).count() == ftrl.quality(docs, odd).count() == 4
    assert ftrl.toxicity(docs.limit(0), odd).count() == 0


def slow_print(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, budget=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= budget):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def check_components(rows, ids, texts):
    prints = [slow_print(t) for t in texts]
    root = slow_components(prints)
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter(tuple(r) for r in rows) == Counter((i, f"{p:016x}", least.get(r)) for i, p, r in zip(ids, prints, root))


def test_simhash_over_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_components(queries.op7_simhash(spark, sf).collect(), [r.doc_id for r in rows], [r.text for r in rows])


def test_simhash_of_odd_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 50)}" for _ in range(400)]
    texts = [None, "", " \t", "A", "a", "a b", "a b c", "x\x0by\x0cz", "é É", "ſ K"]
    for _ in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"n{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    ids = [None if n % 9 == 0 else 1000 - n for n in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 7, "r") for i, t in zip(ids, texts)], "doc_id bigint, text string, fp int, root string")
    check_components(simhash.near_duplicates(docs).collect(), ids, texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def slow_grams(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def slow_text_groups(texts):
    """The group number of each text: equal sets, and sets with a Jaccard similarity of 0.8 or more, by way of others too."""
    sets = [slow_grams(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for g in s or {()}:
            holders.setdefault(g, []).append(k)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(texts))]


def smallest_of_groups(ids, texts):
    out = {}
    for g, i in zip(slow_text_groups(texts), ids):
        out.setdefault(g, []).append((i is None, i or 0))
    return sorted(((not none) * i, none) for none, i in map(min, out.values()))


@pytest.mark.parametrize("meet", [1024, 4])
def test_one_of_each_near_copy_group(spark, meet):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(400))
    texts = [None, "", " \t", "a", "A", "b", "a b c d e", "a b c d e f", "x " * 50, "x " * 9]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    ids = [None if n % 13 == 0 else 5000 - n for n in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 7, "r") for i, t in zip(ids, texts)] * 2, "doc_id bigint, text string, rid int, id string")
    stay = simhash.one_of_each(docs, meet)
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.doc_id is None) for r in stay.collect()) == smallest_of_groups(ids, texts)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_over_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    every = rows.collect()
    want = smallest_of_groups([r.doc_id for r in every], [r.text for r in every])
    assert sorted((r.doc_id, False) for r in simhash.one_of_each(rows).collect()) == want


def test_long_texts_with_one_word_changed_are_near_copies(spark):
    """Their fingerprints are often equal though the sets differ."""
    rng = random.Random(12)
    rows = []
    for k in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        rows.append((2 * k, " ".join(words)))
        words[rng.randrange(4000)] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    prints = [simhash.majority(simhash.grams_of(t)) for _, t in rows]
    assert any(a == b for a, b in zip(prints[::2], prints[1::2]))
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == list(range(0, 100, 2))


@pytest.mark.parametrize(("meet", "rounds"), [(16, 0), (16, 1), (40, 4), (1000, 4)])
def test_every_pair_of_a_large_key_is_settled(spark, meet, rounds):
    """Chains of sets, each similar to the next but not to the one after it, beside groups that are far off, under one key."""
    rng = np.random.default_rng(6)
    sets = []
    for base in range(4):
        for k in range(60):
            lo = base * 100_000 + 9 * k if base < 2 else base * 100_000
            x = np.arange(lo, lo + 100, dtype=np.uint64)
            if base >= 2:
                x[rng.choice(100, 7, replace=False)] += np.uint64(50_000 + 100 * k)
            sets.append(np.unique(x))
    n = len(sets)
    i, j = np.triu_indices(n, 1)
    near = np.array([simhash.similar(sets[a], sets[b]) for a, b in zip(i, j)])
    want = simhash.forest(n, i[near], j[near])
    dealt = spark.createDataFrame([(7, k, len(x)) for k, x in enumerate(sets)], "key bigint, rid bigint, n bigint")
    grams = spark.createDataFrame([(k, int(rng.integers(8)), bytearray(x.tobytes())) for k, x in enumerate(sets)], "rid bigint, fp bigint, grams binary")
    known, met = simhash.blocks(dealt, grams, meet, rounds)
    compared = met.join(grams, "rid").select("key", "tied", "fp", "rid", "grams").repartition("key").sortWithinPartitions("key").mapInArrow(simhash._compare, "u bigint, v bigint")
    links = np.array([tuple(r) for r in known.union(compared).collect()], dtype=np.int64).reshape(-1, 2)
    assert all(simhash.similar(sets[a], sets[b]) for a, b in links)
    assert (simhash.forest(n, links[:, 0], links[:, 1]) == want).all() and 4 <= len(set(want.tolist())) < 100


def test_equal_values_pair_in_the_trie():
    rng = random.Random(2)
    values = sorted(rng.choice([5, 5, 7, 1 << 63, (1 << 63) + 3, rng.getrandbits(64)]) for _ in range(80))
    i, j = simhash.trie_pairs(np.zeros(80, np.int64), np.array(values, dtype=np.uint64))
    assert sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())) == [(a, b) for a in range(80) for b in range(a + 1, 80) if (values[a] ^ values[b]).bit_count() <= 3]


@pytest.mark.parametrize("most", [2048, 3])
def test_trie_join_finds_all_links(spark, most):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp bigint")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.near_links(table, most)).collect()}
    want = slow_components(prints)
    groups = lambda label: Counter(frozenset(p for p in prints if label(p) == k) for k in {label(p) for p in prints})
    at = {p: r for p, r in zip(prints, want)}
    assert groups(lambda p: found.get(p, p)) == groups(lambda p: at[p])


def test_components_of_paths_and_stars(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (7, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {n: 0 for n in range(41)} | {n: 100 for n in range(100, 130)}


def long_line(n):
    return f"this is a line of more than forty characters, number {n}"


def slow_chain(points):
    """Of (b, a) in order, the longest chain rising in a; of several the one of least, latest ends."""
    size = []
    for n, (_, a) in enumerate(points):
        size.append(1 + max((size[m] for m in range(n) if points[m][1] < a), default=0))
    out, n = [], len(points)
    for k in range(max(size, default=0), 0, -1):
        n = min((m for m in range(n) if size[m] == k), key=lambda m: (points[m][1], -m))
        out.append(points[n])
    return out[::-1]


def slow_patience(runs):
    runs = sorted(runs, key=lambda r: (r[0], -r[1]))
    chain = slow_chain([(b, a) for b, a, once in runs if once])
    edges = [(-1, -1), *chain, (math.inf, math.inf)]
    held = set(chain)
    for (b0, a0), (b1, a1) in zip(edges, edges[1:]):
        held |= set(slow_chain([(b, a) for b, a, _ in runs if b0 < b < b1 and a0 < a < a1]))
    return dict(held)


def test_patience_by_hand():
    once = lambda *pairs: [(b, a, True) for b, a in pairs]
    assert linededup.patience(once((1, 1), (2, 2))) == {1: 1, 2: 2}
    assert linededup.patience(once((0, 2), (1, 0), (2, 1))) == {1: 0, 2: 1}
    assert linededup.patience([(0, 0, True), (1, 5, False), (2, 9, True), (3, 5, False)]) == {0: 0, 1: 5, 2: 9}
    assert linededup.patience([]) == {}
    rng = random.Random(5)
    for _ in range(1000):
        runs = list({(rng.randint(0, 9), rng.randint(0, 9)): rng.random() < 0.6 for _ in range(rng.randint(0, 14))}.items())
        runs = [(b, a, once) for (b, a), once in runs]
        held = linededup.patience(runs)
        assert held == slow_patience(runs)
        at = [held[b] for b in sorted(held)]
        assert at == sorted(set(at))


def test_line_dedup_takes_blocks_from_the_later_document(spark):
    rows = [
        (1, "\n".join([long_line(1), "short", long_line(2), long_line(3)])),
        (2, "\n".join(["own words come first in this second document, yes", long_line(2), long_line(3), "tail"])),
        (3, "\n".join([long_line(3), long_line(1), "short", long_line(2)])),  # line 3 moved: it stays
        (4, "nothing shared here but a text of its own, quite long enough"),
        (None, long_line(1)), (5, None), (5, ""), (6, "short"), (7, "short"),
    ]
    docs = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id bigint, text string, n_chars int, parts string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in linededup.line_dedup(docs).where("doc_id <> 5").collect()}
    assert got == {1: (4, 0, []), 2: (4, 2, [1, 2]), 3: (4, 3, [1, 2, 3]), 4: (1, 0, []), 6: (1, 0, []), 7: (1, 0, [])}
    kept = linededup.without_common_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id == 2} == {2: "own words come first in this second document, yes\ntail"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "5", "6", "7"]
    assert linededup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_over_the_whole_table(spark, sf):
    """Only lines that an earlier document has go, and of those 0.9 or more."""
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    seen, want = set(), {}
    for r in rows:
        lines = [x.strip(" ") for x in r.text.split("\n")]
        want[r.doc_id] = {n for n, x in enumerate(lines) if len(x) >= linededup.LEAST_CHARS and x in seen}
        seen |= set(lines)
    got = {r.doc_id: set(map(int, r.removed.split(","))) if r.removed else set() for r in queries.op9_line_dedup(spark, sf).collect()}
    telling = {r.doc_id: {n for n, x in enumerate(r.text.split("\n")) if len(x.strip(" ")) >= linededup.LEAST_CHARS} for r in rows}
    assert sum(len(w) for w in want.values()) > 0
    # a line that a document repeats aligns as often as the earlier document has it
    assert all(got[d] & telling[d] <= want[d] for d in want)
    assert sum(len(got[d] & telling[d]) for d in want) >= 0.9 * sum(map(len, want.values()))


def test_pipeline_stages_keep_clean_documents_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = out, stage(spark, out, sf)
        out = out.checkpoint()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0.6 * before.count() <= out.count() <= before.count(), name
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in out.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf).checkpoint()
    assert empty.count() == 0


def slow_gone(docs):
    """For each (id, text), in order of id: the places of the lines that its alignments with first documents hold, with up to two empty lines between."""
    firsts, out = {}, {}
    for i, text in sorted(docs):
        plain = [x.strip(" ") for x in text.split("\n")]
        runs = set()  # from each line of weight to the shortest end, and back from each
        for k in (k for k, x in enumerate(plain) if x):
            e = next((e for e in range(k + 1, len(plain) + 1) if sum(map(len, plain[k:e])) >= linededup.LEAST_CHARS), None)
            s = next((s for s in range(k, -1, -1) if sum(map(len, plain[s : k + 1])) >= linededup.LEAST_CHARS), None)
            runs |= {(k, e)} if e is not None else set()
            runs |= {(s, k + 1)} if s is not None else set()
        own, links = {}, {}
        for s, e in sorted(runs):
            own.setdefault(tuple(plain[s:e]), []).append((s, e))
        met = [(run, firsts[run], places) for run, places in own.items() if run in firsts]
        for _, (first, there), places in met:
            for (s, _), a in zip(places, there):
                links.setdefault(first, {})[s, a] = len(there) == len(places) == 1 or links.get(first, {}).get((s, a), False)
        held = {first: slow_patience([(b, a, once) for (b, a), once in x.items()]) for first, x in links.items()}
        gone = sorted({k for _, (first, there), places in met for (s, e), a in zip(places, there) if held[first].get(s) == a for k in range(s, e)})
        for a, b in zip(gone, gone[1:]):
            if 1 < b - a <= 3 and not any(plain[a + 1 : b]):
                gone = sorted({*gone, *range(a + 1, b)})
        out[i] = gone
        for run, places in own.items():
            firsts.setdefault(run, (i, [s for s, _ in places]))
    return out


def removed_places(df):
    return {r.doc_id: r.removed for r in df.collect()}


def test_the_alignment_decides(spark):
    """A moved block and a further repeat have an equal in the first document and stay: their hashes alone would take them."""
    a, b, c, d = map(long_line, range(4))
    rows = [(1, [a, b, c, d]), (2, [c, "x", a, b, d]), (3, [d, c, b, a]), (4, [a, a, b]), (5, ["y", b, "z", a])]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id bigint, text string")
    want = {1: [], 2: [2, 3, 4], 3: [3], 4: [0, 2], 5: [3]}
    assert removed_places(linededup.line_dedup(docs)) == want == slow_gone([(i, "\n".join(x)) for i, x in rows])


def test_random_lines_by_a_plain_twin(spark):
    rng = random.Random(11)
    kinds = ["", "", "a", "twelve chars", "fifteen letters", "twenty-five characters or", long_line(1), long_line(2), long_line(3)]
    rows = [(i, "\n".join(rng.choice(kinds[rng.choice([0, 3, 6]) :]) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert removed_places(linededup.line_dedup(docs)) == slow_gone(rows)
    pairs = [(2 * k + n, x) for k in range(300) for n, x in enumerate([rows[2 * k][1].replace("n", str(k)), rows[2 * k + 1][1].replace("n", str(k))])]  # few documents share a line
    assert removed_places(linededup.line_dedup(spark.createDataFrame(pairs, "doc_id bigint, text string"))) == slow_gone(pairs)


def test_long_alignments_stay_cheap():
    def gone(first, later):
        there, here = (linededup.placed_runs(x, [50] * len(x)) for x in (first, later))
        return linededup.gone_spans([(1, [p >> 32 for p in there[h]], len(there[h]) == len(places) == 1, places) for h, places in here.items() if h in there])

    began = time.perf_counter()
    n = 20_000
    assert gone(list(range(n)), list(range(n))[::-1]) == ([n - 1, n], 1)
    assert gone(list(range(n)), list(range(n))) == ([0, n], n)
    assert gone([1] * n, [1] * n) == ([0, n], n)
    assert time.perf_counter() - began < 20


def test_line_dedup_equals_the_plain_twin_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: list(map(int, r.removed.split(","))) if r.removed else [] for r in queries.op9_line_dedup(spark, sf).collect()}
    assert got == slow_gone(rows) and any(got.values())


def test_blocks_of_short_lines_go(spark):
    verse = "roses are red\nviolets are blue\nsugar is sweet"
    docs = spark.createDataFrame([(1, verse), (2, verse), (3, "own\n" + verse + "\nend"), (4, "roses are red\nviolets are blue"), (5, None)], "doc_id bigint, text string")
    assert removed_places(linededup.line_dedup(docs)) == {1: [], 2: [0, 1, 2], 3: [1, 2, 3], 4: [], 5: []}


def test_many_rows_of_one_text_and_no_id(spark):
    """Rows of one id and text give their regions and spans once, however many they are."""
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400))
    other = text[:900] + "".join(rng.choices("ijklmnop", k=900))
    docs = spark.createDataFrame([(None, text)] * 1000 + [(7, other)], "doc_id bigint, text string")
    spans = suffixdedup.repeated_spans(docs).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    assert max(len(r.spans) for r in spans.collect()) < 100
    got = suffixdedup.suffix_dedup(docs).groupBy("doc_id", "n_removed", "has_repeat").count().collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.has_repeat, r["count"]) for r in got) == [(0, len(text), 1, 1000), (7, 900, 1, 1)]


# ---------------------------------------------------------------- plain twins of the classifiers and of the pipeline

WRAP = (1 << 64) - 1
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def slow_features(text, grams):
    """Each feature's slot, once, and the value that each has: word by word, without arrays."""
    words = [zlib.crc32(w.encode()) + 1 for w in re.findall(grams.token, (text or "").lower() if grams.lower else text or "")]
    out = [w * ODD[0] & WRAP for w in words]
    for n in range(2, grams.longest + 1):
        for k in range(len(words) - n + 1):
            run = words[k]
            for w in words[k + 1 : k + n]:
                run = run * ODD[1] + w * ODD[2] & WRAP
            out.append(n if len(set(words[k : k + n])) == 1 else run)
    for gap in range(2, grams.skip + 2):
        out += [words[k] * ODD[1] + words[k + gap] * ODD[3] + 1 & WRAP for k in range(len(words) - gap)]
    slots = {((x ^ x >> 32) * ODD[0] & WRAP) >> 64 - grams.bits for x in out}
    return sorted(slots), 1 / max(1, len(out)) ** 0.25


def slow_ftrl(rows, grams, rates):
    """Weights by slot, and the bias, of follow-the-regularised-leader row by row and coordinate by coordinate."""
    z, n = {}, {}
    bias_z = bias_n = 0.0

    def weight(k):
        if abs(z.get(k, 0.0)) <= rates.l1:
            return 0.0
        return -(z[k] - math.copysign(rates.l1, z[k])) / ((rates.beta + math.sqrt(n[k])) / rates.alpha + rates.l2)

    for _ in range(rates.passes):
        for (slots, value), y in rows:
            own = [weight(k) for k in slots]
            bias = -bias_z / ((rates.beta + math.sqrt(bias_n)) / rates.alpha)
            miss = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(own) * value)))) - y
            for k, w in zip(slots, own):
                g, before = miss * value, n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / rates.alpha * w
            after = bias_n + miss * miss
            bias_z += miss - (math.sqrt(after) - math.sqrt(bias_n)) / rates.alpha * bias
            bias_n = after
    return {k: w for k in z if (w := weight(k))}, -bias_z / ((rates.beta + math.sqrt(bias_n)) / rates.alpha)


def slow_scores(texts, labels, learned_from, grams, rates):
    """The score of every text by a model of the labelled rows outside the held-out fold. texts, labels: by id."""
    order = sorted((i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5), key=lambda i: (zlib.crc32(str(i).encode()), i))
    assert len(order) <= learned_from
    weights, bias = slow_ftrl([(slow_features(texts[i], grams), labels[i]) for i in order], grams, rates)
    out = {}
    for i, t in texts.items():
        slots, value = slow_features(t, grams)
        out[i] = 1 / (1 + math.exp(-max(-35, min(35, bias + value * sum(weights.get(k, 0.0) for k in slots)))))
    return out


@pytest.mark.parametrize("query, label, grams, rates", [("op5_toxicity", "toxic", ftrl.TOXIC_GRAMS, ftrl.TOXIC_RATES), ("op6_quality", "quality", ftrl.QUALITY_GRAMS, ftrl.QUALITY_RATES)])
def test_classifier_queries_by_a_plain_twin(spark, sf, query, label, grams, rates):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = slow_scores(texts, labels, ftrl.SAMPLE_ROWS, grams, rates)
    got = {r.doc_id: r.score for r in queries.QUERIES[query](spark, sf).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def slow_line_stage(docs):
    """(id, text) after the lines of ``slow_gone`` went; what is left without text goes."""
    out, places = [], slow_gone(docs)
    for i, text in sorted(docs):
        lines, gone = text.split("\n"), set(places[i])
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone:
            out.append((i, text))
        elif left.replace("\n", "").replace("\r", "").replace("\t", "").strip(" "):
            out.append((i, left))
    return out


def slow_leak(words, item):
    """The least number of word edits between the item and any stretch of the words: the whole table of the alignment."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (w != x)))
        row = new
        best = min(best, row[-1])
    return best


def test_the_pipeline_stage_by_stage_by_plain_twins(spark, sf):
    import base64

    import public_tokenizers
    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = slow_scores(docs, labels, ftrl.SAMPLE_ROWS, ftrl.QUALITY_GRAMS, ftrl.QUALITY_RATES)
    assert all(abs(x - ftrl.QUALITY_FROM) > 1e-6 for x in scores.values())
    kept = slow_line_stage([(i, t) for i, t in docs.items() if scores[i] >= ftrl.QUALITY_FROM])
    groups = slow_text_groups([t for _, t in kept])
    first = {}
    for g, (i, t) in zip(groups, kept):
        first[g] = min(first.get(g, (i, t)), (i, t))
    word = re.compile(r"\w+")
    items = [word.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {}
    for i, t in first.values():
        words = word.findall(t.lower())
        held = set(words)
        # an item within a fifth of its words in edits has four fifths of them in the text
        if not any(m and sum(w in held for w in m) >= 0.8 * len(m) - 1e-9 and slow_leak(words, m) <= int(0.2 * len(m) + 1e-9) for m in items):
            clean[i] = t
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) as f:
        ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in f if x.strip()}
    codec = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(",".join(map(str, codec.encode_ordinary(t))).encode()).hexdigest() for i, t in clean.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == len(want) and {r.doc_id: r.ids_sha256 for r in rows} == want
