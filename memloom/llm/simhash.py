"""Operator 7, SimHash near-duplicates: a binary trie self-join over 64-bit fingerprints.

A document's fingerprint has a bit where over half of its word shingles' XXH64 hashes (seed 42) have it. Fingerprints
that differ in at most ``BUDGET`` bits link; components are the transitive closure.

``near_duplicates`` is the query's form; ``one_of_each``, the pipeline's, joins fingerprints of five-word shingles under a
wider budget and lets the shingle sets decide.

The distinct fingerprints are dealt out by one of BUDGET+1 blocks of bits: two that differ in at most BUDGET bits agree
in one block at least. A key that more than ``MOST`` fingerprints share (near copies of one text) is dealt again by the
blocks of the bits that it leaves, so that no task ever holds an unbounded group. Within a key, a trie over the sorted
fingerprints is joined with itself: node pairs descend together, differing bits add up, and a pair over the budget is
dropped. Only a spanning forest leaves the task, at most one link a fingerprint.

Defined results: a text without words (null and empty texts too) has fingerprint 0, which links like any other. Repeated
rows give repeated results; a row with a null id keeps it and takes the component of its fingerprint (null if no row of
the component has an id). An empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, loose, map_batches, remove, small_batches, written
from .components import components

WORDS, BUDGET, BITS = 3, 3, 64
#: Fingerprints that may share a key before it is dealt again.
MOST = 2048
#: Rows that a task joins at a time, at least one whole key.
CHUNK = 16_384
#: In place of a null id, after all others.
LAST_ID = (1 << 63) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, and the white space 9-13 and 32
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def work(batch: dict) -> dict:
        return {"doc_id": batch["doc_id"], "fp": np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64).view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, fp bigint")


def trie_pairs(group: np.ndarray, value: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group's values that differ in at most ``budget`` bits; the rows are sorted by (group, value).

    A node of a group's trie is a range of its sorted values that share their leading bits. All node pairs of a depth
    are held as arrays and descend together; a pair of single values is settled by one population count. Ranges that are
    left below the last bit hold equal values: all their pairs count.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, np.int64)
    lo, hi = bounds[:-1], bounds[1:]
    own = hi - lo > 1
    # node pairs: [a, b) with [c, d) and the bits they differ in so far; the same range twice stands for a node with itself
    a, b, c, d, err = lo[own], hi[own], lo[own], hi[own], np.zeros(own.sum(), np.int8)
    for bit in range(BITS - 1, -1, -1):
        if not len(a):
            break
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        s, t = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        other = ~same
        parts = [
            (a, s, c, t, err), (s, b, t, d, err),  # 0 with 0, 1 with 1
            (a, s, t, d, err + 1),  # 0 with 1
            (s[other], b[other], c[other], t[other], err[other] + 1),  # 1 with 0, once for a node with itself
        ]
        a, b, c, d, err = (np.concatenate(x) for x in zip(*parts))
        keep = (b > a) & (d > c) & (err <= budget) & ~((a == c) & (b - a < 2))
        a, b, c, d, err = a[keep], b[keep], c[keep], d[keep], err[keep]
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            found.append((i[near], j[near]))
            rest = ~single
            a, b, c, d, err = a[rest], b[rest], c[rest], d[rest], err[rest]
    for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
        i, j = np.triu_indices(x - w, 1) if w == y else np.indices((x - w, z - y)).reshape(2, -1)
        found.append((i + w, j + y))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[i], root[j]
        live = x != y
        if not live.any():
            return root
        i, j, x, y = i[live], j[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are joined, ``CHUNK`` rows or one key at a time."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp.view(np.uint64)
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        i, j = trie_pairs(key, value)
        root = forest(len(value), i, j)
        child = np.flatnonzero(root != np.arange(len(value)))
        out = value.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[child]), pa.array(out[root[child]])], names=["u", "v"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy()))
        if len(keys) >= CHUNK:
            whole = np.searchsorted(keys, keys[-1])
            if whole:
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield links(keys, fps)


def _blocks(bits: list[int]) -> list[list[int]]:
    """The bits in BUDGET + 1 blocks of like size."""
    edges = [n * len(bits) // (BUDGET + 1) for n in range(BUDGET + 2)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _dealt(rows: DataFrame, left: list[list[int]]) -> DataFrame:
    """Rows (key, fp, path) once for each block; ``path`` numbers the way of blocks, ``left`` has the bits that each way leaves."""
    keys = []
    for path, bits in enumerate(left):
        for n, block in enumerate(_blocks(bits)):
            mask = sum(1 << b for b in block)
            mask -= (mask >> 63) << 64  # as a signed long
            cut = F.struct(F.xxhash64(F.col("key"), F.lit(n), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))).alias("key"), F.col("fp"), F.lit(path * (BUDGET + 1) + n).alias("path"))
            keys.append(F.when(F.col("path") == path, cut))
    return rows.select(F.explode(F.array_compact(F.array(*keys))).alias("x")).select("x.*")


def _left(left: list[list[int]]) -> list[list[int]]:
    """The bits that each way leaves, one block further."""
    return [[b for b in bits if b not in block] for bits in left for block in _blocks(bits)]


def near_links(prints: DataFrame, most: int = MOST, levels: int = 5) -> DataFrame:
    """u, v: a spanning forest of the links between the distinct values of ``prints.fp``.

    The last level's keys leave 16 bits at most, so no key holds more than 65,536 fingerprints, whatever the table's size.
    """
    left = [list(range(BITS))]
    rows = prints.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("path"))
    cold = []
    for level in range(levels):
        rows, left = _dealt(rows, left), _left(left)
        if level == levels - 1:
            cold.append(rows)
            break
        hot = checkpointed(rows.groupBy("key").count().where(F.col("count") > most).select("key"))
        if hot.isEmpty():
            cold.append(rows)
            break
        hot = loose(hot, "key")
        cold.append(rows.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi")
    small_batches(prints.sparkSession)
    every = cold[0]
    for x in cold[1:]:
        every = every.unionByName(x)
    return every.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_join, "u bigint, v bigint")


def _components(rows: DataFrame) -> DataFrame:
    """fp, root, component_id of each distinct value of ``rows.fp``."""
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(prints))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = loose(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return loose(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(fingerprints(docs, words))
    return rows.join(_components(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies of texts, for the pipeline

#: Words of a shingle, least Jaccard similarity of the shingle sets, and bits that two fingerprints of such texts differ in at most.
TEXT_WORDS, SIMILARITY, TEXT_BUDGET = 5, 0.8, 24
#: Keys of a text, each of so many least hashes: at a similarity of 0.8 two texts share one key of 16 in 0.9998 of all cases.
KEYS, ROWS = 16, 4
#: Texts, and hashes of their shingles, that a task compares with each other at a time.
MEET, MEET_GRAMS = 256, 8 << 20
#: Rounds in which a large key's texts are held against a leader before the rest are compared block by block.
ROUNDS = 4
#: Classes whose ids are broadcast to fetch their texts; beyond that they are joined by a shuffle.
MOST_WANTED = 1_000_000
_SALT = np.random.default_rng(7).integers(1, 1 << 63, (2, KEYS * ROWS), dtype=np.uint64) | np.uint64(1)


def grams_of(text: str | None, words: int = TEXT_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a shorter text is one shingle, and one without words has none."""
    parts = (text or "").encode().lower().split()
    hash_of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hash_of(b" ".join(parts), 42)] if parts else [], dtype=np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([hash_of(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 65_536):
        ones += np.unpackbits(np.ascontiguousarray(h[lo : lo + 65_536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def least_hashes(h: np.ndarray) -> np.ndarray:
    """KEYS hashes, each of ROWS of the least hashes of the set under as many orders."""
    least = np.full(KEYS * ROWS, ~np.uint64(0))
    for lo in range(0, len(h), 8192):
        x = h[lo : lo + 8192, None] * _SALT[0]
        np.minimum(least, ((x ^ (x >> np.uint64(31))) * _SALT[1]).min(axis=0), out=least)
    rows = least.reshape(KEYS, ROWS)
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _class(h: np.ndarray) -> int:
    """Tells a shingle set."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _signatures(batch: dict) -> dict:
    sets = [grams_of(t) for t in batch["text"]]
    return {"id": batch["id"], "version": batch["version"], "rid": [_class(h) for h in sets], "n": [len(h) for h in sets], "keys": [least_hashes(h) for h in sets]}


def _grams(batch: dict) -> dict:
    sets = [grams_of(t) for t in batch["text"]]
    fps = np.array([majority(h) for h in sets], dtype=np.uint64).view(np.int64)
    return {"rid": [_class(h) for h in sets], "fp": fps, "grams": [h.tobytes() for h in sets]}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets (sorted, distinct); two empty ones are the same."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is ``least`` or more; sizes too far apart settle it."""
    return min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 and jaccard(a, b) >= least - 1e-9


def verified(key: np.ndarray, fp: np.ndarray, grams: list[np.ndarray], tied: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of similar texts of one key that connect all that can be connected; the rows are sorted by (key, fp).

    The trie join's pairs come first, nearest fingerprints first: they connect nearly all. Whatever pairs of a key are
    still apart are then compared too, so no budget of bits decides. ``tied`` rows of a key are connected beforehand.
    """
    i, j = trie_pairs(key, fp, TEXT_BUDGET)
    root = list(range(len(fp)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist() if len(key) else []
    if tied is not None:
        for lo, hi in zip(bounds, bounds[1:]):
            own = lo + np.flatnonzero(tied[lo:hi])
            for x in own.tolist():
                root[x] = int(own[0])
    found = []

    def compare(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y and similar(grams[a], grams[b]):
            root[max(x, y)] = min(x, y)
            found.append((a, b))

    order = np.argsort(np.bitwise_count(fp[i] ^ fp[j]), kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        compare(a, b)
    for lo, hi in zip(bounds, bounds[1:]):
        if len({top(x) for x in range(lo, hi)}) > 1:
            by_size = sorted(range(lo, hi), key=lambda x: len(grams[x]))
            for k, a in enumerate(by_size):
                for b in by_size[k + 1 :]:
                    if len(grams[a]) < SIMILARITY * len(grams[b]) - 1e-9:
                        break  # all further ones are larger still
                    compare(a, b)
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tied, fp, rid, grams) come sorted by key; whole keys are compared, about MEET rows or one key at a time."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        key, fp = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
        order = np.lexsort((fp, key))
        grams = [np.frombuffer(rows[k][4], dtype=np.uint64) for k in order.tolist()]
        pairs = verified(key[order], fp[order], grams, np.array([rows[k][1] for k in order.tolist()]))
        u, v = ([rows[order[p[side]]][3] for p in pairs] for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[-1][0] and (len(rows) >= MEET or size >= MEET_GRAMS):
                yield links(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4]) // 8
    if rows:
        yield links(rows)


def _apart(batch: dict) -> dict:
    """Jaccard distances to the keys' leaders."""
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in batch[c]] for c in ("grams", "lead")]
    return {c: batch[c] for c in ("key", "rid", "n", "leader")} | {"apart": [1 - jaccard(a, b) for a, b in zip(*sets)]}


def _parts(size: F.Column, n: F.Column, meet: int) -> F.Column:
    """The parts of like size that some texts are cut into, so that two parts can meet in a task."""
    return F.greatest(F.ceil(size / max(meet // 2, 1)), F.ceil(n / (MEET_GRAMS // 2)), F.lit(1)).cast("int")


def _small(meet: int) -> F.Column:
    return (F.col("size") <= meet) & (F.col("total") <= MEET_GRAMS)


def _sized(rows: DataFrame) -> DataFrame:
    """Keys of two texts or more: key, size, total (of the texts' hashes)."""
    return rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")


def blocks(dealt: DataFrame, grams: DataFrame, meet: int = MEET, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """dealt: key, rid, n. Links (u, v) that are known, and blocks (key, tied, rid) of texts that are to be compared in whole; together they settle every pair of every key.

    A small key is one block. A large key's texts are held against one of them, its leader: those within 0.2 (in
    Jaccard distance, a metric) are linked by it. A text within 0.4 may still be similar to some of these, no nearer to
    the leader than its own distance less 0.2; both meet in blocks of parts. One that is further off can't be. What is not
    linked goes on without the rest, under another leader; after ``rounds`` of them, in blocks of all pairs of parts.
    """
    links, met, near = [], [], 1 - SIMILARITY
    block = lambda *parts: F.xxhash64("key", *[F.lit(x) if isinstance(x, (str, int)) else x for x in parts])
    part = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    rest = dealt
    for k in range(rounds + 1):
        now = checkpointed(rest.join(loose(_sized(rest), "key"), "key"))
        met.append(now.where(_small(meet)).select(block("whole", k).alias("key"), F.lit(False).alias("tied"), "rid"))
        rest = now.where(~_small(meet))
        if rest.isEmpty():
            break
        if k == rounds:
            cut = rest.withColumn("parts", _parts(F.col("size"), F.col("total"), meet)).withColumn("own", part(F.col("parts")))
            pairs = cut.select("key", "rid", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            met.append(pairs.select(block("all", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.lit(False).alias("tied"), "rid"))
            break
        leaders = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("rid", F.lit(k)), "rid"))["rid"].alias("rid"))
        lead = leaders.join(loose(grams.select("rid", "grams"), "rid"), "rid").select("key", F.col("rid").alias("leader"), F.col("grams").alias("lead"))
        held = rest.select("key", "rid", "n").join(loose(grams.select("rid", "grams"), "rid"), "rid").join(loose(lead, "key"), "key")
        far = checkpointed(map_batches(held.select("key", "rid", "n", "leader", "grams", "lead"), _apart, "key bigint, rid bigint, n bigint, leader bigint, apart double"))
        linked = F.col("apart") <= near + 1e-9
        links.append(far.where(linked & (F.col("rid") != F.col("leader"))).select(F.col("rid").alias("u"), F.col("leader").alias("v")))
        ring = far.where(~linked & (F.col("apart") <= 2 * near + 1e-9))
        rings = ring.groupBy("key").agg(F.min("apart").alias("nearest"), F.count("*").alias("ring_size"), F.sum("n").alias("ring_total"))
        close = far.where(linked).join(loose(rings, "key"), "key").where(F.col("apart") >= F.col("nearest") - near - 1e-9)
        sides = close.groupBy("key", "ring_size", "ring_total").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
        sides = checkpointed(sides.select("key", _parts(F.col("size"), F.col("total"), meet).alias("a"), _parts(F.col("ring_size"), F.col("ring_total"), meet).alias("b")))
        if not sides.isEmpty():
            to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
            one = close.select("key", "rid").join(loose(sides, "key"), "key").select("key", "rid", part(F.col("a")).alias("own"), to_all("b")).select(block("ring", k, F.col("own"), F.col("other")), F.lit(True), "rid")
            two = ring.select("key", "rid").join(loose(sides, "key"), "key").select("key", "rid", part(F.col("b")).alias("own"), to_all("a")).select(block("ring", k, F.col("other"), F.col("own")), F.lit(False), "rid")
            met.append(one.union(two).toDF("key", "tied", "rid"))
        rest = far.where(~linked).select("key", "rid", "n")
    every = met[0]
    for x in met[1:]:
        every = every.union(x)
    known = dealt.sparkSession.createDataFrame([], "u bigint, v bigint")
    for x in links:
        known = known.union(x)
    return known, every


def text_components(rows: DataFrame, signed: DataFrame, meet: int = MEET) -> DataFrame:
    """rid, root of each class of equal shingle sets; classes whose texts are similar have one root. rows: id, version, text; signed: id, version, rid, n, keys."""
    spark = rows.sparkSession
    classes = checkpointed(signed.groupBy("rid").agg(F.min(F.struct("id", "version")).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    dealt = classes.select("rid", "n", F.posexplode("keys").alias("pos", "own")).select(F.xxhash64("pos", "own").alias("key"), "rid", "n")
    dealt = checkpointed(dealt.join(loose(_sized(dealt).select("key"), "key"), "key"))
    # one text of each class that meets another is fetched
    wanted = checkpointed(dealt.select("rid").distinct().join(classes, "rid").select("one.id", "one.version"))
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= MOST_WANTED else loose(wanted, "id", "version"), ["id", "version"], "left_semi")
    grams, path = written(map_batches(texts.select("text"), _grams, "rid bigint, fp bigint, grams binary").dropDuplicates(["rid"]))
    known, met = blocks(dealt, grams, meet)
    compared = met.join(loose(grams, "rid"), "rid").select("key", "tied", "fp", "rid", "grams").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u bigint, v bigint")
    roots = components(known.union(compared))
    remove(spark, path)
    return loose(classes.select("rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root")), "rid")


def one_of_each(docs: DataFrame, meet: int = MEET) -> DataFrame:
    """The rows of ``docs``, with all their columns: of each group of near copies the one with the smallest id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such pairs
    connect. Candidates share a key of least hashes and are joined by the trie over the fingerprints of their sets; the
    sets themselves decide, by 64 bits of each hash. Every pair of a key is settled, however many texts share it (see ``blocks``).

    Of several rows of the smallest id, one of the least text hash stays; a group without ids leaves one row; texts
    without words are one group. Rows travel once; an empty table gives no rows.
    """
    version = F.xxhash64("text")
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID))
    rows = docs.select(id_.alias("id"), version.alias("version"), "text")
    signed = checkpointed(map_batches(rows, _signatures, "id bigint, version bigint, rid bigint, n bigint, keys array<bigint>"))
    of = text_components(rows, signed, meet)
    least = signed.select("id", "version", "rid").join(of, "rid").groupBy("root").agg(F.min(F.struct("id", "version")).alias("x")).select("x.id", "x.version")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("id"), version.alias("version"))
    return marked.join(loose(least, "id", "version"), ["id", "version"], "left_semi").dropDuplicates(["id", "version"]).select("row.*")
