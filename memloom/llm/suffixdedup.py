"""Operator 2, suffix-array dedup: every byte that a 400-byte string covers which also starts anywhere else is removed.

Each window of 400 bytes belongs to the leftmost least hash of its 64-byte strings, its anchor. A region is a run of
windows with one anchor: equal windows have equal anchors at equal places, so only regions of one anchor can share a
window. Regions are told by (anchor, hash of their bytes): those that occur twice are repeated whole, and only anchors
with two different regions go on. Their bytes meet by anchor, one region for each kind, and a suffix array over them
(``suffixes``: linear grouping by Lyndon prefixes, over phrases cut by content, exact to the byte) finds the windows that
they share. Regions are equal where 64 bits of their hash and 64 of their anchor's are.

An anchor with more than ``MOST`` different regions (a short passage in very many texts) isn't gathered anywhere: its
windows are told by 128 bits of the piece of region that all of them share, and, where a piece occurs twice, by their own
hashes, counted by partial sums. A low-entropy stretch, whose windows all repeat within their text, is folded in place.

Defined results: null and empty texts have no bytes (hash of the empty string); texts under 400 bytes lose none. Rows
with equal texts repeat one another, and so lose every window; that goes for repeated rows too, and for rows without an
id (their spans are found once for each, and kept once). Texts are told apart by (id, two 64-bit hashes, size). Other input columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, loose, map_batches, remove, small_batches, written
from .suffixes import repeated_windows, run_hashes

LENGTH, GRAM = 400, 64
#: Different regions of one anchor that meet in one task.
MOST = 100
#: Bytes that are worked on at a time.
CHUNK = 2 << 20
#: Windows of a piece of a very common anchor's region.
PIECE = 48
#: Bits of a place, of any text that a row can hold: what is least must depend on the window alone.
PLACE_BITS = 31
#: Texts that a task remembers, to cut each of several equal rows once.
SEEN = 100_000
REGIONS = "k1 bigint, k2 bigint, anchor bigint, region bigint, n bigint, start int, windows int, more array<int>"
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, has_repeat int"


def least_in_runs(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    m, k = key, 1
    while 2 * k <= width:
        m = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - k :][: len(key) - width + 1])


def regions_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, number of windows, and anchor hash of each region of the texts, in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    none = np.empty(0, dtype=np.int64)
    if base[-1] < length:
        return none, none, none, none.astype(np.uint64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h = run_hashes(data, gram)
    place_bits = np.uint64(PLACE_BITS)
    key = (h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64)
    anchor = (least_in_runs(key, length - gram + 1) & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= base[of + 1]
    anchor, of, at = anchor[inside], of[inside], np.flatnonzero(inside)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))))
    count = np.diff(np.append(first, len(at)))
    return of[first], at[first] - base[of[first]], count, h[anchor[first]]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for k, s in enumerate(sizes):
        if total and total + s > CHUNK:
            yield lo, k
            lo, total = k, 0
        total += s
    if sizes:
        yield lo, len(sizes)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _regions(batch: dict) -> dict:
    """One row for each different region of a text; ``more`` has the spans of one that occurs in it more than once."""
    out: dict[str, list] = {k: [] for k in ("k1", "k2", "anchor", "region", "n", "start", "windows", "more")}
    texts = [(t or "").encode() for t in batch["text"]]
    for lo, hi in _chunks([len(t) for t in texts]):
        part = texts[lo:hi]
        of, start, count, anchor = regions_of(part)
        met: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for k, s, c, a in zip(of.tolist(), start.tolist(), count.tolist(), anchor.tolist()):
            r = xxhash.xxh3_64_intdigest(part[k][s : s + c - 1 + LENGTH])
            met.setdefault((k, a, r), []).append((s, c))
        for (k, a, r), places in met.items():
            s, c = places[0]
            out["k1"].append(batch["k1"][lo + k])
            out["k2"].append(batch["k2"][lo + k])
            out["anchor"].append(_signed(a))
            out["region"].append(_signed(r))
            out["n"].append(len(places))
            out["start"].append(s)
            out["windows"].append(c)
            out["more"].append([x for span in joined([(s, s + c - 1 + LENGTH) for s, c in places]) for x in span] if len(places) > 1 else None)
    return out


CUT = "k1 bigint, k2 bigint, anchor bigint, n bigint, start int, windows int, body binary"
PIECES = "k1 bigint, k2 bigint, n bigint, start int, core1 bigint, core2 bigint, hashes array<bigint>"


def _cut(batch: dict, seen: set[tuple[int, int]]) -> dict:
    """The bytes of the chosen regions of each text; rows of one id and text (``seen`` by the task) give them once."""
    out: dict[str, list] = {k: [] for k in ("k1", "k2", "anchor", "n", "start", "windows", "body")}
    unpack = zstandard.ZstdDecompressor().decompress
    for k1, k2, packed, chosen in zip(batch["k1"], batch["k2"], batch["packed"], batch["chosen"]):
        if (k1, k2) in seen:
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add((k1, k2))
        raw = unpack(packed)
        for c in chosen:
            out["k1"].append(k1)
            out["k2"].append(k2)
            for name in ("anchor", "n", "start", "windows"):
                out[name].append(c[name])
            out["body"].append(raw[c["start"] : c["start"] + c["windows"] - 1 + LENGTH])
    return out


def _pieces(batch: dict) -> dict:
    """Regions of very common anchors in pieces of ``PIECE`` windows at fixed distances from the anchor: the hash of the bytes that all windows of a piece have, and of each window."""
    out: dict[str, list] = {k: [] for k in ("k1", "k2", "n", "start", "core1", "core2", "hashes")}
    for lo, hi in _chunks([len(b) for b in batch["body"]]):
        part = batch["body"][lo:hi]
        whole = np.frombuffer(b"".join(part), dtype=np.uint8)
        windows = run_hashes(whole, LENGTH).view(np.int64)
        grams = run_hashes(whole, GRAM)
        at = 0
        for k, body in enumerate(part, lo):
            count, start = batch["windows"][k], batch["start"][k]
            own = grams[at : at + len(body) - GRAM + 1].view(np.int64)
            place = int(np.flatnonzero(own == batch["anchor"][k])[0])  # of the anchor: windows start at it or before
            # windows by their distance to the anchor, PIECE distances each: the same in every region, whole or not
            edges = sorted({0, count, *range((place + 1) % PIECE, count, PIECE)})
            for a, b in zip(edges, edges[1:]):
                cell = (place - a) // PIECE
                top = place - cell * PIECE
                core = body[top : top - PIECE + 1 + LENGTH]
                digest = xxhash.xxh3_128_intdigest(core + cell.to_bytes(4, "little"))
                out["k1"].append(batch["k1"][k])
                out["k2"].append(batch["k2"][k])
                out["n"].append(batch["n"][k])
                out["start"].append(start + a)
                out["core1"].append(_signed(digest >> 64))
                out["core2"].append(_signed(digest & 0xFFFFFFFFFFFFFFFF))
                out["hashes"].append(windows[at + a : at + b])
            at += len(body)
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are searched together, about ``CHUNK`` bytes at a time."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, first, stop = [], [], [], []
        for row, hit in zip(rows, repeated_windows([r[6] for r in rows], [r[5] for r in rows], LENGTH)):
            if row[3] == 1 and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    k1.append(row[0])
                    k2.append(row[1])
                    first.append(row[4] + a)
                    stop.append(row[4] + b - 1 + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int32()), pa.array(stop, pa.int32())], names=["k1", "k2", "first", "stop"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > CHUNK and row[2] != rows[-1][2]:
                yield spans(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[6])
    if rows:
        yield spans(rows)


def _finish(batch: dict) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeat")}
    unpack = zstandard.ZstdDecompressor().decompress
    for packed, spans in zip(batch["packed"], batch["spans"]):
        raw = unpack(packed)
        gone = joined([(s["first"], s["stop"]) for s in spans or ()])
        kept, at = hashlib.sha256(), 0
        for a, b in gone:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(sum(b - a for a, b in gone))
        out["n_spans"].append(len(gone))
        out["kept_sha256"].append(kept.hexdigest())
        out["has_repeat"].append(int(bool(gone)))
    return out | {"doc_id": batch["doc_id"]}


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that tell the text and the id apart."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text", size).alias("k1"), F.xxhash64(size, F.lit("second"), "text", "doc_id").alias("k2"))


def _pack(batch: dict) -> dict:
    press = zstandard.ZstdCompressor(level=1).compress
    return {k: batch[k] for k in ("doc_id", "k1", "k2")} | {"packed": [press((t or "").encode()) for t in batch["text"]]}


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, and the text's bytes compressed for the way: texts are most of what is shuffled."""
    return map_batches(_keyed(docs), _pack, "doc_id bigint, k1 bigint, k2 bigint, packed binary")


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """k1, k2 (of ``_keyed``), first, stop: bytes to remove; spans may overlap."""
    keyed = _keyed(docs)
    small_batches(docs.sparkSession)
    # the texts are read once for their regions, which are read twice
    every, path = written(map_batches(keyed.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text"), _regions, REGIONS))
    # most anchors occur once: only the others' regions are kept
    again = every.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    regions = checkpointed(every.join(loose(again, "anchor"), "anchor", "left_semi"))
    remove(docs.sparkSession, path)
    kinds = regions.groupBy("anchor", "region").agg(F.sum("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start"), F.first("windows").alias("windows"))
    twice = kinds.where("n > 1").select("anchor", "region")
    own = F.coalesce("more", F.array("start", F.col("start") + F.col("windows") - 1 + LENGTH))
    spans = F.transform(F.sequence(F.lit(0), F.size(own) - 2, F.lit(2)), lambda i: F.struct(F.get(own, i).alias("first"), F.get(own, i + 1).alias("stop")))
    whole = regions.join(loose(twice, "anchor", "region"), ["anchor", "region"], "left_semi").select("k1", "k2", F.explode(spans).alias("s")).select("k1", "k2", "s.first", "s.stop")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    chosen = checkpointed(kinds.join(loose(shared, "anchor"), "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "n", "start", "windows", "kinds")).alias("chosen")))
    packed = _packed(docs)
    few, many = (F.filter("chosen", lambda c: (c["kinds"] > most) == common) for common in (False, True))
    met = lambda part: packed.join(chosen.select("k1", "k2", part.alias("chosen")).where(F.size("chosen") > 0), ["k1", "k2"]).select("doc_id", "k1", "k2", "packed", "chosen")
    cold = map_batches(met(few), _cut, CUT, set)
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_align, "k1 bigint, k2 bigint, first int, stop int")
    pieces = checkpointed(map_batches(map_batches(met(many), _cut, CUT, set), _pieces, PIECES))
    alike = pieces.groupBy("core1", "core2").agg(F.count("*").alias("c")).where("c > 1").select("core1", "core2")
    windows = pieces.join(loose(alike, "core1", "core2"), ["core1", "core2"], "left_semi").select("k1", "k2", "n", "start", "core1", F.posexplode("hashes").alias("pos", "hash"))
    twin = windows.groupBy("core1", "hash").agg(F.count("*").alias("c")).where("c > 1").select("core1", "hash")
    common = windows.where("n = 1").join(loose(twin, "core1", "hash"), ["core1", "hash"], "left_semi").select("k1", "k2", (F.col("start") + F.col("pos")).alias("first"), (F.col("start") + F.col("pos") + LENGTH).alias("stop"))
    return whole.unionByName(found).unionByName(common)


def suffix_dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat (1 if bytes go, else 0)."""
    # a set: rows of one id and text find the same spans, each of them once more
    spans = repeated_spans(docs, most).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    rows = _packed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "packed", "spans")
    return map_batches(rows, _finish, SCHEMA)
