"""Names in texts: few names by an Aho-Corasick automaton, more by a filter of hashes over every place and a join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Names, and characters of names, that an automaton holds; more go by the filter.
PART_NAMES, PART_CHARACTERS = 100_000, 2_000_000
#: Bytes of text whose places are tried at a time, and places by lengths of names.
CHUNK = TRIED = 1 << 19
#: Bytes of the shortest head that a longer name has in the filter.
HEAD = 4
#: The filter's bits for a name, and its size in bits as a power of two, at least and at most. Beyond that more stretches pass it, and the join sees to them.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 20, 30
#: Bits of a slice of the filter, as ``bitmap_construct_agg`` makes it.
SLICE = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _find(batches: Iterator[pa.RecordBatch], names: list[str], fold: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    """key, text. key, name of each name that stands in a text; names that fold to the same characters stand together."""
    import ahocorasick

    folded: dict[str, list[str]] = {}
    for name in names:
        folded.setdefault(fold(name), []).append(name)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, word in enumerate(folded):
        machine.add_word(word, n)
    machine.make_automaton()
    groups, number = list(folded.values()), itemgetter(1)
    for batch in batches:
        rows, found = [], []
        for n, text in enumerate(batch.column(1).to_pylist()):
            here = [name for own in set(map(number, machine.iter(fold(text)))) for name in groups[own]]
            rows.extend([n] * len(here))
            found.extend(here)
        keys = batch.column(0).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string())], names=["key", "name"])


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Stretches:
    """Bytes of which any stretch can be told by a number that depends on its own bytes, its length and its kind (1: a head)."""

    def __init__(self, data: bytes):
        own = np.frombuffer(data, dtype=np.uint8)
        bits = len(own).bit_length()
        self.sums, self.back = np.zeros(len(own) + 1, dtype=np.uint64), _powers(_BACK, bits)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(own)], out=self.sums[1:])

    def keys(self, at: np.ndarray, n, kind: int) -> np.ndarray:
        key = (self.sums.take(at + n, mode="clip") - self.sums[at]) * self.back[at] + np.asarray(2 * n + kind).astype(np.uint64) * _ODD[0]
        return key ^ (key >> np.uint64(32))


def _passing(keys: np.ndarray, held: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The places of the keys all of whose bits the filter has."""
    at = None
    for odd in _ODD:
        bit = (((keys if at is None else keys[at]) * odd) >> shift).view(np.int64)
        hit = np.flatnonzero(held[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1))
        at = hit if at is None else at[hit]
    return at


def _places(told: _Stretches, ends: np.ndarray, held: np.ndarray, shift: np.uint64, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first byte, the length and the key of each stretch that may be a name; ``ends`` has the end of each byte's text."""
    at = np.arange(len(ends))
    none = np.empty(0, dtype=np.int64)
    starts, sizes, keys = [none], [none], [none.view(np.uint64)]

    def tried(first: np.ndarray, n) -> None:
        own = told.keys(first, n, 0)
        good = _passing(own, held, shift)
        first, n = first[good], np.broadcast_to(n, first.shape)[good]
        fits = first + n <= ends[first]
        starts.append(first[fits])
        sizes.append(n[fits])
        keys.append(own[good][fits])

    def each(own: np.ndarray) -> None:
        if len(own) * 64 < len(at):
            for n in own:
                tried(at, n)
            return
        step = max(1, TRIED // max(1, len(own)))
        for k in range(0, len(at) if len(own) else 0, step):
            tried(np.repeat(at[k : k + step], len(own)), np.tile(own, len(at[k : k + step])))

    each(lengths[lengths < HEAD])
    w = HEAD
    while len(at) and lengths[-1] >= w:  # names of w bytes and more begin where their first w bytes pass
        at = at[_passing(told.keys(at, w, 1), held, shift)]
        each(lengths[(lengths >= w) & (lengths < 2 * w)])
        w *= 2
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(keys)


def _distinct(parts: list[bytes], held: np.ndarray, shift: np.uint64, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Part and number of each stretch that may be a name, once for each part, and the stretches by number. Stretches are told by 64 bits, and these by the bytes."""
    whole, edges = b"".join(parts), np.cumsum([len(p) for p in parts])
    starts, n, keys = _places(_Stretches(whole), np.repeat(edges, np.diff(edges, prepend=0)), held, shift, lengths)
    of = np.searchsorted(edges, starts, side="right")
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    like, data = first[number], np.frombuffer(whole, dtype=np.uint8)
    same = np.array_equal(n, n[like])
    step = max(1, TRIED // int(n.max(initial=1)))
    for k in range(0, len(n) if same else 0, step):
        size = n[k : k + step]
        along = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = same and np.array_equal(data[np.repeat(starts[k : k + step], size) + along], data[np.repeat(starts[like[k : k + step]], size) + along])
    if same:
        said = [whole[a:b] for a, b in zip(starts[first].tolist(), (starts + n)[first].tolist())]
    else:  # two different stretches of one key
        numbers: dict[bytes, int] = {}
        number = np.array([numbers.setdefault(whole[a:b], len(numbers)) for a, b in zip(starts.tolist(), (starts + n).tolist())])
        said = list(numbers)
    once = np.sort(of * max(1, len(said)) + number)
    once = once[np.diff(once, prepend=-1) > 0]
    return once // max(1, len(said)), once % max(1, len(said)), said


def _maybe(batches: Iterator[pa.RecordBatch], held: bytes, bits: int, lengths: list[int], fold: Callable[[str], str], counts: bool = False) -> Iterator[pa.RecordBatch]:
    """key, text. key, said: each stretch of a folded text, once, that the filter takes for a name; every name in it is one of them.

    With ``counts`` said, n: in how many of some texts each stretch stands.
    """
    held, shift, lengths = np.frombuffer(held, dtype=np.uint8), np.uint64(64 - bits), np.array(lengths, dtype=np.int64)

    def rows(texts: pa.Array, of: np.ndarray, number: np.ndarray, said: list[bytes]) -> pa.RecordBatch:
        said = pa.array(said, pa.binary())
        if counts:
            return pa.RecordBatch.from_arrays([said, pa.array(np.bincount(number, minlength=len(said)))], names=["said", "n"])
        return pa.RecordBatch.from_arrays([texts.take(pa.array(of)), said.take(pa.array(number))], names=["key", "said"])

    for batch in batches:
        parts, size, keys = [], 0, batch.column(0)
        for n, text in enumerate(batch.column(1)):
            own = fold(text.as_py()).encode()
            if parts and size + len(own) > CHUNK:
                yield rows(keys[n - len(parts) :], *_distinct(parts, held, shift, lengths))
                parts, size = [], 0
            if len(own) > CHUNK:  # piece by piece, each with as much of the next as a name can need
                pieces = (own[k : k + CHUNK + int(lengths[-1]) - 1] for k in range(0, len(own), CHUNK))
                said = list({s for p in pieces for s in _distinct([p], held, shift, lengths)[2]})
                yield rows(keys[n:], np.zeros(len(said), dtype=np.int64), np.arange(len(said)), said)
                continue
            parts.append(own)
            size += len(own)
        if parts:
            yield rows(keys[len(keys) - len(parts) :], *_distinct(parts, held, shift, lengths))


def _folded(batches: Iterator[pa.RecordBatch], fold: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [fold(x).encode() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), batch.column(0).cast(pa.string())], names=["said", "name"])


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """said. The filter's bits of each name, and of its heads of ``HEAD`` bytes and of twice, four times, ... as many."""

    def of(parts: list[bytes]) -> pa.RecordBatch:
        n = np.array([len(p) for p in parts], dtype=np.int64)
        told, at = _Stretches(b"".join(parts)), np.cumsum(n) - n
        keys, w = [told.keys(at, n, 0)], HEAD
        while n.max() >= w:
            keys.append(told.keys(at[n >= w], w, 1))
            w *= 2
        every = np.unique(np.concatenate([(k * odd) >> np.uint64(64 - bits) for k in keys for odd in _ODD]))
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], names=["bit"])

    for batch in batches:
        parts, size = [], 0
        for own in batch.column(0).to_pylist():
            if parts and size + len(own) > CHUNK:
                yield of(parts)
                parts, size = [], 0
            parts.append(own)
            size += len(own)
        if parts:
            yield of(parts)


def _filtered(said: DataFrame, own: DataFrame, n: int, fold: Callable[[str], str], counts: bool) -> tuple[DataFrame, DataFrame]:
    """What ``_maybe`` gives for the texts; said, name of each name."""
    kind = said.schema["key"].dataType.simpleString()
    known = checkpointed(own.mapInArrow(lambda it: _folded(it, fold), "said binary, name string").where(F.octet_length("said") > 0))
    lengths = sorted(r["n"] for r in known.select(F.octet_length("said").alias("n")).distinct().collect())  # as many as the longest name has bytes, at most
    bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_EACH - 1).bit_length()))
    marks = known.select("said").mapInArrow(lambda it: _bits(it, bits), "bit bigint")
    slices = marks.groupBy(F.floor(F.col("bit") / SLICE).alias("slice")).agg(F.bitmap_construct_agg(F.col("bit") % SLICE).alias("own"))
    held = bytearray((1 << bits) // 8)
    for r in slices.toLocalIterator():  # at most 2 ** MOST_BITS bits in all
        held[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = r["own"]
    handle = said.sparkSession.sparkContext.broadcast(bytes(held))
    return said.mapInArrow(lambda it: _maybe(it, handle.value, bits, lengths, fold, counts), "said binary, n bigint" if counts else f"key {kind}, said binary"), known


def _asked(texts: DataFrame, names: DataFrame, key: str, text: str, most: int, characters: int, fold: Callable[[str], str], counts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Either key, name of each name in a text, and nothing; or what ``_filtered`` gives, to be joined."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    said = texts.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = checkpointed(names.where(F.length("name") > 0).select("name").distinct())
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    if not n:
        return said.select("key", F.col("text").alias("name")).limit(0), None
    if n > most or size > characters:
        return _filtered(said, own, n, fold, counts)
    handle = texts.sparkSession.sparkContext.broadcast([r["name"] for r in own.collect()])  # within the two bounds
    return said.mapInArrow(lambda it: _find(it, handle.value, fold), f"key {kind}, name string"), None


def named(texts: DataFrame, names: DataFrame, key: str = "query_id", text: str = "text", most: int = PART_NAMES, characters: int = PART_CHARACTERS, fold: Callable[[str], str] = str.casefold) -> DataFrame:
    """texts: ``key``, ``text``; names: name. key, name of each distinct name that a text holds anywhere, whatever the case (folded, so ``ß`` is ``ss``; with ``fold=str.lower`` it stays ``ß``), once.

    The texts are passed over once, however many names there are. Up to ``most`` names and ``characters`` characters go
    out as an automaton. Of more, only a filter goes out: hashes of the names and of their heads, a few bits each, of bounded
    size. What passes it at some place of a text meets the names by a join on the folded bytes, so the filter decides
    nothing. Null and empty names and texts match nothing; ``key`` should tell the texts apart.
    """
    found, known = _asked(texts, names, key, text, most, characters, fold)
    if known is not None:
        found = found.join(known, "said").select("key", "name")
    return found.withColumnRenamed("key", key)


def counted(texts: DataFrame, names: DataFrame, key: str = "query_id", text: str = "text", most: int = PART_NAMES, characters: int = PART_CHARACTERS, fold: Callable[[str], str] = str.casefold) -> DataFrame:
    """name, n_texts: how many texts hold each name, if any, as the rows of ``named``; counted before the join."""
    found, known = _asked(texts, names, key, text, most, characters, fold, True)
    if known is None:
        return found.groupBy("name").agg(F.count("*").alias("n_texts"))
    return found.groupBy("said").agg(F.sum("n").alias("n_texts")).join(known, "said").select("name", "n_texts")
