"""Operator 12, periodic runs of words: an all-lag vectorised scan.

A run is a stretch of words with smallest period q, of at least ``LEAST`` words and ``EXPONENT`` periods, that no
neighbouring word extends. Each shift q up to n / EXPONENT is compared with the words' ids: a run is a stretch of
max(LEAST - q, (EXPONENT - 1) q) places or more where words q apart are equal. Such a stretch covers a whole block of
half that length, wherever blocks are laid; so all lags are compared together at the blocks' first words, what is left
at more words of each block, and only round the blocks that are left (few, but in runs) are the true stretches measured
in full. No stretch that counts is lost, and n words cost about n ln n comparisons in place of n * n / EXPONENT.
A stretch at a multiple of a run's period is the same run: periods are reduced to the smallest, and blocks inside a
known run are passed over at the multiples of its period.

The unit of work is a document and a range of lags. A text of up to ``SPREAD`` bytes is one such unit and stays where
it lies; a longer one's ids go out once for each of its ranges, which Spark deals over the machines, and its runs meet
again by document (their number is bounded by its words). Both ways give the same rows at any setting.

Defined results: a null or empty text has no words and no runs (nulls for the best run, hashes of empty strings).
Repeated rows give repeated results; ids may be null; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Least words and periods of a run.
LEAST, EXPONENT = 24, 3
#: Bytes of a text whose lags are one unit of work; comparisons held at a time; comparisons a word of a longer text's ranges.
SPREAD, HELD, A_WORD = 4 << 20, 1 << 20, 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = f"doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs {RUNS}, collapsed string"
FIELDS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: white space is 9-13 and 32


def ids_of(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _blocks(n: int, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each lag: the least stretch that counts, the size of a block that every such stretch covers, the number of blocks."""
    stretch = np.maximum(LEAST - lags, (EXPONENT - 1) * lags)
    block = (stretch + 1) // 2
    return stretch, block, (n - lags) // block


def lag_ranges(n: int, most: int) -> list[tuple[int, int]]:
    """Ranges [lo, hi) of all lags of ``n`` words, each of at most about ``most`` blocks."""
    if n < LEAST:
        return []
    lags = np.arange(1, n // EXPONENT + 1)
    part = (np.cumsum(_blocks(n, lags)[2]) - 1) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(lags)]))
    return [(int(a) + 1, int(b) + 1) for a, b in zip(cuts, cuts[1:])]


def _candidates(ids: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lag, place, size of the blocks of lags [lo, hi) whose probed words all equal those a lag further, by lag and place."""
    lags = np.arange(lo, hi)
    _, block, count = _blocks(len(ids), lags)
    lag, size = np.repeat(lags, count), np.repeat(block, count)
    at = (np.arange(len(lag)) - np.repeat(np.cumsum(count) - count, count)) * size
    for probe in range(9):  # the first word of the block, its last, then words at eighths
        x = at + (size - 1) * (0, 8, 4, 2, 6, 1, 3, 5, 7)[probe] // 8
        alive = np.flatnonzero(ids[x] == ids[x + lag])
        if len(alive) < len(lag):
            lag, at, size = lag[alive], at[alive], size[alive]
        if not len(lag):
            break
    return lag, at, size


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """The number of leading places where two arrays are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        same = a[done : min(n, done + step)] == b[done : min(n, done + step)]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + len(same), 2 * step
    return n


def smallest_period(run: np.ndarray, period: int) -> int:
    """The smallest period of ``run``, which has ``period`` and at least two of it: a divisor, found prime by prime."""
    left, prime = period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        while left % prime == 0:
            left //= prime
            shorter = period // prime
            if (run[shorter:] == run[:-shorter]).all():
                period = shorter
        prime += 1
    return period


def scan(ids: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """start, length, smallest period of each run that has a multiple of its period among the lags [lo, hi)."""
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}  # by lag: the runs whose period divides it
    n = len(ids)
    for a, b in ((max(lo, x), min(hi, y)) for x, y in lag_ranges(n, HELD) if x < hi and y > lo):
        lag, at, size = _candidates(ids, a, b)
        edges = np.flatnonzero(np.diff(lag)) + 1 if len(lag) else []
        for q, places, span in zip(*(np.split(x, edges) for x in (lag, at, size))):
            if not len(q):
                continue
            q, span = int(q[0]), int(span[0])
            for s, e in known.pop(q, ()):
                places = places[(places < s) | (places + span + q > e)]
            least = max(LEAST - q, (EXPONENT - 1) * q)
            while len(places):
                x = int(places[0])
                end = x + _equal_ahead(ids[x:], ids[x + q :])
                start = x - _equal_ahead(ids[:x][::-1], ids[q : x + q][::-1])
                places = places[places >= max(end, x + 1)]
                if end - start < least or (start, end - start + q) in found:
                    continue
                length = end - start + q
                period = smallest_period(ids[start : start + length], q)
                found[start, length] = period
                for multiple in range((q // period + 1) * period, min(hi, length // EXPONENT + 1), period):
                    known.setdefault(multiple, []).append((start, start + length))
    return sorted((s, k, p) for (s, k), p in found.items())


def best(runs: list[tuple[int, int, int]]) -> tuple:
    """start, length, period, floor(1000 length / period) of the run of the greatest exponent; ties go to the smallest start, then period."""
    if not runs:
        return None, None, None, None
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return start, length, period, 1000 * length // period


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words).decode()
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]).decode()


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    return (len(words), len(runs), *best(runs), [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed(words, runs))


def _columns(doc_ids: list, rows: list[tuple]) -> dict:
    return {"doc_id": doc_ids} | {name: [r[k] for r in rows] for k, name in enumerate(FIELDS)}


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document (by crc32 of its id as text; a null id counts as '') repeats the first words of a tail.

    Where h = crc32(id) is a multiple of 10 and g = h // 10: from word a = g % n on, word i becomes word a + (i - a) % p with
    p = 1 + (n - a) // (3 + g % 8).
    """
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _whole(rewrite: Rewrite) -> Callable[[dict], dict]:
    def work(batch: dict) -> dict:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            words = rewrite(doc_id, words_of(text))
            rows.append(_row(words, scan(ids_of(words), 1, len(words) // EXPONENT + 1) if len(words) >= LEAST else []))
        return _columns(batch["doc_id"], rows)

    return work


def _cut(rewrite: Rewrite) -> Callable[[dict], dict]:
    def work(batch: dict) -> dict:
        out: dict[str, list] = {"key": [], "lo": [], "hi": [], "ids": []}
        for key, doc_id, text in zip(batch["key"], batch["doc_id"], batch["text"]):
            ids = ids_of(rewrite(doc_id, words_of(text)))
            for lo, hi in lag_ranges(len(ids), A_WORD * len(ids)):
                for name, value in (("key", key), ("lo", lo), ("hi", hi), ("ids", ids.tobytes())):
                    out[name].append(value)
        return out

    return work


def _scanned(batch: dict) -> dict:
    made = [(key, *run) for key, lo, hi, ids in zip(batch["key"], batch["lo"], batch["hi"], batch["ids"]) for run in scan(np.frombuffer(ids, np.int32), lo, hi)]
    return {name: [r[k] for r in made] for k, name in enumerate(("key", "start", "length", "period"))}


def _met(rewrite: Rewrite) -> Callable[[dict], dict]:
    def work(batch: dict) -> dict:
        rows = [_row(rewrite(doc_id, words_of(text)), sorted((r["start"], r["length"], r["period"]) for r in runs or ())) for doc_id, text, runs in zip(batch["doc_id"], batch["text"], batch["runs"])]
        return _columns(batch["doc_id"], rows)

    return work


def periodic_runs(docs: DataFrame, rewrite: Rewrite = lambda doc_id, words: words, spread: int = SPREAD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, the best run, all ``runs`` by start and period, and the ``collapsed`` text.

    ``rewrite`` may change a document's words before they are scanned; it depends on the id and the words alone.
    """
    rows = docs.select("doc_id", "text")
    long = F.octet_length("text") > spread
    short = map_batches(rows.where(~F.coalesce(long, F.lit(False))), _whole(rewrite), SCHEMA)
    keyed = rows.where(long).withColumn("key", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256))  # repeated rows have the same runs
    parts = map_batches(keyed.dropDuplicates(["key"]), _cut(rewrite), "key string, lo bigint, hi bigint, ids binary").repartition("key", "lo")
    runs = map_batches(parts, _scanned, "key string, start bigint, length bigint, period bigint").distinct()
    of_text = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    met = keyed.join(of_text, "key", "left").select("doc_id", "text", "runs")
    return short.unionByName(map_batches(met, _met(rewrite), SCHEMA))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of ``periodic_runs``: hashes in place of the runs and the text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
