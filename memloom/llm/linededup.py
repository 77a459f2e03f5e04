"""Operator 9, line dedup: documents that share telling lines are aligned by patience diff, and the later one loses the aligned blocks.

Telling runs are the shortest runs of consecutive lines that have at least ``LEAST_CHARS`` characters together, often a
single line. By such a run's hash a later document finds the first document that has it, whether the run is rare or in a
third of all rows: links go to that first document only, so a run gives as many links as it has rows, and no pairs among
them. What goes to a later document is, for each of its runs that an earlier one has, where that document has it; a first
document's lines are never copied. Each link is aligned over its runs, the k-th place of a run against the k-th: runs
that stand once in both are anchors, their longest increasing order is the patience alignment, and what lies between two
anchors is aligned by the longest increasing order of the runs there. The aligned runs go, and nothing else: a block that
the first document has at a place across the alignment (a moved block), or a repeat that it has fewer times, stays. Of
several longest orders the one with the earliest places in the first document counts. Empty lines between two that go,
at most two, go with them.

Later means a larger doc_id. Defined results: rows without an id come after all others and are no one's first document;
rows of one id aren't compared with one another. Null and empty texts have no telling runs and stay as they are.
Repeated rows give repeated results. Input columns may have any names: rows travel as one struct. An empty table gives
no rows.

Only hashes and places of runs are shuffled to find what goes; the text itself is shuffled once, at the end.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import loose, map_batches

LEAST_CHARS = 40
#: Empty lines between two lines that go, at most, to go with them.
MOST_EMPTY = 2
LAST_ID = (1 << 63) - 1


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (a, b) in order of a, the longest chain in which b rises too."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before[n] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            at.append(n)
        else:
            tails[k], at[k] = b, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(runs: list[tuple[int, int, bool]]) -> dict[int, int]:
    """runs: place in the later document, place in the first document, and whether both have the run once. The later places that align, with those they align to.

    The anchors are the longest rising chain of runs that are in both once; between two of them, the longest rising
    chain of the other runs.
    """
    runs = sorted(runs, key=lambda r: (r[0], -r[1]))  # falling at one later place: a chain holds one of them
    held = dict(longest_increasing([(b, a) for b, a, once in runs if once]))
    edges = [(-1, -1), *held.items(), (1 << 62, 1 << 62)]
    n = 0
    gap: list[tuple[int, int]] = []
    for b, a, _ in [*runs, (1 << 62, 1 << 62, True)]:
        while n + 1 < len(edges) and b >= edges[n + 1][0]:
            held.update(longest_increasing(gap))
            gap = []
            n += 1
        if n + 1 < len(edges) and edges[n][0] < b and edges[n][1] < a < edges[n + 1][1]:
            gap.append((b, a))
    return held


def runs_of(lines: list[int], sizes: list[int], least: int = LEAST_CHARS) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the shortest runs of at least ``least`` characters from each line on and up to each line; lines of no weight start and end none.

    Every line of a longer run is in one of these that lies within it.
    """
    raw, sums = np.array(lines, dtype=np.int64).tobytes(), np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
    weighty = np.flatnonzero(np.diff(sums))
    ends = np.searchsorted(sums, sums[weighty] + least)
    starts = np.searchsorted(sums, sums[weighty + 1] - least, side="right") - 1
    found = {(s, e) for s, e in zip(weighty.tolist(), ends.tolist()) if e <= len(lines)} | {(s, e) for s, e in zip(starts.tolist(), (weighty + 1).tolist()) if s >= 0}
    return [(s, e, lines[s] if e - s == 1 else xxhash.xxh64_intdigest(raw[8 * s : 8 * e]) - (1 << 63)) for s, e in sorted(found)]


def placed_runs(lines: list[int], sizes: list[int], least: int = LEAST_CHARS) -> dict[int, list[int]]:
    """The hash of each telling run, with its places: start, size and the number of empty lines after it (up to MOST_EMPTY + 1) in one number, 32, 30 and 2 bits."""
    empty = [0] * (len(lines) + 1)
    for k in range(len(lines) - 1, -1, -1):
        empty[k] = 0 if sizes[k] else min(MOST_EMPTY, empty[k + 1]) + 1
    out: dict[int, list[int]] = {}
    for s, e, h in runs_of(lines, sizes, least):
        out.setdefault(h, []).append(s << 32 | (e - s) << 2 | empty[e])
    return out


def gone_spans(matches: list[tuple[int, list[int], bool, list[int]]]) -> tuple[list[int], int]:
    """matches: of each run that an earlier document has, that document, the run's first lines there, whether both have it once, and its places here (``placed_runs``).

    Starts and ends of the spans of lines that the alignments hold, in order, and the number of places in them.
    """
    links: dict[int, dict[tuple[int, int], bool]] = {}
    for first, ats, once, places in matches:
        link = links.setdefault(first, {})
        for at, p in zip(ats, places):  # runs of one start may differ in length: one place
            link[p >> 32, at] = once or link.get((p >> 32, at), False)
    held = {first: patience([(b, a, once) for (b, a), once in link.items()]) for first, link in links.items()}
    spans = [(p >> 32, (p >> 32) + ((p & 0xFFFFFFFF) >> 2), p & 3) for first, ats, _, places in matches for at, p in zip(ats, places) if held[first].get(p >> 32) == at]
    out: list[int] = []
    reach = -1
    for s, e, empty in sorted(spans):
        if out and s <= reach:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
        reach = max(reach, e + (empty if empty <= MOST_EMPTY else 0))
    return out, sum(map(len, held.values()))


def _rows(docs: DataFrame) -> DataFrame:
    """row (struct of all columns), id, version, body."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col("text").alias("body"))
    return rows.select("row", "id", F.xxhash64("body").alias("version"), "body")


def lines_of(body: Column) -> Column:
    return F.split(F.coalesce(body, F.lit("")), "\n")


def removed_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """id, version, gone, aligned: for each document that loses lines, the starts and ends of the spans that go (see ``gone_spans``)."""
    parts = _rows(docs).select("id", "version", lines_of(F.col("body")).alias("parts"))
    lines = parts.select("id", "version", F.transform("parts", lambda x: F.xxhash64(F.trim(x))).alias("lines"), F.transform("parts", lambda x: F.length(F.trim(x))).alias("sizes"))

    def runs(batch: dict) -> dict:
        made = [placed_runs(x, z, least) for x, z in zip(batch["lines"], batch["sizes"])]
        return {"id": batch["id"], "version": batch["version"], "runs": [[{"run": h, "place": p[0], "more": p[1:] or None} for h, p in x.items()] for x in made]}

    each = map_batches(lines, runs, "id bigint, version bigint, runs array<struct<run:bigint,place:bigint,more:array<bigint>>>").select("id", "version", F.explode("runs").alias("x")).select("id", "version", "x.*")
    # of several texts with one id, the least hash stands for the id
    firsts = each.groupBy("run").agg(F.min(F.struct("id", "version", "place", "more")).alias("h"), F.max("id").alias("last")).where("h.id < last")
    firsts = firsts.select("run", F.col("h.id").alias("first"), F.col("h.place").alias("at"), F.col("h.more").alias("ats"))
    links = each.join(loose(firsts, "run"), "run").where("first < id")
    # the k-th place here meets the k-th there: no more places travel than this document has itself
    links = links.select("id", "version", "first", "at", F.slice("ats", F.lit(1), F.size("more")).alias("ats"), (F.col("ats").isNull() & F.col("more").isNull()).alias("once"), "place", "more")
    # rows of one id and text have the same runs: a set keeps each once
    found = links.groupBy("id", "version").agg(F.collect_set(F.struct("first", "at", "ats", "once", "place", "more")).alias("matches"))

    def align(batch: dict) -> dict:
        made = [gone_spans([(m["first"], [a >> 32 for a in (m["at"], *(m["ats"] or ()))], m["once"], [m["place"], *(m["more"] or ())]) for m in x]) for x in batch["matches"]]
        return {"id": batch["id"], "version": batch["version"], "gone": [g for g, _ in made], "aligned": [n for _, n in made]}

    return map_batches(found, align, "id bigint, version bigint, gone array<int>, aligned bigint")


def _kept(docs: DataFrame, least: int) -> DataFrame:
    """row, gone (null where nothing goes), aligned, parts (lines), kept (the lines that stay, joined)."""
    gone = removed_lines(docs, least)
    # the text goes through the shuffle once, in its row, and is split behind it
    rows = _rows(docs).select("row", "id", "version").join(gone, ["id", "version"], "left").withColumn("parts", lines_of(F.col("row.text")))
    # what stays lies between the spans: one slice for each, whatever the number of lines
    edges = F.concat(F.array(F.lit(0)), "gone", F.array(F.size("parts")))
    stay = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone"), F.lit(2)), lambda k: F.slice("parts", F.get(edges, k) + 1, F.get(edges, k + 1) - F.get(edges, k))))
    return rows.select("row", "gone", "aligned", "parts", F.when(F.col("gone").isNull(), F.array_join("parts", "\n")).otherwise(F.array_join(stay, "\n")).alias("kept"))


def line_dedup(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept_chars, kept_sha256, removed (places of the lines that go), n_aligned (places that the alignments hold)."""
    of = F.transform(F.sequence(F.lit(0), F.size("gone") - 2, F.lit(2)), lambda k: F.sequence(F.get("gone", k), F.get("gone", k + 1) - 1))
    removed = F.when(F.col("gone").isNull(), F.array().cast("array<int>")).otherwise(F.flatten(of))
    return _kept(docs, least).select(
        F.col("row.doc_id").alias("doc_id"), F.size("parts").cast("bigint").alias("n_lines"), F.size(removed).cast("bigint").alias("n_removed"),
        F.length("kept").cast("bigint").alias("kept_chars"), F.sha2(F.col("kept"), 256).alias("kept_sha256"), removed.alias("removed"), F.coalesce("aligned", F.lit(0)).alias("n_aligned"),
    )


def without_common_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``docs`` with all their columns; ``text`` has lost its common lines, ``n_chars``, if there, counts what is left. Rows that lost all they had go."""
    rows = _kept(docs, least).where(F.col("gone").isNull() | (F.length(F.trim(F.translate("kept", "\n\r\t", ""))) > 0))
    kept = []
    for field in docs.schema:
        old = F.col("row").getField(field.name)
        if field.name == "text":
            old = F.when(F.col("gone").isNull(), old).otherwise(F.col("kept"))
        elif field.name == "n_chars":
            old = F.when(F.col("gone").isNull(), old).otherwise(F.length("kept")).cast(field.dataType)
        kept.append(old.alias(field.name))
    return rows.select(*kept)
