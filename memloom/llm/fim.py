"""Operator 11, fill-in-middle: a text's cut points are found by an Aho-Corasick event scan.

A unit is a run of ASCII letters or one other character. One automaton over the text's UTF-8 bytes reports every
character that ends or breaks a run of letters (each ASCII character that is no letter, and the first byte of each
longer character, with its width) and every sentinel. These events are few, and what lies between two of them is
letters alone, so a gap is one unit or, if empty, none: the units before each event follow by arithmetic, and the
place of the k-th unit is one binary search among the events' ranks. Nothing is made for each unit or character.

The document's own hash picks the two cuts and the form: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix,
middle; ``plain`` leaves the text as it is (always where it holds a sentinel, so every output can be taken apart again).

Defined results: a null or empty text is plain, with no units and an empty output; a null id hashes as the empty text.
Repeated rows give repeated results; other input columns are ignored. One pass by row without a shuffle: no key or
group of copies can skew it, and memory is that of an Arrow batch and of one text's events.
"""

from __future__ import annotations

import hashlib
import string
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: documents that are rearranged, and of those the ones in suffix-prefix-middle order.
SHARE, SPM_SHARE = 90, 20

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def automaton():
    """Finds the bytes (as Latin-1 characters) that aren't letters, valued by their character's width, and sentinels, valued 0."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for code in range(128):
        if chr(code) not in string.ascii_letters:
            made.add_word(chr(code), 1)
    for lead in range(0xC2, 0xF5):
        made.add_word(chr(lead), 2 + (lead >= 0xE0) + (lead >= 0xF0))
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        made.add_word(sentinel, 0)
    made.make_automaton()
    return made


class Units:
    """The units of a text as the ranks of its events."""

    def __init__(self, raw: bytes, scan):
        hits = np.fromiter(chain.from_iterable(scan.iter(raw.decode("latin-1"))), np.int64).reshape(-1, 2)
        wide = hits[:, 1] > 0
        self.sentinel = not wide.all()
        self.at = hits[wide, 0]
        self.after = np.concatenate(([0], self.at + hits[wide, 1]))  # where the gap behind each event begins, and the first gap
        gap = np.concatenate((self.at, [len(raw)])) > self.after
        self.rank = np.arange(len(self.at)) + np.cumsum(gap[:-1])  # units before each event
        self.size, self.n = len(raw), len(self.at) + int(gap.sum())

    def place(self, k: int) -> int:
        """The byte where unit ``k`` begins; the text's end for ``n``."""
        if k >= self.n:
            return self.size
        i = int(np.searchsorted(self.rank, k))
        return int(self.at[i]) if i < len(self.rank) and self.rank[i] == k else int(self.after[i])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(doc_id: int | None, text: str | None, scan, seed: str, share: int, spm_share: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one document."""
    raw = (text or "").encode()
    units = Units(raw, scan)
    a, b, how, order = draws(doc_id, seed)
    if not raw or units.sentinel or how % 100 >= share:
        return units.n, "plain", None, None, text or ""
    one, two = sorted((units.place(a % (units.n + 1)), units.place(b % (units.n + 1))))
    prefix, middle, suffix = raw[:one].decode(), raw[one:two].decode(), raw[two:].decode()
    if order % 100 < spm_share:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return units.n, form, len(prefix), len(middle), output


def fill_in_middle(docs: DataFrame, seed: str = "1", share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""

    def work(batch: dict, scan) -> dict:
        made = [rearranged(i, t, scan, seed, share, spm_share) for i, t in zip(batch["doc_id"], batch["text"])]
        return {"doc_id": batch["doc_id"]} | {name: [row[k] for row in made] for k, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    return map_batches(docs.select("doc_id", "text"), work, SCHEMA, automaton)


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` (form, output, other columns) with ``restored``: the text that ``output`` was made from, by its sentinels alone.

    A text inside holds none of them, so the first one of a kind is the one that was put there.
    """
    step = len(PREFIX)
    second = F.call_function("locate", F.when(F.col("form") == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.col("output"), F.lit(step + 1))
    placed = rows.withColumn("second", F.when(F.col("form") != "plain", second))
    placed = placed.withColumn("third", F.call_function("locate", F.lit(MIDDLE), F.col("output"), F.col("second") + step))
    one = F.substring("output", F.lit(step + 1), F.col("second") - (step + 1))
    two = F.substring("output", F.col("second") + step, F.col("third") - F.col("second") - step)
    middle = F.substring("output", F.col("third") + step, F.length("output"))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return placed.withColumn("restored", text).drop("second", "third")
