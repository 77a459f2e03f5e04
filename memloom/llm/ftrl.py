"""Operators 5 and 6, toxicity and quality: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

``fit`` learns from a bounded sample of the labelled rows (``SAMPLE_ROWS``, the first by a hash of the id) with
follow-the-regularised-leader updates: every coordinate has its own learning rate, and L1 keeps most weights at zero, so
that the model is a short list of (slot, weight). ``score`` broadcasts that list (at most 2**bits slots, 4 MB as a dense
table at 20 bits) and gives each whole text the sigmoid of a sparse dot product. Ids, sources, languages and labels are
no features.

Defined results: a null or empty text scores the bias alone. Labelled rows with a null id or label are not learned from;
an id with several labels counts once, with the largest; an id with several texts, with the smallest. Without labelled
rows the model is empty and every score is 0.5. Repeated document rows give repeated results; a null id counts as ''
in the fold. Other input columns are ignored. Scoring is one pass per row without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held_out, map_batches, small_batches

#: Labelled rows that a model is learned from, at most.
SAMPLE_ROWS = 16_000


@dataclass(frozen=True)
class Grams:
    """Which features a text has: word runs up to ``longest``, pairs with a gap of 1..``skip`` words, and their hash size.

    A run of one word repeated is the same feature whatever the word.
    """

    token: str = r"\w+"
    lower: bool = True
    longest: int = 2
    skip: int = 0
    bits: int = 20

    def hashed(self, texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all features of all texts, and the number of the text that each belongs to."""
        find = re.compile(self.token).findall
        words: list[int] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            words += map(known.__getitem__, find(text.lower() if self.lower else text) if text else ())
            counts[i] = len(words) - before
        h = np.array(words, dtype=np.uint64)
        of = np.repeat(np.arange(len(texts)), counts)
        slots, owners = [_slots(h * _ODD[0], self.bits)], [of]
        run, alike = h, np.ones(len(h), dtype=bool)
        for n in range(2, self.longest + 1):
            run, alike = run[:-1] * _ODD[1] + h[n - 1 :] * _ODD[2], alike[:-1] & (h[n - 2 : len(h) - 1] == h[n - 1 :])
            inside = of[n - 1 :] == of[: len(of) - n + 1]
            slots.append(_slots(np.where(alike, np.uint64(n), run)[inside], self.bits))
            owners.append(of[n - 1 :][inside])
        for gap in range(2, self.skip + 2):
            inside = of[gap:] == of[:-gap]
            slots.append(_slots((h[:-gap] * _ODD[1] + h[gap:] * _ODD[3] + np.uint64(1))[inside], self.bits))
            owners.append(of[gap:][inside])
        return np.concatenate(slots), np.concatenate(owners)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _slots(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Words(dict):
    """Hashes of the words met so far; emptied when it holds ``MOST``."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = zlib.crc32(word.encode()) + 1
        return h


@dataclass(frozen=True)
class Rates:
    """alpha, beta: learning rate of a coordinate, alpha / (beta + root of its summed squared gradients); l1, l2: penalties."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    passes: int = 3


@dataclass(frozen=True)
class Model:
    grams: Grams
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], known: dict[str, int], dense: np.ndarray) -> np.ndarray:
        sums, sizes = np.zeros(len(texts)), np.ones(len(texts))
        for lo in range(0, len(texts), 256):  # bounds the arrays
            part = texts[lo : lo + 256]
            slots, of = self.grams.hashed(part, known)
            sizes[lo : lo + 256] = np.maximum(1, np.bincount(of, minlength=len(part)))
            w = dense[slots]
            live = w != 0
            pair = np.unique((of[live] << self.grams.bits) | slots[live])  # a feature counts once in a text
            sums[lo : lo + 256] = np.bincount(pair >> self.grams.bits, weights=dense[pair & ((1 << self.grams.bits) - 1)], minlength=len(part))
        return sigmoid(self.bias + sums * scale(sizes))

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.grams.bits)
        w[self.slots] = self.weights
        return w


def scale(sizes):
    """The value of each feature of a text with so many: long texts have more, and each then says less."""
    return 1 / np.sqrt(np.sqrt(sizes))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def features(texts: list[str | None], grams: Grams, known: dict[str, int]) -> list[tuple[np.ndarray, float]]:
    """The slots of each text, once each, and the value that each has."""
    rows = []
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        slots, of = grams.hashed(part, known)
        sizes = np.bincount(of, minlength=len(part))
        pair = np.unique((of << grams.bits) | slots)
        own = np.split((pair & ((1 << grams.bits) - 1)).astype(np.int32), np.searchsorted(pair >> grams.bits, np.arange(1, len(part))))
        rows += [(x.copy(), scale(max(1, s))) for x, s in zip(own, sizes)]
    return rows


def learn(texts: list[str | None], labels: list[int], grams: Grams, rates: Rates) -> Model:
    return learn_from(features(texts, grams, Words()), labels, grams, rates)


def learn_from(rows: list[tuple[np.ndarray, float]], labels: list[int], grams: Grams, rates: Rates) -> Model:
    """FTRL-proximal over the rows' ``features`` in the given order, ``passes`` times."""
    z, n = np.zeros(1 << grams.bits), np.zeros(1 << grams.bits)
    bias_z = bias_n = 0.0
    a, b, l1, l2 = rates.alpha, rates.beta, rates.l1, rates.l2

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((b + np.sqrt(n)) / a + l2))

    for _ in range(rates.passes):
        for (x, value), y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            bias = -bias_z / ((b + bias_n**0.5) / a)
            miss = float(sigmoid(bias + w.sum() * value)) - y
            g = miss * value
            root = np.sqrt(nx)
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / a * w
            n[x] = nx + g * g
            bias_z += miss - ((bias_n + miss * miss) ** 0.5 - bias_n**0.5) / a * bias
            bias_n += miss * miss
    w = weights(z, n)
    live = np.flatnonzero(w)
    return Model(grams, live, w[live], float(-bias_z / ((b + bias_n**0.5) / a)))


def fit(docs: DataFrame, labels: DataFrame, label: str, grams: Grams, rates: Rates, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns in one task from at most ``sample_rows`` labelled rows outside the held-out fifth; only the weights come back."""
    # of a hash's lowest share first, so that sorting has a bounded number of rows to hold
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    small_batches(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = Words(), []
        for batch in batches:  # a text is gone when its features are known
            ids, labels = batch.column("id").to_pylist(), batch.column("y").to_pylist()
            rows += zip(ids, features(batch.column("text").to_pylist(), grams, known), labels)
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        model = learn_from([r[1] for r in rows], [int(r[2]) for r in rows], grams, rates)
        yield pa.RecordBatch.from_pydict({"slots": [model.slots.astype(np.int32)], "weights": [model.weights], "bias": [model.bias]})

    made = rows.coalesce(1).mapInArrow(train, "slots array<int>, weights array<double>, bias double").collect()
    slots, weights, bias = made[0] if made else ([], [], 0.0)
    return Model(grams, np.array(slots, dtype=np.int64), np.array(weights, dtype=np.float64), bias)


def _score(batch: dict, tools: tuple, threshold: float) -> dict:
    model, known, dense = tools
    scores = model.scores(batch["text"], known, dense)
    return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)}


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 at ``threshold`` or more)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, partial(_score, threshold=threshold), "doc_id bigint, held_out boolean, score double, predicted int", lambda: (handle.value, Words(), handle.value.dense()))


TOXIC_GRAMS = Grams(token=r"\w+", lower=True, longest=2, skip=2)
TOXIC_RATES = Rates(alpha=4.0, l1=2.0)
TOXIC_FROM = 0.5
#: Words in their own case and runs of punctuation: junk shows in both.
QUALITY_GRAMS = Grams(token=r"\w+|[^\w\s]+", lower=False, longest=3)
QUALITY_RATES = Rates()
QUALITY_FROM = 0.3


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels, "toxic", TOXIC_GRAMS, TOXIC_RATES), TOXIC_FROM)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels, "quality", QUALITY_GRAMS, QUALITY_RATES), QUALITY_FROM)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose quality score is ``QUALITY_FROM`` or more."""
    handle = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", QUALITY_GRAMS, QUALITY_RATES))
    return filter_rows(docs, lambda texts, tools: handle.value.scores(texts, *tools) >= QUALITY_FROM, lambda: (Words(), handle.value.dense()))
