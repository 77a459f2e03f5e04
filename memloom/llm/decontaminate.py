"""Operator 8, benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Texts and items are sequences of lower-case words. A document holds an item if some window of it is within
floor((1 - SIMILARITY) * m) word edits of the item's m words. The windows tried are those that can be: of m words and
k edits, k+1 gaps leave a run of ceil((m-k)/(k+1)) words or more untouched, so a window that shares no such run (of up
to three words) with the item is out; each shared run places one window of the item's size. Each window goes through the
CGK walk (a random bit for each step and word says whether to move on), which turns few edits into few differing
places; ``REPEATS`` times, ``SAMPLED`` places of the walk are compared with the items' own walks. Windows that agree
with an item in one repeat are checked by an exact bit-parallel alignment of the whole item, with free ends. An item of
more than ``PIECE`` words is looked for by its pieces of so many: if it is held, one of them is within its share of edits,
and a walk stays true over a piece.

At a share ``DIFFER`` of differing places, a window at the edge of the budget is found with probability
1 - (1 - (1 - DIFFER)**SAMPLED)**REPEATS, over 0.98 with the defaults; fewer edits are found more often, and each shared
run gives another try.

The items go to the executors in blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters at most, dealt by a
hash, one pass each, so a broadcast is bounded whatever the benchmark's size. Documents are read row by row: no shuffle, no pairs of documents.

Defined results: null or empty texts and items (or without words) match nothing. Repeated document rows give repeated
results; repeated items with one id count once for each text. Null ids pass. Other input columns are ignored by ``leaks``
and kept by ``without_leaks``, whatever their names. Places are code points of the text as it is, before lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_batches

SIMILARITY, RUN, PIECE = 0.8, 3, 64
SAMPLED, REPEATS, DIFFER = 3, 30, 0.5
#: Items, and characters of items, of a block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20
#: Texts that are searched together, and window words that are walked together.
TEXTS, CELLS = 1000, 1 << 21
WORD = re.compile(r"\w+")
#: Bits of a window's size.
SIZE_BITS = 28
HIT = "array<struct<item_id:bigint,start:int,stop:int,distance:int,words:int>>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def budget(words: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * words + 1e-9)


def run_length(words: int, similarity: float = SIMILARITY) -> int:
    k = budget(words, similarity)
    return min(RUN, -(-(words - k) // (k + 1)))


def words_of(text: str | None) -> list[str]:
    """The words of a text, each in lower case; they stand where ``WORD`` finds them in the text itself."""
    text = text or ""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


class Hashes(dict):
    """64-bit hashes of the words met so far; emptied when it holds ``MOST``."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD[0]
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    out = h[: max(0, len(h) - n + 1)]
    for i in range(1, n):
        out = mixed(out * _ODD[1] + h[i : len(h) - n + 1 + i])
    return out


def walk(windows: np.ndarray, repeats: int, sampled: int) -> np.ndarray:
    """Signatures (windows x repeats) of windows of one size (rows of word hashes): the walk's words at the sampled steps.

    A walk has three steps for each word. At a step the word pointed at is read, and a random bit of (repeat, step,
    word) moves the pointer on; beyond the end it reads nothing. Steps are sampled by a fixed rule from (repeat, size).
    """
    count, size = windows.shape
    steps = 3 * size
    chosen = np.random.default_rng(size).integers(0, 2 * size, (repeats, sampled))
    padded = np.concatenate((windows, np.zeros((count, 1), dtype=np.uint64)), axis=1)
    at = np.zeros((count, repeats), dtype=np.int64)
    row = np.arange(count)[:, None]
    salt = mixed(np.arange(1, repeats + 1, dtype=np.uint64) * _ODD[2])
    signature = np.zeros((count, repeats), dtype=np.uint64)
    for step in range(min(steps, int(chosen.max()) + 1)):
        word = padded[row, at]
        pick = np.flatnonzero((chosen == step).any(axis=1))
        if len(pick):
            signature[:, pick] = mixed(signature[:, pick] * _ODD[3] + word[:, pick] + np.uint64(step))
        bit = (mixed((word ^ salt) + np.uint64(step * int(_ODD[1]) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), size)
    return signature


def align(item: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """The least number of word edits from the item to a stretch of the text, at most ``most``, and the stretch's end (the first best)."""
    m = len(item)
    if not m:
        return None
    places: dict[str, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = places.get(w, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        x = eq | down  # the text's start is free: no carry into the first row
        up, down = minus | (full & ~(x | plus)), plus & x
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    ids: list[int]
    words: list[list[str]]
    similarity: float = SIMILARITY

    def __post_init__(self):
        known = Hashes()
        hashes = [np.array([known[x] for x in w], dtype=np.uint64) for w in self.words]
        # pieces: item, first word, words; the last piece of a long item ends with it
        pieces = [(k, min(lo, max(0, len(w) - PIECE)), min(len(w), PIECE)) for k, w in enumerate(self.words) for lo in range(0, max(1, len(w)), PIECE)]
        self.item_of, self.first, self.sizes = (np.array(x, dtype=np.int64) for x in (zip(*pieces) if pieces else ((), (), ())))
        start = np.searchsorted(self.item_of, np.arange(len(self.words)))  # of an item's pieces
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: sorted hashes, their pieces and offsets, a bitmap
        for n in sorted({run_length(len(w), self.similarity) for w in self.words}):
            own = [k for k, w in enumerate(self.words) if run_length(len(w), self.similarity) == n]
            h = [run_hashes(hashes[k], n) for k in own]
            every, item = np.concatenate(h), np.repeat(own, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            piece = start[item] + place // PIECE
            offset = place - self.first[piece]
            order = np.argsort(every, kind="stable")
            bitmap = np.zeros(1 << 22, dtype=bool)
            bitmap[(every >> np.uint64(42)).astype(np.int64)] = True
            self.runs[n] = (every[order], piece[order], offset[order], bitmap)
        self.signatures: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by size: pieces, signatures
        for m in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == m)
            self.signatures[m] = (own, walk(np.stack([hashes[self.item_of[p]][self.first[p] : self.first[p] + m] for p in own]), REPEATS, SAMPLED))

    def windows(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the words ``h`` (of texts ``of``) and sizes of the windows that a shared run puts on a piece."""
        starts, sizes = [], []
        for n, (every, piece, offset, bitmap) in self.runs.items():
            r = run_hashes(h, n)
            hit = np.flatnonzero(bitmap[(r >> np.uint64(42)).astype(np.int64)] & (of[: len(r)] == of[n - 1 :]))
            lo, hi = np.searchsorted(every, r[hit]), np.searchsorted(every, r[hit], side="right")
            count = hi - lo
            at = np.repeat(hit, count)
            k = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            starts.append(at - offset[k])
            sizes.append(self.sizes[piece[k]])
        pair = np.unique((np.concatenate(starts) << SIZE_BITS) + np.concatenate(sizes)) if starts else np.empty(0, np.int64)
        return pair >> SIZE_BITS, pair & ((1 << SIZE_BITS) - 1)

    def candidates(self, h: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
        """(place of the window, piece) where a repeat of the walk agrees."""
        starts, sizes = self.windows(h, of)
        found = []
        for m, (own, theirs) in self.signatures.items():
            s = starts[sizes == m]
            if not len(s):
                continue
            # beyond the text's ends a window reads nothing
            text = of[np.clip(s + m // 2, 0, len(of) - 1)]
            step = max(1, min(4096, CELLS // m))
            for lo in range(0, len(s), step):
                part, owner = s[lo : lo + step], text[lo : lo + step]
                place = part[:, None] + np.arange(m)[None, :]
                inside = (place >= 0) & (place < len(h))
                place = np.clip(place, 0, len(h) - 1)
                grid = np.where(inside & (of[place] == owner[:, None]), h[place], np.uint64(0))
                ours = walk(grid, REPEATS, SAMPLED)
                pairs = set()
                for r in range(REPEATS):
                    order = np.argsort(theirs[:, r], kind="stable")
                    col = theirs[order, r]
                    a, b = np.searchsorted(col, ours[:, r]), np.searchsorted(col, ours[:, r], side="right")
                    for w in np.flatnonzero(b > a).tolist():
                        pairs.update((int(part[w]), int(own[k])) for k in order[a[w] : b[w]].tolist())
                found += pairs
        return found

    def search(self, texts: list[str | None], known: Hashes) -> list[list[dict]]:
        """The items in each text: where (code points), at how many word edits."""
        out: list[list[dict]] = [[] for _ in texts]
        for lo in range(0, len(texts), TEXTS):
            words = [words_of(t) for t in texts[lo : lo + TEXTS]]
            counts = np.array([len(w) for w in words])
            if not counts.sum() or not self.words:
                continue
            base = np.concatenate(([0], np.cumsum(counts)))
            h = np.array([x for w in words for x in map(known.__getitem__, w)], dtype=np.uint64)
            of = np.repeat(np.arange(len(words)), counts)
            tried: dict[tuple[int, int], list[int]] = {}
            for s, p in self.candidates(h, of):
                d = int(of[min(max(s + int(self.sizes[p]) // 2, 0), len(of) - 1)])
                tried.setdefault((d, int(self.item_of[p])), []).append(s - int(self.first[p]) - int(base[d]))
            for (d, k), places in sorted(tried.items()):
                item, most = self.words[k], budget(len(self.words[k]), self.similarity)
                best, stretches = None, []
                for s in sorted(places):  # stretches that touch are aligned together
                    a, b = max(0, s - most), s + len(item) + most
                    if stretches and a <= stretches[-1][1]:
                        stretches[-1][1] = max(b, stretches[-1][1])
                    else:
                        stretches.append([a, b])
                for a, b in stretches:
                    got = align(item, words[d][a : max(0, b)], most)
                    if got and (best is None or (got[0], a + got[1]) < best):
                        best = (got[0], a + got[1])
                if best:
                    # the stretch's start: the same alignment backwards from its end
                    end = best[1]
                    back = align(item[::-1], words[d][max(0, end - len(item) - most) : end][::-1], most)
                    first = end - (back[1] if back else len(item))
                    spans = [m.span() for m in WORD.finditer(texts[lo + d] or "")]
                    out[lo + d].append({"item_id": self.ids[k], "start": spans[max(0, first)][0], "stop": spans[end - 1][1], "distance": best[0], "words": len(item)})
        return out


def item_blocks(benchmark: DataFrame, similarity: float, block_items: int) -> Iterator[Items]:
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        words = [(r[0], w) for r in rows if (w := words_of(r[1]))]
        words.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Items([i for i, _ in words], [w for _, w in words], similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document row and item that it holds: doc_id, item_id, start, stop (code points), distance, words, similarity."""
    out = None
    for items in item_blocks(benchmark, similarity, block_items):
        handle = docs.sparkSession.sparkContext.broadcast(items)

        def work(batch: dict, tools: tuple) -> dict:
            return {"doc_id": batch["doc_id"], "hits": tools[0].search(batch["text"], tools[1])}

        found = map_batches(docs.select("doc_id", "text"), work, f"doc_id bigint, hits {HIT}", lambda handle=handle: (handle.value, Hashes()))
        found = found.where(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.start", "h.stop", "h.distance", "h.words", F.round(1 - F.col("h.distance") / F.col("h.words"), 6).alias("similarity"))
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    for items in item_blocks(benchmark, similarity, block_items):
        handle = docs.sparkSession.sparkContext.broadcast(items)
        docs = filter_rows(docs, lambda texts, tools: [not hits for hits in tools[0].search(texts, tools[1])], lambda handle=handle: (handle.value, Hashes()))
    return docs
