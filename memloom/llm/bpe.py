"""Operator 3, byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary gives a pre-token's only possible slot; one comparison of the
bytes there tells whether the whole pre-token is in the vocabulary. Tier two, for the misses: the bytes form a linked
list, a heap holds the mergeable neighbours by (rank, position), and a popped pair is merged if it still stands.

Defined results: a null or empty text has no tokens (hash of the empty string, no bytes). Repeated rows give repeated
results, null ids pass, other columns are ignored. Text that isn't valid UTF-16/UTF-8 can't occur in a Spark string. The
vocabulary's tables are the only broadcast; their size is that of the vocabulary file and is checked.
One pass per row, no shuffle; a worker keeps the ids of the words it has resolved, up to a fixed number, so
common words cost one dictionary lookup.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable
from functools import partial
from itertools import chain
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import map_batches

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: A vocabulary above this is refused: its tables go to every executor.
MAX_VOCABULARY = 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets; each bucket gets the first displacement that puts all its keys on free slots.

    ``slot`` of a key of the set is its own number below ``n``; of any other key, an arbitrary number below ``n``.
    """

    def __init__(self, keys: Iterable[bytes], load: float = 2.0):
        keys = list(keys)
        self.n = len(keys)
        self.buckets = max(1, int(self.n / load))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            members[(h >> 32) % self.buckets].append(h)
        if len({h for bucket in members for h in bucket}) < self.n:
            raise ValueError("two keys share a 64-bit hash")
        free = bytearray(b"\1") * self.n
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                singles += [b] * len(members[b])
                continue
            d = 0
            while True:
                slots = [self._place(h, d) for h in members[b]]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            for s in slots:
                free[s] = 0
            self.shift[b] = d
        for b, s in zip(singles, (s for s in range(self.n) if free[s])):  # a bucket of one key names its slot itself
            self.shift[b] = ~s
        self.shifts = self.shift.tolist()

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 32) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shifts[(h >> 32) % self.buckets]
        if d < 0:
            return ~d
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n


class Codec:
    """Encodes and decodes with the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(ranks)} tokens is too large to broadcast")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks the single bytes {missing}")
        self.ranks, self.pattern = ranks, pattern
        self.hash = MinimalPerfectHash(ranks)
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for token, rank in ranks.items():
            s = self.hash.slot(token)
            self.keys[s], self.ids[s] = token, rank
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.texts = [str(i) for i in range(len(self.tokens))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "known")}

    def split(self, text: str) -> list[str]:
        if "find" not in self.__dict__:
            import regex

            self.find = regex.compile(self.pattern).findall
        return self.find(text)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        slot = self.hash.slot(piece)
        if self.keys[slot] == piece:
            return (self.ids[slot],)
        return self.merge(piece)

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        if unit.isascii() and (unit[1:] if unit[:1] == " " else unit).isalpha():
            return self.encode_piece(unit.encode())  # one match of the pattern: the letters with the space before them
        return tuple(chain.from_iterable(self.encode_piece(p.encode()) for p in self.split(unit)))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, then leftmost: O(n log n) in the bytes, so a very long pre-token is no trap."""
        rank_of, n, push, pop = self.ranks.get, len(piece), heapq.heappush, heapq.heappop
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n))  # where the part before begins
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of a part with the next one
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFF
            if pair[i] != x >> 32:
                continue  # one of the two has been merged since
            mid = after[i]
            stop = after[i] = after[mid]
            before[stop] = i
            pair[mid] = -1
            r = pair[i] = rank_of(piece[i : after[stop]], -1) if stop < n else -1
            if r >= 0:
                push(heap, r << 32 | i)
            p = before[i]
            if p >= 0:
                r = pair[p] = rank_of(piece[p:stop], -1)
                if r >= 0:
                    push(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str, known: Known | None = None) -> list[int]:
        return list(chain.from_iterable(map((Known(self) if known is None else known).__getitem__, units(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: A lone space between characters that aren't white space. A pre-token holds a space at its start only, so one ends
#: before it whatever stands around it, and what follows can be split by itself.
LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
TWO_SPACES = re.compile(r"\s\s|^\s|\s$")


def units(text: str) -> list[str]:
    """Pieces of the text that end where pre-tokens end; joined they are the text."""
    if TWO_SPACES.search(text):
        return LONE_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Known(dict):
    """Ids of the units met so far, in two generations of ``MOST`` each, so that a worker's memory stays bounded."""

    MOST = 500_000

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        if (ids := self.old.get(unit)) is None:
            ids = self.codec.encode_unit(unit)
        if len(unit) <= 64:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


def codec_of(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def known_of(codec: Codec) -> Known:
    """The worker's own, kept with the broadcast codec from one task to the next."""
    if "known" not in codec.__dict__:
        codec.known = Known(codec)
    return codec.known


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _apply(batch: dict, known: Known, keep_ids: bool) -> dict:
    codec = known.codec
    out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
    for text in batch["text"]:
        ids = codec.encode(text or "", known)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(_sha(",".join(map(codec.texts.__getitem__, ids)).encode()))
        out["decoded_sha256"].append(_sha(codec.decode(ids)))
        if keep_ids:
            out["ids"].append(ids)
    return out


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the number and digest of its token ids and the digest of the decoded bytes; with ``keep_ids`` also ``ids``."""
    handle = docs.sparkSession.sparkContext.broadcast(codec_of(path, pattern))
    work = partial(_apply, keep_ids=keep_ids)
    return map_batches(docs.select("doc_id", "text"), work, SCHEMA + (", ids array<int>" if keep_ids else ""), lambda: known_of(handle.value))
