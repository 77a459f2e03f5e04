"""Operator 1, secret scans: sliding-window Shannon entropy per character class, with allow-list suppression.

Three rule kinds (``assign``, ``access``, ``hex``) give base spans. Beside them, every candidate string (a long run of
token characters) is scanned once per character class: a window slides along each run of the class, its symbol counts
and entropy sum are updated by the one character that enters and the one that leaves, and windows whose entropy reaches
the class's threshold are merged into spans of kind ``entropy_<class>``. Allow-listed candidates give no entropy span;
base spans always stay.

Defined results: a null or empty text has no spans (counts 0, the hash of the empty string, ``spans`` empty). Repeated
rows give repeated results; ids may be null; other input columns are ignored. The work is one pass per row without a
shuffle, so neither keys nor copies can skew it; memory is bounded by one Arrow batch.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is too short for its kind can't hold a longer one, so the lengths are part of these two patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"


@dataclass(frozen=True)
class CharacterClass:
    """Characters that a secret of this kind is drawn from, and the bits a character that a window must hold."""

    name: str
    characters: str
    window: int
    bits: float


#: Entropy of 20 draws from 64 symbols is about 4.05 bits on average; prose words and paths stay well below.
CLASSES = (
    CharacterClass("hex", "0123456789abcdefABCDEF", 24, 3.3),
    CharacterClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 24, 3.9),
)
#: Candidates that look random but aren't secrets: UUIDs, words in one case, path-like or snake-case names, plain numbers.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z]?[a-z]+",
    r"[A-Z]+",
    r"[A-Za-z]?[a-z]*+(?:[_/-]++[A-Za-z]?[a-z]*+)++",  # possessive: what ends a part can't begin it again, so no other way of cutting can match
    r"[0-9_+=/-]+",
    r".*(?:EXAMPLE|example|changeme|placeholder).*",
)


class EntropyScanner:
    """Finds high-entropy windows of candidate strings."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [(c, re.compile(f"[{re.escape(c.characters)}]{{{c.window},}}")) for c in classes]
        shortest = min((c.window for c in classes), default=1)
        every = "".join(sorted({x for c in classes for x in c.characters})) or "A"
        self.candidate = re.compile(f"[{re.escape(every)}]{{{shortest},}}")
        self.allowed = [re.compile(x) for x in allowed]

    def windows(self, run: str, window: int, bits: float) -> list[tuple[int, int]]:
        """Merged [start, end) of the windows of ``run`` with at least ``bits`` of entropy a character.

        H = log2(w) - sum(c log2 c) / w over the counts c; a step changes two counts only.
        """
        term = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]  # one more: a character enters before another leaves
        most = window * (math.log2(window) - bits)
        counts: dict[str, int] = {}
        total = 0.0
        found: list[tuple[int, int]] = []
        for i, x in enumerate(run):
            c = counts.get(x, 0)
            counts[x] = c + 1
            total += term[c + 1] - term[c]
            if i >= window:
                y = run[i - window]
                c = counts[y]
                counts[y] = c - 1
                total += term[c - 1] - term[c]
            if i >= window - 1 and total <= most + 1e-9:
                start = i - window + 1
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
        return found

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in self.candidate.finditer(text):
            run = m[0]
            if any(x.fullmatch(run) for x in self.allowed):
                continue
            for c, pattern in self.classes:
                for part in pattern.finditer(run):
                    if not any(x.fullmatch(part[0]) for x in self.allowed):
                        found += [(m.start() + part.start() + a, m.start() + part.start() + b, f"entropy_{c.name}") for a, b in self.windows(part[0], c.window, c.bits)]
        return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, str]], order: dict[str, int]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan_secrets(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, the digest of the base spans, and all spans in code points."""
    order = {k: n for n, k in enumerate([*KINDS, *(f"entropy_{c.name}" for c in classes)])}

    def work(batch: dict, scanner: EntropyScanner) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")}
        for text in batch["text"]:
            base = base_spans(text or "")
            more = scanner.scan(text or "")
            kinds = [k for _, _, k in base]
            for k in KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base, order).encode()).hexdigest())
            out["spans"].append(joined(base + more, order))
            out["n_entropy"].append(len(more))
        return out | {"doc_id": batch["doc_id"]}

    return map_batches(docs.select("doc_id", "text"), work, SCHEMA, lambda: EntropyScanner(classes, allowed))
