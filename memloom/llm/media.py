"""Operator 4, media columns: texts stored as lossless WebP images and read back as pixel arrays.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are the samples of images 48 pixels wide (a
row is 192 bytes: blue, green, red, alpha) and at most ``ROWS`` rows high; the stored form is these files one after
another. An image of at most ``FEW`` colours has a palette; any other takes the one of ``PLANS`` that needs the fewest
bits for its pixels: none of the transforms for prose, subtracted green for figures and capitals, a predictor for
scripts of longer characters, a predictor with cross-colour for rows that repeat from byte to byte. Back-references and
the colour cache serve all of them. Reading finds the files by their RIFF sizes and decodes those of one header together
(``webp``). Features come from the decoded pixels: the number of images and rows, the mean of each channel, and an
average hash of an 8 x 8 grid; beside the contract's columns stand the numbers of images by transform, as read back.

Defined results: null and empty texts give one row of spaces. Equal texts give equal values. Repeated rows give repeated
results; ids may be null; other input columns are ignored. One pass per row without a shuffle; a batch's images are coded
``GROUP`` at a time, whatever the texts' lengths, which bounds memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches
from .webp import CROSS_COLOUR, OPAQUE, PALETTE, PREDICTOR, SUBTRACT_GREEN, Decoder, Encoder, Plan, palette_file

UNIT, WIDTH, ROWS = 192, 48, 32
#: Images that are coded together; each has at most WIDTH * ROWS pixels.
GROUP = 3000
#: Colours of an image that a palette holds, four to a pixel's sample.
FEW = 4
SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "n_predictor int, n_cross int, n_green int, n_palette int"
)


def sample_weights() -> list[int]:
    """How often a byte is expected, by what it is: space, letters by frequency, capitals, digits, marks, bytes of longer characters."""
    weights = [2] * 256
    for n, c in enumerate("etanoirshdlucmpgbfywvkjxqz"):
        weights[ord(c)] = max(30, int(2400 * 0.85**n))
        weights[ord(c.upper())] = max(6, int(60 * 0.9**n))
    weights[32] = 4000
    for c in b"0123456789":
        weights[c] = 30
    for c in b".,\n":
        weights[c] = 200
    for c in b"!$%&*#|'\"-:;":
        weights[c] = 40
    for c in range(128, 192):
        weights[c] = 12
    weights[195] = 300
    return weights


def figure_weights() -> list[int]:
    """Digits and capitals, with marks between them."""
    weights = [2] * 256
    for c in range(33, 127):
        weights[c] = 60
    for c in b"0123456789":
        weights[c] = 600
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        weights[c] = 250
    weights[32] = 300
    return weights


def difference_weights(reach: int) -> list[int]:
    """Differences around zero, each weight half of zero's at ``reach``."""
    return [max(2, 4000 * reach // (reach + min(d, 256 - d))) for d in range(256)]


#: Transforms and the weights that go with them.
PLANS = (
    (Plan(), sample_weights),
    (Plan(green=True), lambda: [figure_weights(), difference_weights(12), difference_weights(12), figure_weights()]),
    (Plan(predictor=1), lambda: [difference_weights(8)] * 4),
    (Plan(predictor=2, cross=OPAQUE | 32), lambda: [difference_weights(2)] * 4),
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


class MediaCodec:
    def __init__(self):
        self.encoders, self.decoder = [Encoder(weights(), plan=plan) for plan, weights in PLANS], Decoder()

    def encode(self, images: list[tuple[int, int, np.ndarray]]) -> list[bytes]:
        """The file of each image, by a palette or by the plan that needs the fewest bits."""
        files: list = [None] * len(images)
        rest = []
        for k, (width, height, pixels) in enumerate(images):
            # an image of few colours shows few in any 64 of its pixels
            if len(set(pixels[:64].tolist())) <= FEW and len(colours := np.unique(pixels)) <= FEW:
                files[k] = palette_file(width, height, pixels, colours)
            else:
                rest.append(k)
        if rest:
            whole = np.concatenate([images[k][2] for k in rest])
            starts = np.concatenate(([0], np.cumsum([len(images[k][2]) for k in rest])[:-1]))
            best = np.argmin([e.costs(whole, starts, WIDTH) for e in self.encoders], axis=0)
            for n, encoder in enumerate(self.encoders):
                own = [k for k, b in zip(rest, best.tolist()) if b == n]
                for k, f in zip(own, encoder.encode([images[k] for k in own])):
                    files[k] = f
        return files

    def store(self, payloads: list[bytes]) -> list[bytes]:
        images, of = [], []
        for k, p in enumerate(payloads):
            pixels = np.frombuffer(p, dtype="<u4")
            for lo in range(0, len(pixels), WIDTH * ROWS):
                part = pixels[lo : lo + WIDTH * ROWS]
                images.append((WIDTH, len(part) // WIDTH, part))
                of.append(k)
        files = [f for lo in range(0, len(images), GROUP) for f in self.encode(images[lo : lo + GROUP])]
        media: list[list[bytes]] = [[] for _ in payloads]
        for k, f in zip(of, files):
            media[k].append(f)
        return [b"".join(x) for x in media]

    def read(self, media: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, ...]]]]:
        """The pixels of each stored value, rows of WIDTH, and the transforms of each of its images."""
        files = [split_files(m) for m in media]
        every = [f for x in files for f in x]
        images = [i[2:] for lo in range(0, len(every), GROUP) for i in self.decoder.decode_told(every[lo : lo + GROUP])]
        out, at = [], 0
        for x in files:
            own = images[at : at + len(x)]
            out.append((np.concatenate([p for p, _ in own]) if len(x) != 1 else own[0][0], [t for _, t in own]))
            at += len(x)
        return out


def feature(pixels: np.ndarray, n_images: int) -> str:
    rows = pixels.reshape(-1, WIDTH)
    samples = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), WIDTH, 4)
    means = samples.sum(axis=(0, 1), dtype=np.int64) * 100 // (len(rows) * WIDTH)
    grey = np.add.reduceat(samples.sum(axis=2, dtype=np.int64), np.arange(0, WIDTH, 6), axis=1)
    edges = np.arange(8) * len(rows) // 8
    grid = np.add.reduceat(grey, edges, axis=0) * 840 // np.maximum(1, np.diff(np.append(edges, len(rows))))[:, None]
    bits = np.packbits(grid.ravel() * 64 > grid.sum())
    return f"{n_images}x{len(rows)}:{':'.join(map(str, means.tolist()))}:{bits.tobytes().hex()}"


COUNTED = {"n_predictor": PREDICTOR, "n_cross": CROSS_COLOUR, "n_green": SUBTRACT_GREEN, "n_palette": PALETTE}


def _work(batch: dict, codec: MediaCodec) -> dict:
    made = [payload_of(t) for t in batch["text"]]
    out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *COUNTED)}
    media = codec.store([p for _, p in made])
    for m, (pixels, transforms) in zip(media, codec.read(media)):
        back = pixels.astype("<u4", copy=False).tobytes()
        out["payload_bytes"].append(len(back))
        out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
        out["tail_crc32"].append(zlib.crc32(back[-16:]))
        out["media_bytes"].append(len(m))
        out["media_sha256"].append(hashlib.sha256(m).hexdigest())
        out["feature"].append(feature(pixels, -(-len(pixels) // (WIDTH * ROWS))))
        for name, kind in COUNTED.items():
            out[name].append(sum(kind in x for x in transforms))
    return out | {"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in made]}


def media_round_trip(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the stored form's and the read-back payload's sizes and digests, and features of the pixels."""
    return map_batches(docs.select("doc_id", "text"), _work, SCHEMA, MediaCodec)
