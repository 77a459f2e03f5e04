"""Lossless WebP (VP8L): a decoder for whole batches of images in lockstep, and an encoder.

The decoder reads prefix codes, literal pixels, back-references and colour-cache symbols, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images advance together, one pixel a step, each with its own bit
position; so a step's cost is a few array operations, whatever the number of images. Headers (transforms and code
lengths) are parsed once for each distinct header in the batch.

The encoder writes stretches that the image had before as back-references of any distance, repeated pixels as
colour-cache symbols, and everything else as literals, with prefix codes built once from given weights. A plan of
transforms can be asked for, or be part of an encoder (a ``Plan``): then every image has the same header.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
LENGTH_CODES, DISTANCE_CODES = 24, 40
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
OPAQUE = 0xFF000000
#: Short distances by the place of the pixel copied, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7 if y else 1, 9)), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
TABLE_BITS = 15


# ---------------------------------------------------------------- prefix codes


def code_lengths(weights: list[int], most: int = TABLE_BITS) -> list[int]:
    """Huffman code lengths; weights are flattened until no length is over ``most``."""
    used = [s for s, w in enumerate(weights) if w]
    if len(used) < 2:
        return [int(s in used) for s in range(len(weights))]
    floor = 1
    while True:
        heap = [(max(weights[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, k, y = heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, k, x + y))
        if max(lengths) <= most:
            return lengths
        floor *= 2


def canonical(lengths: list[int]) -> list[int]:
    """The code of each symbol, its bits reversed as the stream has them."""
    counts = [0] * (TABLE_BITS + 2)
    for n in lengths:
        counts[n] += 1
    counts[0] = 0
    after, code = [0] * (TABLE_BITS + 2), 0
    for n in range(1, TABLE_BITS + 1):
        code = (code + counts[n - 1]) << 1
        after[n] = code
    out = []
    for n in lengths:
        out.append(int(format(after[n], f"0{n}b")[::-1], 2) if n else 0)
        after[n] += bool(n)
    return out


def table_of(lengths: list[int]) -> np.ndarray:
    """For each value of the next ``TABLE_BITS`` bits: symbol << 4 | length. A lone symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return np.full(1 << TABLE_BITS, (used[0] if used else 0) << 4, dtype=np.int32)
    table = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
    for s, (n, code) in enumerate(zip(lengths, canonical(lengths))):
        if n:
            table[code :: 1 << n] = s << 4 | n
    if (table < 0).any():
        raise ValueError("an incomplete prefix code")
    return table


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.value, self.at = int.from_bytes(data, "little"), at

    def take(self, n: int) -> int:
        out = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return out


def write_lengths(w: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and (used or [0])[0] < 256:
        w.put(1, 1)  # simple, one symbol of 8 bits
        w.put(0, 1)
        w.put(1, 1)
        w.put((used or [0])[0], 8)
        return
    tokens, i = [], 0  # (symbol, extra bits, their number)
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        i += run
        n = lengths[i - 1]
        if n:
            tokens.append((n, 0, 0))
            run -= 1
        while run:
            if not n and run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
            elif run >= 3:
                k = min(run, 6 if n else 10)
                tokens.append((16, k - 3, 2) if n else (17, k - 3, 3))
            else:
                k = 1
                tokens.append((n, 0, 0))
            run -= k
    weights = [0] * 19
    for s, _, _ in tokens:
        weights[s] += 1
    if sum(map(bool, weights)) < 2:
        weights[0 if not weights[0] else 1] = 1
    own = code_lengths(weights, 7)
    codes = canonical(own)
    w.put(0, 1)
    w.put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(own[s], 3)
    w.put(0, 1)  # all symbols follow
    for s, extra, n in tokens:
        w.put(codes[s], own[s])
        w.put(extra, n)


def read_lengths(r: BitReader, size: int) -> list[int]:
    lengths = [0] * size
    if r.take(1):
        two, wide = r.take(1), r.take(1)
        for s in [r.take(8 if wide else 1), *([r.take(8)] if two else [])]:
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + r.take(4)):
        own[CODE_LENGTH_ORDER[k]] = r.take(3)
    left = size if not r.take(1) else 2 + r.take(2 + 2 * r.take(3))
    table, i, last = table_of(own), 0, 8
    while i < size and left:
        left -= 1
        e = int(table[(r.value >> r.at) & ((1 << TABLE_BITS) - 1)])
        r.at += e & 15
        s = e >> 4
        if s < 16:
            lengths[i] = s
            last = s or last
            i += 1
        else:
            k = 3 + r.take(2) if s == 16 else 3 + r.take(3) if s == 17 else 11 + r.take(7)
            lengths[i : i + k] = [last if s == 16 else 0] * k
            i += k
    return lengths[:size]


def prefix_of(value: int) -> tuple[int, int, int]:
    """A length or distance as its prefix symbol, extra bits, and their number."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


# ---------------------------------------------------------------- pixel data, many images in lockstep


@dataclass
class Coding:
    """How the pixels of one or more images are coded: colour-cache bits, and tables for each group of five codes."""

    cache_bits: int
    tables: list[np.ndarray]  # five, each of groups << TABLE_BITS entries
    meta_bits: int = 0
    meta: np.ndarray | None = None  # group of each block, row by row


def read_coding(r: BitReader, width: int, height: int, main: bool) -> Coding:
    cache_bits = r.take(4) if r.take(1) else 0
    meta_bits, meta, groups = 0, None, 1
    if main and r.take(1):
        meta_bits = r.take(3) + 2
        w, h = -(-width >> meta_bits), -(-height >> meta_bits)
        w, h = -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits))
        meta = ((read_image(r, w, h) >> 8) & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    tables: list[list[np.ndarray]] = [[] for _ in sizes]
    for _ in range(groups):
        for k, size in enumerate(sizes):
            tables[k].append(table_of(read_lengths(r, size)))
    return Coding(cache_bits, [np.concatenate(t) for t in tables], meta_bits, meta)


def read_image(r: BitReader, width: int, height: int) -> np.ndarray:
    """An image inside a header."""
    coding = read_coding(r, width, height, False)
    data = (r.value >> r.at).to_bytes(max(1, -(-(r.value.bit_length() - r.at) // 8)) if r.value.bit_length() > r.at else 1, "little")
    (pixels,), (bits,) = decode_pixels([data], [0], coding, [width], [width * height])
    r.at += bits
    return pixels


def decode_pixels(streams: list[bytes], at: list[int], coding: Coding, widths: list[int], sizes: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """The pixels of each stream, which begin at bit ``at``, and the bits that they take."""
    lanes = len(streams)
    order = np.argsort(-np.array(sizes), kind="stable")
    starts = np.concatenate(([0], np.cumsum([len(s) for s in streams])))[:-1]
    buffer = np.frombuffer(b"".join(streams) + b"\0" * 16, dtype=np.uint8)
    window = np.ndarray((len(buffer) - 8,), dtype="<u8", buffer=buffer, strides=(1,))
    size, width = np.array(sizes)[order], np.array(widths)[order]
    bit = (8 * starts + np.array(at))[order].astype(np.int64)
    first = bit.copy()
    green, red, blue, alpha, far = coding.tables
    mask = np.uint64((1 << TABLE_BITS) - 1)
    out = np.zeros((int(size[0]) if lanes else 0, lanes), dtype=np.uint32)
    left, back = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    cache = np.zeros((lanes, 1 << coding.cache_bits), dtype=np.uint32) if coding.cache_bits else None
    shift = np.uint32(32 - coding.cache_bits)
    near = np.array(NEAR, dtype=np.int64)
    rows = np.arange(lanes)
    last = len(window) - 1

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, last)] >> (p & 7).astype(np.uint64)

    def extra(prefix: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The value of length or distance prefixes; moves ``p`` on."""
        n = np.maximum(0, (prefix - 2) >> 1)
        more = (peek(p) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        p += n
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + more + 1)

    live = lanes
    copies = 0
    for t in range(len(out)):
        while live and size[live - 1] <= t:
            live -= 1
        if copies:
            busy = left[:live] > 0
            copies = int(busy.sum())
        if copies:
            c = np.flatnonzero(busy)
            out[t, c] = out[t - back[c], c]
            left[c] -= 1
            d = np.flatnonzero(~busy)
        else:
            d = rows[:live]
        if len(d):
            p = bit[d]
            base = 0
            if coding.meta is not None:
                y, x = np.divmod(t, width[d])
                across = -(-width[d] // (1 << coding.meta_bits))
                base = coding.meta[(y >> coding.meta_bits) * across + (x >> coding.meta_bits)] << TABLE_BITS
            e = green[base + (peek(p) & mask).astype(np.int64)]
            p = p + (e & 15)
            symbol = e >> 4
            literal = symbol < 256
            if literal.all():
                q, pick = p, slice(None)
            else:
                pick = np.flatnonzero(literal)
                q = p[pick]
            bits = peek(q)
            at_base = base if isinstance(base, int) else base[pick]
            er = red[at_base + (bits & mask).astype(np.int64)]
            n = er & 15
            eb = blue[at_base + ((bits >> n.astype(np.uint64)) & mask).astype(np.int64)]
            n = n + (eb & 15)
            ea = alpha[at_base + ((bits >> n.astype(np.uint64)) & mask).astype(np.int64)]
            n = n + (ea & 15)
            pixel = ((ea >> 4).astype(np.uint32) << 24) | ((er >> 4).astype(np.uint32) << 16) | (symbol[pick].astype(np.uint32) << 8) | (eb >> 4).astype(np.uint32)
            if isinstance(pick, slice):
                p = p + n
                out[t, d] = pixel
            else:
                p[pick] += n
                out[t, d[pick]] = pixel
                if coding.cache_bits:
                    k = np.flatnonzero(symbol >= 256 + LENGTH_CODES)
                    out[t, d[k]] = cache[d[k], symbol[k] - 256 - LENGTH_CODES]
                k = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
                if len(k):
                    own, q = d[k], p[k]
                    length = extra(symbol[k].astype(np.int64) - 256, q)
                    e = far[(base if isinstance(base, int) else base[k]) + (peek(q) & mask).astype(np.int64)]
                    q += e & 15
                    code = extra((e >> 4).astype(np.int64), q)
                    place = near[np.minimum(code, 120) - 1]
                    distance = np.where(code > 120, code - 120, np.maximum(1, place[:, 0] + place[:, 1] * width[own]))
                    if (distance > t).any():
                        raise ValueError("a back-reference before the first pixel")
                    p[k] = q
                    back[own], left[own] = distance, length - 1
                    copies = 1
                    out[t, own] = out[t - distance, own]
            bit[d] = p
        if cache is not None and live:
            pixels = out[t, :live]
            cache[rows[:live], (pixels * np.uint32(CACHE_MULTIPLIER)) >> shift] = pixels
    pixels, used = [np.empty(0, np.uint32)] * lanes, [0] * lanes
    flat = np.ascontiguousarray(out.T)
    for lane, k in enumerate(order.tolist()):
        pixels[k], used[k] = flat[lane, : size[lane]], int(bit[lane] - first[lane])
    return pixels, used


# ---------------------------------------------------------------- transforms


def channels(pixels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Alpha, red, green, blue."""
    return tuple((pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0))


def packed(a, r, g, b) -> np.ndarray:
    return ((a & 255).astype(np.uint32) << 24) | ((r & 255).astype(np.uint32) << 16) | ((g & 255).astype(np.uint32) << 8) | (b & 255).astype(np.uint32)


def _each(f, *pixels: int) -> int:
    return sum((f(*((p >> s) & 255 for p in pixels)) & 255) << s for s in (0, 8, 16, 24))


def _mean(x: int, y: int) -> int:
    return _each(lambda a, b: (a + b) >> 1, x, y)


def _clamp(x: int) -> int:
    return min(255, max(0, x))


def _select(left: int, top: int, corner: int) -> int:
    off = sum(abs(((top >> s) & 255) - ((corner >> s) & 255)) - abs(((left >> s) & 255) - ((corner >> s) & 255)) for s in (0, 8, 16, 24))
    return left if off < 0 else top


def _half(a: int, b: int) -> int:
    d = a - b
    return _clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """``right`` is the pixel above and to the right, ``corner`` the one above and to the left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), top)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, top)
        case 8:
            return _mean(corner, top)
        case 9:
            return _mean(top, right)
        case 10:
            return _mean(_mean(left, corner), _mean(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _each(lambda a, b, c: _clamp(a + b - c), left, top, corner)
        case 13:
            return _each(_half, _mean(left, top), corner)
        case _:
            return OPAQUE


def _predict(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray, undo: bool) -> np.ndarray:
    source, out = pixels.tolist(), pixels.tolist()
    known = out if undo else source
    across = -(-width // (1 << bits))
    for i in range(len(source)):
        y, x = divmod(i, width)
        if y and x:
            p = predicted(int(modes[(y >> bits) * across + (x >> bits)]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        else:
            p = known[i - width] if y else known[i - 1] if x else OPAQUE
        out[i] = _each((lambda a, b: a + b) if undo else (lambda a, b: a - b), source[i], p)
    return np.array(out, dtype=np.uint32)


#: Predictors that are inverted by sums along rows or columns where the whole image has them.
EVEN = (0, 1, 2)


def _predict_even(pixels: np.ndarray, starts: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What is left of images of one width, one after another from ``starts`` on, by one predictor of EVEN."""
    n = np.arange(len(pixels)) - np.repeat(starts, np.diff(np.append(starts, len(pixels))))
    x, y = n % width, n // width
    left = (x > 0) & ((y == 0) | (mode == 1))
    top = (y > 0) & ((x == 0) | (mode == 2))
    at = np.arange(len(pixels))
    known = np.where(left, pixels[np.maximum(at - 1, 0)], np.where(top, pixels[np.maximum(at - width, 0)], np.uint32(OPAQUE)))
    return packed(*(a.astype(np.int32) - b.astype(np.int32) for a, b in zip(channels(pixels), channels(known))))


def _unpredict_even(pixels: np.ndarray, width: int, mode: int) -> np.ndarray:
    c = np.stack(channels(pixels)).reshape(4, -1, width).astype(np.uint8)
    c[0, :1, :1] += np.uint8(255)
    c[:, 0] = np.cumsum(c[:, 0], axis=1, dtype=np.uint8)
    if mode == 2:
        c = np.cumsum(c, axis=1, dtype=np.uint8)
    else:
        c[:, :, 0] = np.cumsum(c[:, :, 0], axis=1, dtype=np.uint8)
        if mode == 1:
            c[:, 1:] = np.cumsum(c[:, 1:], axis=2, dtype=np.uint8)
        else:
            c[0, 1:, 1:] += np.uint8(255)
    return packed(*c.reshape(4, -1).astype(np.uint32))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray, undo: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    e = elements[(y >> bits) * -(-width // (1 << bits)) + (x >> bits)]
    _, red_to_blue, green_to_blue, green_to_red = (_signed(c) for c in channels(e))
    a, r, g, b = (c.astype(np.int32) for c in channels(pixels))
    sign = 1 if undo else -1
    red = (r + sign * ((green_to_red * _signed(g)) >> 5)) & 255
    first = red if undo else r  # of the pixel as it was
    blue = b + sign * (((green_to_blue * _signed(g)) >> 5) + ((red_to_blue * _signed(first)) >> 5))
    return packed(a, red, g, blue)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = (c.astype(np.int32) for c in channels(pixels))
    return packed(a, r + sign * g, g, b + sign * g)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(pixels: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    bits = bundle_bits(len(colours))
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        across = -(-width // (1 << bits))
        index = np.stack([(index >> np.uint32(each * k)) & np.uint32((1 << each) - 1) for k in range(1 << bits)], axis=1).reshape(-1, across << bits)[:, :width].reshape(-1)
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colours)] = colours
    return table[index]


def _summed(colours: np.ndarray, sign: int) -> np.ndarray:
    parts = []
    for c in channels(colours):
        c = c.astype(np.int64)
        parts.append(np.cumsum(c) if sign > 0 else np.diff(c, prepend=0))
    return packed(*parts)


# ---------------------------------------------------------------- whole images


@dataclass
class Header:
    coding: Coding
    bits: int
    value: int
    width: int
    height: int
    undo: list = field(default_factory=list)  # (transform, width before it, block bits, values), in the order to undo them

    def fits(self, width: int, height: int) -> bool:
        """Whether an image of this size whose header has the same bits has the same header."""
        if (width, height) == (self.width, self.height) or not self.undo and self.coding.meta is None:
            return True
        rows = lambda bits: -(-height // (1 << bits)) == -(-self.height // (1 << bits))
        return width == self.width and self.coding.meta is None and all(rows(bits) for kind, _, bits, _ in self.undo if kind in (PREDICTOR, CROSS_COLOUR))


class Decoder:
    """Keeps the headers it has parsed: images whose headers are bit for bit the same share one."""

    MOST = 64

    def __init__(self):
        self.headers: list[tuple[int, int, Header]] = []

    def header(self, data: bytes, width: int, height: int) -> Header:
        # the header ends well within this, unless it holds images of its own
        top = int.from_bytes(data[:4096], "little") >> 40
        for k, (bits, value, h) in enumerate(self.headers):
            if top & ((1 << bits) - 1) == value and h.fits(width, height):
                if k:
                    self.headers.insert(0, self.headers.pop(k))
                return h
        r = BitReader(data, 40)
        undo, coded = [], width
        while r.take(1):
            kind = r.take(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.take(3) + 2
                undo.insert(0, (kind, coded, bits, read_image(r, -(-coded // (1 << bits)), -(-height // (1 << bits)))))
            elif kind == PALETTE:
                colours = _summed(read_image(r, r.take(8) + 1, 1), 1)
                undo.insert(0, (kind, coded, 0, colours))
                coded = -(-coded // (1 << bundle_bits(len(colours))))
            else:
                undo.insert(0, (kind, coded, 0, None))
        coding = read_coding(r, coded, height, True)
        h = Header(coding, r.at - 40, (r.value >> 40) & ((1 << (r.at - 40)) - 1), width, height, undo)
        if len(self.headers) >= self.MOST:
            self.headers.pop()
        self.headers.insert(0, (h.bits, h.value, h))
        return h

    def decode(self, files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
        """Width, height and pixels (ARGB, row by row) of each file."""
        return [x[:3] for x in self.decode_told(files)]

    def decode_told(self, files: list[bytes]) -> list[tuple[int, int, np.ndarray, tuple[int, ...]]]:
        """As ``decode``, and the transforms that each file has."""
        found: dict[int, tuple[Header, list]] = {}
        out: list = [None] * len(files)
        for k, f in enumerate(files):
            if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != SIGNATURE:
                raise ValueError("not a lossless WebP file")
            data = f[20 : 20 + struct.unpack("<I", f[16:20])[0]]
            size = int.from_bytes(data[1:5], "little")
            width, height = (size & 16383) + 1, ((size >> 14) & 16383) + 1
            h = self.header(data, width, height)
            found.setdefault(id(h), (h, []))[1].append((k, data, width, height))
        for h, images in found.values():
            widths = [w if not h.undo else _coded_width(h, w) for _, _, w, _ in images]
            pixels, _ = decode_pixels([d for _, d, _, _ in images], [40 + h.bits] * len(images), h.coding, widths, [w * x[3] for w, x in zip(widths, images)])
            for (k, _, width, height), p in zip(images, pixels):
                for kind, own, bits, values in h.undo:
                    if kind == PREDICTOR:
                        modes = (values >> np.uint32(8)) & np.uint32(255)
                        p = _unpredict_even(p, own, int(modes[0])) if modes[0] in EVEN and (modes == modes[0]).all() else _predict(p, own, bits, modes, True)
                    elif kind == CROSS_COLOUR:
                        p = _cross(p, own, bits, values, True)
                    elif kind == SUBTRACT_GREEN:
                        p = _green(p, 1)
                    else:
                        p = _unpalette(p, own, values)
                out[k] = (width, height, p, tuple(kind for kind, *_ in h.undo))
        return out


def _coded_width(h: Header, width: int) -> int:
    for kind, _, _, values in reversed(h.undo):
        if kind == PALETTE:
            width = -(-width // (1 << bundle_bits(len(values))))
    return width


@dataclass(frozen=True)
class Plan:
    """Transforms that every image of an encoder has, each the same all over the image: ``predictor`` (a mode of EVEN), ``cross`` (colour multipliers as a pixel), ``green``."""

    predictor: int | None = None
    cross: int | None = None
    green: bool = False

    BLOCK_BITS = 9  # images of up to 512 pixels a side are one block

    def apply(self, pixels: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Images of one width, one after another from ``starts`` on."""
        if self.predictor is not None:
            pixels = _predict_even(pixels, starts, width, self.predictor)
        if self.cross is not None:
            pixels = _cross(pixels, len(pixels), 31, np.array([self.cross], dtype=np.uint32), False)
        return _green(pixels, -1) if self.green else pixels

    def write(self, w: BitWriter) -> None:
        for kind, value in ((PREDICTOR, None if self.predictor is None else OPAQUE | self.predictor << 8), (CROSS_COLOUR, self.cross)):
            if value is not None:
                w.put(1 | kind << 1, 3)
                w.put(self.BLOCK_BITS - 2, 3)
                small_image(w, np.array([value], dtype=np.uint32), False)
        if self.green:
            w.put(1 | SUBTRACT_GREEN << 1, 3)


def small_image(w: BitWriter, pixels: np.ndarray, main: bool) -> None:
    """Writes an image by its own prefix codes, all literals."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    a, r, g, b = (c.astype(np.int64) for c in channels(pixels))
    lengths = [code_lengths(np.bincount(c, minlength=size).tolist()) for c, size in ((g, 256 + LENGTH_CODES), (r, 256), (b, 256), (a, 256))]
    for x in (*lengths, [1] + [0] * (DISTANCE_CODES - 1)):
        write_lengths(w, x)
    codes = [canonical(x) for x in lengths]
    lone = [sum(map(bool, x)) < 2 for x in lengths]
    for values in zip(g.tolist(), r.tolist(), b.tolist(), a.tolist()):
        for v, code, length, one in zip(values, codes, lengths, lone):
            if not one:
                w.put(code[v], length[v])


def palette_file(width: int, height: int, pixels: np.ndarray, colours: np.ndarray) -> bytes:
    """An image of few colours by a palette, with prefix codes of its own."""
    w = BitWriter()
    w.put(1 | PALETTE << 1, 3)
    w.put(len(colours) - 1, 8)
    small_image(w, _summed(colours, -1), False)
    w.put(0, 1)
    small_image(w, _to_palette(pixels, width, colours), True)
    return riff(width, height, w.value.to_bytes(-(-w.n // 8), "little"))


def riff(width: int, height: int, body: bytes) -> bytes:
    top = SIGNATURE | (width - 1) << 8 | (height - 1) << 22 | 1 << 36
    data = top.to_bytes(5, "little") + body
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


class Encoder:
    """Writes images with prefix codes from ``weights`` (of the 256 sample values, or four lists for green, red, blue and alpha), the same for every image."""

    SHORTEST = 4  # pixels of a back-reference
    LONGEST = 4096

    def __init__(self, weights: list, cache_bits: int = 7, cache_share: float = 0.3, run_share: float = 0.002, plan: Plan = Plan()):
        channel = [weights] * 4 if isinstance(weights[0], int) else weights
        total = sum(channel[0])
        self.cache_bits, self.plan = cache_bits, plan
        green = [max(1, round(w * 1000)) for w in channel[0]]
        green += [max(1, round(total * 1000 * run_share / LENGTH_CODES))] * LENGTH_CODES
        green += [max(1, round(total * 1000 * cache_share / (1 << cache_bits)))] * ((1 << cache_bits) if cache_bits else 0)
        far = [8 if s < 8 else 4 if 12 < s < 24 else 1 for s in range(DISTANCE_CODES)]  # the pixel before, and distances within an image
        self.lengths = [code_lengths(green, 14), *[code_lengths([max(1, w) for w in x], 14) for x in channel[1:]], code_lengths(far, 14)]
        self.codes = [np.array(canonical(x), dtype=np.uint64) for x in self.lengths]
        self.sizes = [np.array(x, dtype=np.int64) for x in self.lengths]
        w = BitWriter()
        self.coding(w, True)
        self.header_bits = w.n

    def coding(self, w: BitWriter, main: bool) -> None:
        w.put(int(self.cache_bits > 0), 1)
        if self.cache_bits:
            w.put(self.cache_bits, 4)
        if main:
            w.put(0, 1)  # one group of codes
        for x in self.lengths:
            write_lengths(w, x)

    def costs(self, pixels: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Bits of each image's header and of its pixels as literals."""
        a, r, g, b = channels(self.plan.apply(pixels, starts, width))
        return self.header_bits + np.add.reduceat(sum(size[c] for size, c in zip(self.sizes, (g, r, b, a))), starts)

    def references(self, lane: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and distance of stretches that the same image had before: the last earlier place of four equal pixels, as long as the distance holds."""
        n = len(pixels)
        none = np.empty(0, dtype=np.int64)
        if n <= self.SHORTEST:
            return none, none, none
        key = lane[: n - 3].astype(np.uint64)
        for k in range(4):
            key = (key ^ pixels[k : n - 3 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (lane[a] == lane[b + 3]) & (lane[a + 3] == lane[a])
        for k in range(4):
            same &= pixels[a + k] == pixels[b + k]
        back = np.zeros(n + 1, dtype=np.int64)
        back[b[same]] = (b - a)[same]
        edge = np.flatnonzero(np.diff(back, prepend=0))
        starts, stops = edge[:-1], edge[1:]
        live = back[starts] > 0
        starts, stops, far = starts[live], stops[live] + 3, back[starts[live]]
        out, reach = [], 0
        for s, e, d in zip(starts.tolist(), stops.tolist(), far.tolist()):
            s = max(s, reach)
            while e - s >= self.SHORTEST:
                k = min(e - s, self.LONGEST)
                out.append((s, k, d))
                s += k
                reach = s
        found = np.array(out, dtype=np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]

    def tokens(self, lane: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits, their number, and the lane of each symbol of the concatenated images."""
        n = len(pixels)
        starts, lengths, far = self.references(lane, pixels)
        inside = np.zeros(n + 1, dtype=np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + lengths, -1)
        copied = np.cumsum(inside[:-1]) > 0
        _, red, green, blue = channels(pixels)
        alpha = pixels >> np.uint32(24)
        code, size = self.codes, self.sizes
        bits, length = code[0][green].copy(), size[0][green].copy()
        for k, c in ((1, red), (2, blue), (3, alpha)):
            bits |= code[k][c] << length.astype(np.uint64)
            length += size[k][c]
        if self.cache_bits:
            slot = ((pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - self.cache_bits)).astype(np.int64)
            key = (lane << self.cache_bits) | slot
            order = np.argsort(key, kind="stable")
            hit = np.zeros(n, dtype=bool)
            hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
            at = 256 + LENGTH_CODES + slot[hit]
            bits[hit], length[hit] = code[0][at], size[0][at]
        for a, k, d in zip(starts.tolist(), lengths.tolist(), far.tolist()):
            word = used = 0
            for table, base, (prefix, extra, more) in ((0, 256, prefix_of(k)), (4, 0, prefix_of(2 if d == 1 else d + 120))):
                word |= (int(code[table][base + prefix]) | extra << int(size[table][base + prefix])) << used
                used += int(size[table][base + prefix]) + more
            bits[a], length[a] = word, used
        first = np.zeros(n, dtype=bool)
        first[starts] = True
        keep = ~copied | first
        return bits[keep], length[keep], lane[keep]

    def pixel_bits(self, images: list[np.ndarray], head: list[int]) -> list[np.ndarray]:
        """The pixel data of each image as bytes, after ``head`` empty bits."""
        lane = np.repeat(np.arange(len(images)), [len(x) for x in images])
        bits, length, of = self.tokens(lane, np.concatenate(images))
        used = np.bincount(of, weights=length, minlength=len(images)).astype(np.int64) + np.array(head)
        room = (used + 7) // 8 + 8
        base = np.concatenate(([0], np.cumsum(room)))
        ends = np.cumsum(length)
        counts = np.bincount(of, minlength=len(images))
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        before = (ends - length) - np.repeat((ends - length)[np.minimum(first, len(ends) - 1)], counts)
        place = 8 * base[:-1][of] + np.array(head)[of] + before
        value = bits << (place & 7).astype(np.uint64)
        at = place >> 3
        out = np.zeros(base[-1])
        for k in range(8):
            out += np.bincount(at + k, weights=((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.float64), minlength=base[-1])[: base[-1]]
        out = out.astype(np.uint8)
        return [out[a : a + -(-u // 8)] for a, u in zip(base.tolist(), used.tolist())]

    def encode(self, images: list[tuple[int, int, np.ndarray]], transforms: tuple = ()) -> list[bytes]:
        """``images``: width, height, ARGB pixels. ``transforms``: (kind, block bits, values) in the order to apply them; values are a block image, or a palette."""
        heads, coded = [], []
        plain = None
        for width, height, pixels in images:
            if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and len(pixels) == width * height):
                raise ValueError(f"an image of {width} x {height} with {len(pixels)} pixels")
            if plain is None or transforms:
                w, across = BitWriter(), width
                if not transforms:
                    self.plan.write(w)
                for kind, bits, values in transforms:
                    w.put(1 | kind << 1, 3)
                    if kind in (PREDICTOR, CROSS_COLOUR):
                        w.put(bits - 2, 3)
                        small_image(w, np.asarray(values, dtype=np.uint32), False)
                        pixels = _predict(pixels, across, bits, (values >> np.uint32(8)) & np.uint32(255), False) if kind == PREDICTOR else _cross(pixels, across, bits, values, False)
                    elif kind == SUBTRACT_GREEN:
                        pixels = _green(pixels, -1)
                    else:
                        w.put(len(values) - 1, 8)
                        small_image(w, _summed(values, -1), False)
                        pixels = _to_palette(pixels, across, values)
                        across = -(-across // (1 << bundle_bits(len(values))))
                w.put(0, 1)
                self.coding(w, True)
                plain = w
            heads.append(plain)
            coded.append(pixels)
        if coded and not transforms and self.plan != Plan():
            starts = np.concatenate(([0], np.cumsum([len(x) for x in coded])[:-1]))
            (width,) = {w for w, _, _ in images}
            coded = np.split(self.plan.apply(np.concatenate(coded), starts, width), starts[1:])
        bodies = self.pixel_bits(coded, [40 + w.n for w in heads]) if coded else []
        out = []
        for (width, height, _), w, body in zip(images, heads, bodies):
            top = (SIGNATURE | (width - 1) << 8 | (height - 1) << 22 | 1 << 36) | w.value << 40
            front = top.to_bytes(-(-(40 + w.n) // 8), "little")
            data = bytearray(body.tobytes())
            data[: len(front) - 1] = front[:-1]
            data[len(front) - 1 : len(front)] = bytes([(data[len(front) - 1] if len(data) >= len(front) else 0) | front[-1]])
            if len(data) & 1:
                data.append(0)
            out.append(b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + bytes(data))
        return out


def _to_palette(pixels: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    order = np.argsort(colours, kind="stable")
    found = np.minimum(np.searchsorted(colours[order], pixels), len(colours) - 1)
    if (colours[order][found] != pixels).any():
        raise ValueError("a colour outside the palette")
    index = order[found].astype(np.uint32)
    bits = bundle_bits(len(colours))
    if bits:
        rows = np.pad(index.reshape(-1, width), ((0, 0), (0, -width % (1 << bits))))
        rows = rows.reshape(len(rows), -1, 1 << bits)
        index = sum(rows[:, :, k] << np.uint32((8 >> bits) * k) for k in range(1 << bits)).reshape(-1)
    return np.uint32(OPAQUE) | index.astype(np.uint32) << np.uint32(8)
