"""Operators that work row by row: secrets, BPE, media, decontamination, main text."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, decontaminate, html, media, queries, secrets, webp

TEXTS = [None, "", " ", "a", "token: abc123def", 'x api_key="AbC.123/=" PASSWORD = hunter22', "AKIA" + "A1" * 10, "é" * 3 + "0123456789abcdef" * 3, "secret=token:abcdefg", "word " * 3000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n if n % 5 else None, t, "en", 1.5, "x") for n, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, spans string")


def slow_base(text):
    text = text or ""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def check_secrets(rows, texts):
    for r, t in zip(rows, texts):
        base = slow_base(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in base) for x in ("assign", "access", "hex"))
        said = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(said) <= set(spans) and all(0 <= int(a) < int(b) <= len(t) for _, a, b in (x.split(":") for x in spans))


def test_secrets_against_plain_rules(docs):
    check_secrets(secrets.scan_secrets(docs).collect(), TEXTS)


def test_secrets_over_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    check_secrets(rows, [texts[r.doc_id] for r in rows])


def test_entropy_windows_equal_recounted_ones():
    import math
    from collections import Counter

    rng, scanner = random.Random(1), secrets.EntropyScanner()
    for _ in range(200):
        run = "".join(rng.choice("abcdefgh0123XYZ"[: rng.randint(1, 15)]) for _ in range(rng.randint(8, 60)))
        covered = set()
        for i in range(len(run) - 7):
            h = -sum(c / 8 * math.log2(c / 8) for c in Counter(run[i : i + 8]).values())
            if h >= 2.4 - 1e-9:
                covered |= set(range(i, i + 8))
        assert covered == {i for a, b in scanner.windows(run, 8, 2.4) for i in range(a, b)}


def test_entropy_finds_keys_and_spares_words():
    scanner = secrets.EntropyScanner()
    key = base64.b64encode(hashlib.sha256(b"k").digest()).decode()
    assert scanner.scan(f"see {key} here")
    assert not scanner.scan("internationalization_of_everything 123e4567-e89b-12d3-a456-426614174000 " + "a" * 80)


def small_codec():
    import public_tokenizers

    return bpe.codec_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal():
    keys = [str(n).encode() for n in range(5000)]
    h = bpe.MinimalPerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(5000)) and 0 <= h.slot(b"other") < 5000
    assert bpe.MinimalPerfectHash([]).n == 0


def test_bpe_equals_tiktoken(spark, sf):
    import public_tokenizers
    import tiktoken

    codec = small_codec()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng, known = random.Random(2), bpe.Known(codec)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\tab1.é'sS \x1c中½ıﬁ") for _ in range(rng.randint(0, 16)))
        assert codec.encode(t, known) == reference.encode_ordinary(t)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_forgets_and_still_agrees():
    codec = small_codec()
    known = bpe.Known(codec)
    known.MOST = 3
    text = "one two three four five six seven eight one two three " * 4 + "y" * 3000
    assert codec.encode(text, known) == codec.encode(text) and len(known) <= 3
    assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_edge_rows(docs):
    import public_tokenizers

    rows = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).collect()
    assert [r.decoded_sha256 for r in rows] == [hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS]
    assert rows[0].n_tokens == 0 and rows[0].ids == [] and rows[-1].ids == rows[-2].ids
    assert bpe.bpe_round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def image(rng, w, h, colours=None):
    p = rng.integers(0, 2**32, w * h, dtype=np.uint64).astype(np.uint32)
    return w, h, rng.choice(p[:colours], w * h) if colours else p


@pytest.mark.parametrize("cache_bits", [0, 4, 9])
def test_webp_round_trips_with_every_transform(cache_bits):
    rng = np.random.default_rng(3)
    encoder = webp.Encoder([1] * 256, cache_bits)
    for case in (image(rng, 5, 7), image(rng, 48, 3, 3), image(rng, 1, 1), image(rng, 13, 9, 20)):
        w, h, p = case
        modes = np.uint32(webp.OPAQUE) | (rng.integers(0, 14, (-(-w // 4)) * (-(-h // 4))).astype(np.uint32) << np.uint32(8))
        cross = rng.integers(0, 2**32, (-(-w // 8)) * (-(-h // 8)), dtype=np.uint64).astype(np.uint32)
        plans = [(), ((webp.SUBTRACT_GREEN, 0, None),), ((webp.PREDICTOR, 2, modes),), ((webp.CROSS_COLOUR, 3, cross),), ((webp.SUBTRACT_GREEN, 0, None), (webp.PREDICTOR, 2, modes), (webp.CROSS_COLOUR, 3, cross))]
        if len(np.unique(p)) <= 256:
            plans.append(((webp.PALETTE, 0, np.unique(p)),))
        for plan in plans:
            ((a, b, q),) = webp.Decoder().decode(encoder.encode([case], plan))
            assert (a, b) == (w, h) and (q == p).all(), plan


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_mode(mode):
    rng = np.random.default_rng(mode)
    case = image(rng, 11, 6)
    modes = np.full(6, webp.OPAQUE | mode << 8, dtype=np.uint32)
    ((_, _, p),) = webp.Decoder().decode(webp.Encoder([1] * 256).encode([case], ((webp.PREDICTOR, 2, modes),)))
    assert (p == case[2]).all()


def test_many_images_together():
    rng = np.random.default_rng(4)
    many = [image(rng, int(rng.integers(1, 30)), int(rng.integers(1, 30)), int(rng.integers(1, 50))) for _ in range(200)]
    got = webp.Decoder().decode(webp.Encoder([1] * 256).encode(many))
    assert all((a[2] == b[2]).all() for a, b in zip(got, many))


def test_a_far_back_reference_and_meta_codes():
    # written by hand: two literals, then a copy from two pixels back, with one group of codes chosen by a meta image
    w = webp.BitWriter()
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no cache
    w.put(1, 1)  # meta codes, blocks of 4
    w.put(0, 3)
    w.put(0, 1)  # the meta image: no cache, five codes of one symbol
    for _ in range(5):
        webp.write_lengths(w, [1])
    green = [0] * 280
    green[10] = green[20] = green[256 + 3] = 2
    green[30] = 2
    webp.write_lengths(w, green)
    for _ in range(3):
        webp.write_lengths(w, [1] + [0] * 255)
    far = [0] * 40
    far[13] = 1
    webp.write_lengths(w, far)
    codes = webp.canonical(green)
    for s in (10, 20):
        w.put(codes[s], 2)
    w.put(codes[256 + 3], 2)  # four pixels
    prefix, extra, n = webp.prefix_of(120 + 2)
    assert prefix == 13
    w.put(extra, n)
    top = (webp.SIGNATURE | 5 << 8 | 0 << 22 | 1 << 36) | w.value << 40
    data = top.to_bytes(-(-(40 + w.n) // 8), "little")
    file = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    ((_, _, p),) = webp.Decoder().decode([file])
    assert ((p >> 8) & 255).tolist() == [10, 20, 10, 20, 10, 20]


class PlainDecoder:
    """A second, plain reader of lossless WebP, symbol by symbol; block images must be a single pixel."""

    def __init__(self, data):
        self.bits, self.at = int.from_bytes(data, "little"), 0

    def take(self, n):
        out = self.bits >> self.at & (1 << n) - 1
        self.at += n
        return out

    def prefix_code(self, lengths):
        used = [k for k, n in enumerate(lengths) if n]
        if len(used) < 2:
            return {(0, 0): used[0] if used else 0}
        out, code = {}, 0
        for n in range(1, 16):
            for k in used:
                if lengths[k] == n:
                    out[n, code] = k
                    code += 1
            code <<= 1
        return out

    def symbol(self, code):
        n = value = 0
        while (n, value) not in code:
            value, n = value << 1 | self.take(1), n + 1
            assert n < 16
        return code[n, value]

    def read_code(self, size):
        if self.take(1):
            two, wide = self.take(1), self.take(1)
            used = [self.take(8 if wide else 1)] + [self.take(8) for _ in range(two)]
            return self.prefix_code([int(k in used) for k in range(size)])
        own = [0] * 19
        for k in range(4 + self.take(4)):
            own[[17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][k]] = self.take(3)
        assert not self.take(1)
        code, out, last = self.prefix_code(own), [], 8
        while len(out) < size:
            s = self.symbol(code)
            if s < 16:
                out.append(s)
                last = s or last
            else:
                out += [last] * (3 + self.take(2)) if s == 16 else [0] * ((3 + self.take(3)) if s == 17 else (11 + self.take(7)))
        return self.prefix_code(out)

    def value(self, s):
        return s + 1 if s < 4 else (2 + s % 2 << s // 2 - 1) + self.take(s // 2 - 1) + 1

    def image(self, width, height, main):
        cache = [0] * (1 << self.take(4)) if self.take(1) else []
        assert not main or not self.take(1)
        green, red, blue, alpha, far = (self.read_code(n) for n in (280 + len(cache), 256, 256, 256, 40))
        out = []
        slot = lambda p: (p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - (len(cache).bit_length() - 1)
        while len(out) < width * height:
            s = self.symbol(green)
            if s < 256:
                r, b, a = self.symbol(red), self.symbol(blue), self.symbol(alpha)
                new = [a << 24 | r << 16 | s << 8 | b]
            elif s < 280:
                n, d = self.value(s - 256), self.value(self.symbol(far))
                assert d > 120 or d == 2  # the pixel before
                d = d - 120 if d > 120 else 1
                period = out[-d:]
                new = [period[k % d] for k in range(n)]
            else:
                new = [cache[s - 280]]
            out += new
            for p in new if cache else ():
                cache[slot(p)] = p
        return out

    def decode(self):
        assert self.take(8) == 0x2F
        width, height = self.take(14) + 1, self.take(14) + 1
        self.take(4)
        undo, across = [], width
        while self.take(1):
            kind = self.take(2)
            if kind < 2:
                assert max(width, height) <= 1 << self.take(3) + 2
                undo.append((kind, self.image(1, 1, False)[0]))
            elif kind == 2:
                undo.append((kind, None))
            else:
                n = self.take(8) + 1
                steps = self.image(n, 1, False)
                colours = [tuple(sum(c >> s & 255 for c in steps[: k + 1]) & 255 for s in (24, 16, 8, 0)) for k in range(n)]
                undo.append((kind, colours))
                each = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
                across = -(-width // each)
        pixels = [tuple(p >> s & 255 for s in (24, 16, 8, 0)) for p in self.image(across, height, True)]
        signed = lambda x: x - 256 if x > 127 else x
        for kind, value in reversed(undo):
            if kind == 2:
                pixels = [(a, r + g & 255, g, b + g & 255) for a, r, g, b in pixels]
            elif kind == 1:
                rb, gb, gr = (signed(value >> s & 255) for s in (16, 8, 0))
                pixels = [(a, x := r + (gr * signed(g) >> 5) & 255, g, b + (gb * signed(g) >> 5) + (rb * signed(x) >> 5) & 255) for a, r, g, b in pixels]
            elif kind == 0:
                mode, out = value >> 8 & 255, []
                for k, p in enumerate(pixels):
                    known = (255, 0, 0, 0) if not k else out[-1] if k < width or k % width and mode == 1 else out[-width]
                    out.append(tuple(x + y & 255 for x, y in zip(p, known)))
                pixels = out
            else:
                wide, each = 8 // (8 if len(value) <= 2 else 4 if len(value) <= 4 else 2 if len(value) <= 16 else 1), width and -(-width // across)
                pixels = [value[pixels[y * across + x // each][2] >> wide * (x % each) & (1 << wide) - 1] for y in range(height) for x in range(width)]
        return width, height, pixels


def test_stored_files_by_a_second_decoder():
    rng = random.Random(6)
    texts = [None, "a", "short one", "x" * 5000, "01AF" * 300, "".join(rng.choices("0123456789ABCDEF", k=900)), "словарь и книга " * 40, "".join(rng.choices("бвгджзклмнпрст", k=500)), "plain words of a text, " * 90, "漢字とかな" * 60]
    texts += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(n)) for n in (5, 60, 400)]
    codec = media.MediaCodec()
    kinds = set()
    for t, m, (pixels, told) in zip(texts, codec.store([media.payload_of(t)[1] for t in texts]), codec.read(codec.store([media.payload_of(t)[1] for t in texts]))):
        got = b""
        for f in media.split_files(m):
            width, height, plain = PlainDecoder(f[20:]).decode()
            assert len(plain) == width * height
            got += b"".join(bytes((b, g, r, a)) for a, r, g, b in plain)
        assert got == media.payload_of(t)[1] == pixels.astype("<u4").tobytes()
        kinds.update(k for x in told for k in x)
    assert kinds == {webp.PREDICTOR, webp.SUBTRACT_GREEN, webp.PALETTE} or kinds == {0, 1, 2, 3}


@pytest.mark.parametrize("plan", [webp.Plan(0), webp.Plan(1), webp.Plan(2), webp.Plan(green=True), webp.Plan(2, 0x12345678, True), webp.Plan(1, webp.OPAQUE | 0xE0F0)])
def test_plans_round_trip(plan):
    rng = np.random.default_rng(5)
    many = [image(rng, 48, int(rng.integers(1, 32)), int(rng.integers(1, 90))) for _ in range(40)]
    files = webp.Encoder([1] * 256, plan=plan).encode(many)
    decoder = webp.Decoder()
    assert all((a[2] == b[2]).all() for a, b in zip(decoder.decode(files), many)) and len(decoder.headers) == 1


def test_every_transform_is_on_the_querys_path(spark):
    counts = queries.op4_media(spark, "/root/testdata/sf0.01").agg(*[F.sum(c).alias(c) for c in ("n_predictor", "n_cross", "n_green", "n_palette")]).first()
    assert min(counts) > 0


def test_media_reads_back_what_it_stores(docs, spark, sf):
    for rows, texts in ((media.media_round_trip(docs).collect(), TEXTS), (lambda r: (r, [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]))(queries.op4_media(spark, sf).collect())):
        assert len(rows) == len(texts)
        for r, t in zip(rows, texts):
            n, p = media.payload_of(t)
            assert (r.n_bytes, r.payload_bytes) == (n, len(p)) and len(p) % 192 == 0 < len(p)
            assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_bytes > 0
    assert rows is not None


def test_equal_texts_have_equal_media(docs):
    rows = media.media_round_trip(docs).collect()
    assert rows[-1].asDict() | {"doc_id": 0} == rows[-2].asDict() | {"doc_id": 0}


def sellers(item, text):
    row, best = list(range(len(item) + 1)), len(item)
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_alignment_is_exact():
    rng = random.Random(5)
    for _ in range(500):
        item, text = [rng.choice("abc") for _ in range(rng.randint(1, 80))], [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        got = decontaminate.align(item, text, 999)
        assert min(got[0] if got else 999, len(item)) == sellers(item, text)


def test_leaks_against_every_alignment(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.distance for r in queries.op8_decontaminate(spark, sf).collect()}
    words = {r.item_id: decontaminate.WORD.findall(r.text.lower()) for r in items.collect()}
    want = {}
    for d in docs.collect():
        text = decontaminate.WORD.findall(d.text.lower())
        for i, w in words.items():
            if len(set(w) & set(text)) >= len(set(w)) * 0.6 and (got := decontaminate.align(w, text, decontaminate.budget(len(w)))):
                want[d.doc_id, i] = got[0]
    assert want and found == want


def test_edited_items_are_found(spark, sf):
    rng = random.Random(6)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    block = decontaminate.Items([r.item_id for r in items], [decontaminate.WORD.findall(r.text.lower()) for r in items])
    found = 0
    for n in range(200):
        k = rng.randrange(len(items))
        w = list(block.words[k])
        for _ in range(decontaminate.budget(len(w))):
            j = rng.randrange(len(w))
            w[j : j + rng.choice([0, 1, 1])] = rng.choice([[], ["zz"], ["zz"]])
        text = " ".join(["pad"] * rng.randint(0, 50) + w + ["end"] * rng.randint(0, 50))
        found += any(h["item_id"] == block.ids[k] for h in block.search([text], decontaminate.Hashes())[0])
    assert found >= 190


def test_leak_edges(docs, spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "item_id bigint, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    same = spark.createDataFrame([(1, "same"), (1, "same"), (None, "word " * 20)], "item_id bigint, text string")
    assert sorted(r.item_id or 0 for r in decontaminate.leaks(docs, same, block_items=1).collect()) == [0, 1, 1]
    assert decontaminate.without_leaks(docs, same).columns == docs.columns and decontaminate.without_leaks(docs, same).count() == len(TEXTS) - 3
    assert decontaminate.leaks(docs.limit(0), same).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li>Home<li>News</ul></nav>
<div class="ad">Buy now</div><!-- <p>no</p> --><article><h1>Head &amp; tail</h1><p>One&nbsp;two <b>three</b><br>four<p>Five &lt;six&gt;<form>Mail: <input></form>
<script>if (a < b) "</p>"</script></article><aside>Side</aside><div id="comments">Nice!</div><footer>End</footer></body>"""


NO_RUNS = np.empty(0, dtype=np.int64)


def test_main_text_of_a_page():
    text = lambda blocks: html.main_text(blocks, NO_RUNS, NO_RUNS, html.Words())
    assert text(html.blocks_of(PAGE)) == ("Head & tail\nOne two three four\nFive <six>", 0)
    assert text([]) == ("", 0) and text(html.blocks_of("<p>x")) == ("x", 0)


def test_misnested_inline_tags_leave_blocks_open():
    assert html.blocks_of("<b><article><p>x</b> y</p><p>z</article></b>w") == [("x y", 2), ("z", 2), ("w", 1)]


def slow_main_texts(pages):
    """(page_id, text) of rows (page_id, url, html): runs of eight words counted over each host's distinct pages."""
    blocks = {r[0]: [x for x in html.blocks_of(r[2]) if x[1]] for r in pages}
    host = {r[0]: (re.match(r"\w+://([^/:]*)", r[1] or "") or [None, ""])[1] for r in pages}
    words = {i: [w for text, _ in b for w in text.split()] for i, b in blocks.items()}
    runs = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    distinct = {(h, tuple(words[i])) for i, h in host.items()}
    size, held = Counter(h for h, _ in distinct), Counter((h, x) for h, w in distinct for x in runs(w))
    out = {}
    for i, own in blocks.items():
        best = max((role for _, role in own), default=0)
        least = max(8, 0.5 * size[host[i]]) if best == 2 else max(4, 0.1 * size[host[i]])
        w, covered = words[i], set()
        for k in range(len(w) - 7):
            if held[host[i], tuple(w[k : k + 8])] >= least:
                covered |= set(range(k, k + 8))
        at, kept = 0, []
        for text, role in own:
            n = len(text.split())
            if role == best and sum(k in covered for k in range(at, at + n)) < 0.8 * n:
                kept.append(text)
            at += n
        out[i] = "\n".join(kept)
    return out


def page_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def found_texts(frame, **how):
    return {r.page_id: r.text for r in html.extract_main_text(frame, **how).collect()}


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_runs_by_brute_force_over_the_whole_table(spark, tag):
    """Without the elements that vouch for a text, the runs decide; with them, what half of a host has goes."""
    rows = [(r.page_id, r.url, re.sub("(</?)article", rf"\\1{tag}", r.html)) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want, frame = slow_main_texts(rows), page_frame(spark, rows)
    assert found_texts(frame) == want and found_texts(frame, most_runs=0) == want


def notice_host(n=1000):
    """Pages of one host: an own text each; a menu on a tenth and more, a notice on a twentieth, a promise on most, inside ``main`` where the page has one."""
    rows = []
    for k in range(n):
        own = f"Page {k} tells of " + " ".join(f"w{k * j % 977}x{j}" for j in range(30))
        menu = "<div>one of the sections has a list that leads on to nine other pages</div>" if k % 8 == 0 else ""
        notice = "<div>this notice is only shown on a few of the pages of this host</div>" if k % 20 == 1 else ""
        promise = "<p>we promise to all of our readers that we never share what they tell us</p>" if k % 3 else ""
        body = f"<p>{own}</p>{promise}"
        rows.append((k, f"https://h.example/{k}", menu + notice + (f"<main>{body}</main>" if k % 7 == 0 else body)))
    return rows


@pytest.mark.parametrize("how", [{}, {"group": 50}, {"group": 5000}, {"group": 50, "most_runs": 0}])
def test_a_large_host_is_one_host(spark, how):
    rows = notice_host()
    got = found_texts(page_frame(spark, rows), **how)
    assert got == slow_main_texts(rows)
    assert all("promise" not in t and "sections" not in t for t in got.values()) and sum("notice" in t for t in got.values()) > 40
    # tags alone leave all of it
    assert "promise" in html.main_text(html.blocks_of(rows[7][2]), NO_RUNS, NO_RUNS, html.Words())[0]


def test_repeated_runs_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        streams = [rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64) for _ in range(6)]
        runs, pages = html.repeated(streams, 3)
        want = Counter(h for s in streams for h in set(html.run_hashes(s, 3).tolist()))
        assert dict(zip(runs.tolist(), pages.tolist())) == {h: n for h, n in want.items() if n > 1}


def test_suffix_ranks_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(50):
        t = rng.integers(0, 3, 60)
        r = html.suffix_ranks(t, 5)
        for i in range(60):
            for j in range(60):
                assert (r[i] == r[j]) == (t[i : i + 5].tolist() == t[j : j + 5].tolist())


def test_main_text_over_the_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op10_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (html.entities.unescape(re.sub("<[^>]*>", "", x)).split() for x in re.split("</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(" ".join(p) for p in parts if p) and r.n_chars == len(r.text)


def test_page_edges(spark):
    rows = [(1, "http://h/a", None, 1), (None, None, "", 2), (2, "x", "<p>k</p>", 3), (2, "x", "<p>k</p>", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_main_text(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "k", 1), (2, "k", 1)]
    assert html.extract_main_text(pages.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("broken", ["<", "<a ", "<a '", '<a "', "<script ", "<!", "</", "<!--", "<p title=", "&amp", "<li>", "<p><div>", "<div></p>", "<b><div></b>"])
def test_broken_markup_stays_cheap(broken):
    import time

    began = time.process_time()
    html.blocks_of(broken * 30_000)
    assert time.process_time() - began < 20


def test_copies_of_a_page_count_once(spark):
    article = "<div>This text is told by one page only and by its many copies</div>"
    other = "<div>Another page has other things to say and says them but once</div>"
    rows = [(n, f"http://h/{n}", article) for n in range(300)] + [(1000, "http://h/other", other)] + [(n // 2, f"http://h/{n // 2}", article) for n in range(300)]
    got = html.extract_main_text(page_frame(spark, rows), group=20).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    assert {r.text for r in got if r.page_id < 1000} == {html.blocks_of(article)[0][0]} and {r.text for r in got if r.page_id == 1000} == {html.blocks_of(other)[0][0]}


def test_places_are_those_of_the_text_before_lower_case(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, f"İİİİ x {item.upper()} y"), (2, f"ǅ {item}")], "doc_id bigint, text string")
    got = {r.doc_id: (r.start, r.stop) for r in decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (7, 7 + len(item)), 2: (2, 2 + len(item))}


def test_a_very_long_item():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    edited = list(words)
    for _ in range(500):
        edited[rng.randrange(len(edited))] = "changed"
    block = decontaminate.Items([1], [words])
    (hits,) = block.search(["before " + " ".join(edited) + " after"], decontaminate.Hashes())
    assert [h["item_id"] for h in hits] == [1] and 0 < hits[0]["distance"] <= 500
