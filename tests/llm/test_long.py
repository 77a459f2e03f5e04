"""Very long texts through every operator."""

import hashlib
import random
import time

import pytest

from memloom.llm import bpe, decontaminate, ftrl, html, linededup, media, secrets, simhash, suffixdedup


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    long = "\n".join(" ".join(rng.choices(words, k=40)) for _ in range(3000))
    rows = [(1, long), (2, long), (3, "x" * 300_000), (4, "short"), (5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), {i: t or "" for i, t in rows}


def test_row_operators(docs):
    import public_tokenizers

    table, texts = docs
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in bpe.bpe_round_trip(table, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        assert r.decoded_sha256 == sha(texts[r.doc_id])
    for r in media.media_round_trip(table).collect():
        assert r.payload_sha256 == hashlib.sha256(media.payload_of(texts[r.doc_id])[1]).hexdigest()
    assert secrets.scan_secrets(table).count() == 5


def test_table_operators(docs, spark):
    table, texts = docs
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.suffix_dedup(table).collect()}
    size = len(texts[1].encode())
    assert removed == {1: (size, size), 2: (size, size), 3: (300_000, 300_000), 4: (5, 0), 5: (0, 0)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}[2] == 1
    assert {r.doc_id: r.n_removed for r in linededup.line_dedup(table).collect()} == {1: 0, 2: 3000, 3: 0, 4: 0, 5: 0}
    passage = " ".join(texts[1].split()[50_000:50_040])
    items = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(table, items).collect()) == [1, 2]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert ftrl.toxicity(table, labels).count() == 5


def test_a_long_page(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<article>" + "<p>some words here</p>" * 40_000 + "</article>")], "page_id bigint, url string, html string")
    assert html.extract_main_text(pages).first().n_chars == 40_000 * 16 - 1


def test_long_runs_of_every_character():
    scanner, began = secrets.EntropyScanner(), time.perf_counter()
    classes = sorted({x for c in secrets.CLASSES for x in c.characters})
    for x in classes:
        for text in (x * 20_000, x * 20_000 + "1", x * 20_000 + "A1", f"{x}_" * 10_000 + "1z", f"_{x}" * 10_000 + "Zz9", "password=" + x * 20_000):
            assert scanner.scan(text) == []
            secrets.base_spans(text)
    assert time.perf_counter() - began < 60
