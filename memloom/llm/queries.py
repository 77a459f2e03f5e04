"""Queries of the training-data operators, one opN_<name> each, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, ftrl, html, licenses, linededup, media, periodic, secrets, simhash, suffixdedup
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.planted_tail))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_suffix_dedup": op2_suffix_dedup, "op3_byte_bpe": op3_byte_bpe, "op4_media": op4_media, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op9_line_dedup": op9_line_dedup, "op10_main_text": op10_main_text, "op11_fill_in_middle": op11_fill_in_middle, "op12_periodic_runs": op12_periodic_runs, "op13_license_scan": op13_license_scan}


FILL_IN_MIDDLE_SQL = """
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from units
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn
), parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:n], ''), '') as suffix from cut
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def _license_sql() -> str:
    """The whole rule table as values, and all detections compared with each other."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {text(w)}, {text(f'^(?:{r.pattern}) ')}, {text(r.label)}, {r.priority}, {licenses.STRENGTH[r.priority]}::double)" for n, r in enumerate(licenses.rules()) for w in r.first)
    phrases = ", ".join(f"({text(p)}, {len(p.split())}, {text(v)})" for p, v in licenses.PHRASES.items())
    return rf"""
with rules(rule, word, pattern, label, priority, strength) as (values {values}), phrases(phrase, size, label) as (values {phrases}),
texts as (
  select row_number() over () as k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents
), words as (select k, words, unnest(range(len(words))) as i, unnest(words) as word from texts),
base as (select k, i, p.label from words join phrases p on array_to_string(words[i + 1:i + p.size], ' ') = p.phrase),
tried as (
  select k, i, r.*, regexp_extract(array_to_string(words[i + 1:i + {licenses.WINDOW}], ' ') || ' ', r.pattern) as m from words join rules r using (word)
  where list_has_any(words, [{", ".join(text(w) for w in licenses.GATE)}])
), found as (select k, i, i + length(m) - length(replace(m, ' ', '')) as e, rule, label, priority, strength from tried where m <> ''),
kept as (
  select * from found d where not exists (
    select 1 from found c where c.k = d.k and c.i <= d.i and c.e >= d.e and c.priority >= d.priority and (c.i < d.i or c.e > d.e or c.priority > d.priority or c.rule < d.rule))
), of_base as (select k, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by k),
of_all as (select k, string_agg(distinct label, ',' order by label) as labels, max(strength) as score from (select k, label, strength from kept union all select k, label, {licenses.STRENGTH[licenses.NAME]}::double from base) group by k)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
from texts left join of_base using (k) left join of_all using (k)
"""


ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": FILL_IN_MIDDLE_SQL, "op13_license_scan": _license_sql()}
