"""Readers of the file formats that memory benchmarks and logs come in, and writers of reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories by number, and the gold answer of questions that can't be answered.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
UNANSWERABLE = "This question cannot be answered from the conversation."


PAIRS = "pairs array<struct<id:string,parent_a:string,parent_b:string,expected_hybrids:array<string>>>"


def parent_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list ``pairs`` of {id, parent_a, parent_b, expected_hybrids}."""
    return pairs_in(spark.read.text(path, wholetext=True).select("value"))


def pairs_in(rows: DataFrame) -> DataFrame:
    """rows: value, the JSON text of such a file."""
    return rows.select(F.explode(F.from_json("value", PAIRS)["pairs"]).alias("p")).select("p.*")


def corpus_texts(pairs: DataFrame, distractors: DataFrame) -> DataFrame:
    """idx, text: hybrids, then parents, then distractors (pos, text), each text once where it first comes."""
    hybrids = pairs.select(F.lit(0).alias("part"), "id", F.posexplode("expected_hybrids").alias("pos", "text"))
    parents = pairs.select(F.lit(1).alias("part"), "id", F.posexplode(F.array("parent_a", "parent_b")).alias("pos", "text"))
    every = hybrids.unionByName(parents).unionByName(distractors.select(F.lit(2).alias("part"), F.lit("").alias("id"), "pos", "text"))
    return every.groupBy("text").agg(F.min(F.struct("part", "id", "pos")).alias("at")).select("at", "text")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """rows: sample_id, conversation (JSON text with session_N lists and session_N_date_time). The turns in order of session number and place."""
    turn = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
    keys = F.filter(F.json_object_keys("conversation"), lambda k: k.rlike(r"^session_\d+$"))
    each = rows.select("sample_id", "conversation", F.explode(keys).alias("key"))
    path = lambda suffix: F.concat(F.lit("$."), "key", F.lit(suffix))
    variant = each.withColumn("v", F.parse_json("conversation"))
    got = variant.select("sample_id", F.regexp_extract("key", r"\d+", 0).cast("int").alias("session"), F.from_json(F.to_json(F.try_variant_get("v", path(""), "variant")), turn).alias("turns"), F.try_variant_get("v", path("_date_time"), "string").alias("session_datetime"))
    out = got.select("sample_id", "session", "session_datetime", F.posexplode("turns").alias("pos", "t"))
    return out.select("sample_id", "session", "pos", F.coalesce("session_datetime", F.lit("")).alias("session_datetime"), F.col("t.speaker").alias("speaker"), F.col("t.dia_id").alias("dia_id"), F.coalesce("t.text", F.lit("")).alias("text"), F.col("t.blip_caption").alias("caption"))


def dialogue_turns(rows: DataFrame) -> DataFrame:
    """rows: sample_id, dialog: JSON text of the older shapes, a list of dialogues or a dictionary of them by name. A dialogue is a list of turns, or has one as ``turns``.

    The turns in order of dialogue and place; a list's dialogues go by place, a dictionary's by name, and are numbered by
    place, or by the digits of the name. Turns without text are left out.
    """
    turn = "array<struct<speaker:string,user:string,text:string,clean_text:string,dia:string>>"
    v = F.parse_json("dialog")
    listed = F.substring(F.ltrim("dialog"), 1, 1) == "["
    # a dictionary's dialogues in order of name
    names = F.when(listed, F.transform(F.sequence(F.lit(0), F.coalesce(F.json_array_length("dialog"), F.lit(0)) - 1), lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("]")))).otherwise(F.transform(F.array_sort(F.json_object_keys("dialog")), lambda k: F.concat(F.lit("."), k)))
    names = F.when(F.coalesce(F.json_array_length("dialog"), F.lit(1)) > 0, names)
    each = rows.withColumn("v", v).select("sample_id", "v", F.posexplode(names).alias("place", "name"))
    at = lambda suffix: F.to_json(F.try_variant_get("v", F.concat(F.lit("$"), "name", F.lit(suffix)), "variant"))
    inner = each.select("sample_id", "place", "name", F.coalesce(at(".turns"), at("")).alias("turns"))
    number = F.when(F.col("name").startswith("["), F.col("place")).otherwise(F.coalesce(F.nullif(F.regexp_replace("name", "[^0-9]", ""), F.lit("")), F.lit("0")).cast("int"))
    out = inner.select("sample_id", "place", number.alias("dia_id"), F.posexplode(F.from_json("turns", turn)).alias("pos", "t"))
    blank = lambda c: F.when(c != "", c)
    said = F.coalesce(blank(F.col("t.text")), blank(F.col("t.clean_text")), blank(F.col("t.dia")))
    return out.select("sample_id", "place", "pos", F.col("dia_id").cast("string").alias("dia_id"), F.coalesce(blank(F.col("t.speaker")), blank(F.col("t.user")), F.lit("unknown")).alias("speaker"), said.alias("text")).where("text is not null")


def question_category(number: Column, name: Column) -> Column:
    known = F.lit(None).cast("string")
    for n, c in CATEGORIES.items():
        known = F.when(number == n, c).otherwise(known)
    return F.when(number.isNotNull(), F.coalesce(known, F.concat(F.lit("category-"), number.cast("string")))).otherwise(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown")))


def question_rows(rows: DataFrame) -> DataFrame:
    """rows: conv_id, idx, qa (JSON of one question). Names for category numbers, text for number answers, one gold answer for the unanswerable."""
    v = F.parse_json("qa")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.category", "variant"))
    number = F.when(kind == "BIGINT", F.try_variant_get(v, "$.category", "int"))
    category = question_category(number, F.try_variant_get(v, "$.category", "string"))
    answer = F.try_variant_get(v, "$.answer", "string")
    hopeless = (category == "adversarial") | (answer.isNull() & F.array_contains(F.json_object_keys("qa"), "adversarial_answer"))
    evidence = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.evidence", "array<string>"), F.array().cast("array<string>")), lambda e: F.trim(e)), lambda e: e != "")
    return rows.select(
        F.format_string("%s_q%03d", "conv_id", "idx").alias("question_id"), F.trim(F.coalesce(F.try_variant_get(v, "$.question", "string"), F.lit(""))).alias("question"),
        F.when(hopeless, "adversarial").otherwise(category).alias("category"), F.when(hopeless, UNANSWERABLE).otherwise(F.trim(F.coalesce(answer, F.lit("")))).alias("answer"), evidence.alias("evidence"),
    )


def haystack_turns(rows: DataFrame, cap: int = 6000) -> DataFrame:
    """rows: question_id, haystack_sessions (array of arrays of {role, content, has_answer}). One row for each turn, its text cut at ``cap``, and whether it holds the answer."""
    s = rows.select("question_id", F.posexplode("haystack_sessions").alias("session", "turns")).select("question_id", "session", F.posexplode("turns").alias("pos", "t"))
    return s.select("question_id", "session", "pos", F.substring(F.concat("t.role", F.lit(": "), "t.content"), 1, cap).alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("is_gold"))


def capped_sessions(sessions: DataFrame, distractors: int) -> DataFrame:
    """sessions: question_id, session, is_gold. All gold sessions and the first ``distractors`` others, in their own order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("question_id", "is_gold").orderBy("session"))
    return sessions.withColumn("_n", place).where(F.col("is_gold") | (F.col("_n") <= distractors)).drop("_n")


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, value of a journal file: line numbers as the file has them."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", "\n")).alias("i", "value")).where("value <> ''").select((F.col("i") + 1).alias("n"), "value")


def checkpoints(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of all checkpoint files that can be read; broken ones are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)


def merged(checkpoints: DataFrame, fingerprint: str, key: str = "question_id") -> DataFrame:
    """checkpoints: fingerprint, written (a number that rises), key and results. The last result of each key among the checkpoints of one configuration; those of another are passed over."""
    own = [c for c in checkpoints.columns if c not in ("fingerprint", "written", key)]
    last = checkpoints.where(F.col("fingerprint") == fingerprint).groupBy(key).agg(F.max_by(F.struct(*own), "written").alias("r"))
    return last.select(key, "r.*")


def left_to_do(asked: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """What a resumed run still has to answer."""
    return asked.join(done.select(key), key, "left_anti")


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def belief_stream(spark: SparkSession, n: int, months: int = 30, base_year: int = 2023) -> DataFrame:
    """A made-up benchmark: n entities, each attribute of which changes its value every few months; gold intervals by month index."""
    from pyspark.sql import Window

    attributes = F.array(*[F.lit(a) for a in ("employer", "city", "role")])
    rows = spark.range(n).select(F.col("id").alias("entity"), F.explode(attributes).alias("attribute")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    start = F.pmod(F.crc32(F.concat_ws("/", "entity", "attribute").cast("binary")), F.lit(5)) + F.col("k") * 7
    rows = rows.select("entity", "attribute", F.concat_ws("-", "attribute", F.pmod(F.col("entity") * 31 + F.col("k") * 7, F.lit(97)).cast("string")).alias("value"), start.cast("int").alias("from_idx")).where(F.col("from_idx") < months)
    return gold_intervals(rows, ("entity", "attribute"), "from_idx", "until_idx")


def belief_talk(stream: DataFrame) -> DataFrame:
    """The made-up benchmark's changes as told in talk: a session for each month, its turns in order of entity and attribute. entity, attribute, session, place, text."""
    from pyspark.sql import Window

    said = F.concat(F.lit("As of month "), F.col("from_idx").cast("string"), F.lit(", the "), "attribute", F.lit(" of number "), F.col("entity").cast("string"), F.lit(" is "), "value", F.lit("."))
    return stream.select("entity", "attribute", F.col("from_idx").alias("session"), F.row_number().over(Window.partitionBy("from_idx").orderBy("entity", "attribute")).alias("place"), said.alias("text"))


def dumped(rows: DataFrame) -> DataFrame:
    """Each row as a line of JSON, nulls shown: value."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def loaded(lines: DataFrame, schema: str) -> DataFrame:
    """value: lines of JSON, as ``dumped`` writes them. A line that can't be read is an error."""
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def narrated(turns: DataFrame) -> DataFrame:
    """turns: scope, session, pos and others. place 1.. of each turn of a scope in the telling: session by session."""
    from pyspark.sql import Window

    return turns.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("session", "pos")))


def gold_intervals(changes: DataFrame, slot: tuple[str, ...], start: str, until: str) -> DataFrame:
    """Each change of a slot holds until the slot's next one; the last is open."""
    from pyspark.sql import Window

    return changes.withColumn(until, F.lead(start).over(Window.partitionBy(*slot).orderBy(start)))


def scripted(spark: SparkSession, facts: int = 100, queries: int = 50) -> tuple[DataFrame, DataFrame]:
    """A made-up conversation: fact_id, text of facts about people, and query_id, text, relevant (fact ids) of labelled questions. By rule, so the same at every run."""
    things = F.array(*[F.lit(x) for x in ("city", "food", "hobby", "job", "pet")])
    i = F.col("id")
    thing = F.element_at(things, (i % 5 + 1).cast("int"))
    person = F.concat(F.lit("Person "), (i / 5).cast("bigint").cast("string"))
    said = spark.range(facts).select(i.alias("fact_id"), F.concat(person, F.lit(" told me that the "), thing, F.lit(" they chose is number "), (i * 37 % 101).cast("string")).alias("text"))
    step = max(1, facts // max(1, queries))
    j = i * step
    asked = F.concat(F.lit("Which "), F.element_at(things, (j % 5 + 1).cast("int")), F.lit(" did Person "), (j / 5).cast("bigint").cast("string"), F.lit(" choose?"))
    return said, spark.range(queries).where(j < facts).select(i.alias("query_id"), asked.alias("text"), F.array(j).alias("relevant"))
