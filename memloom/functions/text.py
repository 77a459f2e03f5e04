"""Text functions: Column to Column, built in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, written out: the class by property is several times slower.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Function words that don't count as content, and the subject that every extracted fact begins with.
CONTENT_STOP = (
    "the and for but not with from that this they them their what when where which who whom whose why how are was were been being "
    "have has had having does did doing you your yours yourself yourselves him his himself her hers herself its itself ourselves themselves out "
    "off down over under again once any all some such than too very can will just don should now user"
).split()
# Sentence openers that are no entity, alone.
SPAN_STOP = ("i", "the", "a", "an", "he", "she", "they", "we")
# Answers that decline.
ABSTENTION = r"(?i)i don'?t know|i do not know|no answer|not mentioned|no information|cannot be (?:determined|answered)|can'?t be (?:determined|answered)|not specified|does not (?:say|mention|contain)|no relevant memor"
# Markers of a denied or corrected statement.
NEGATIONS = ("n't", " not ", "no longer", "anymore", "quit", "gone off", "used to", "previously", "my mistake", "misspoke", "had that wrong", "got that wrong", "correction", "dislikes")
# What stands around a photo's caption.
PHOTO = ("[shared a photo: ", "]")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NOW_WORDS = ("now", "none", "currently", "present", "today")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _t(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def stripped(s: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm(s: Column) -> Column:
    return F.lower(stripped(s))


def tokenize(s: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(_t(s)), SPACES), lambda x: x != "")


def sharp_tokenize(s: Column, stop: list[str]) -> Column:
    """Words without punctuation; stop words go, and numbers of fewer than four digits; longer numbers always stay."""
    digits = lambda x: x.rlike(r"^\p{Nd}+$")
    keep = lambda x: (~x.isin(list(stop)) & ~digits(x)) | (digits(x) & (F.length(x) >= 4))
    return F.filter(tokenize(F.translate(_t(s), PUNCTUATION, "")), keep)


def lines(s: Column) -> Column:
    return F.transform(F.split(_t(s), LINE_END), stripped)


def first_of(items: Column, key) -> Column:
    """The items whose key no earlier item has, in order."""
    # an array of one, so that the keys are made once and not again for each item
    both = F.array(F.struct(items.alias("items"), F.transform(items, key).alias("keys")))
    return F.flatten(F.transform(both, lambda b: F.filter(b["items"], lambda x, i: F.array_position(b["keys"], F.get(b["keys"], i)) == i + 1)))


def capital_spans(s: Column) -> Column:
    """Runs of capitalised ASCII words, each name once whatever its case; lone sentence openers are no names."""
    found = F.regexp_extract_all(_t(s), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*(?![\p{L}\p{N}_])"), 0)
    return first_of(F.filter(found, lambda x: ~F.lower(x).isin(*SPAN_STOP)), norm)


def sanitized(s: Column, tag: str) -> Column:
    """The tag, opening or closing, can't be forged by the text."""
    return F.regexp_replace(s, rf"(?i)</?\s*{tag}\s*>", "[redacted-tag]")


def content_words(s: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_t(s)), F.lit("[a-z0-9]+"), 0), lambda x: (F.length(x) >= 3) & ~x.isin(CONTENT_STOP)))


def any_overlap(new: Column, others: Column) -> Column:
    """Whether a text shares a content word with any of an array of texts: never with none; always if it has no content words."""
    words = content_words(new)
    return F.when(F.size(others) == 0, False).when(F.size(words) == 0, True).otherwise(F.exists(others, lambda o: F.arrays_overlap(words, content_words(o))))


def abstains(s: Column) -> Column:
    return _t(s).rlike(ABSTENTION)


def asserts(s: Column, value: Column, other: Column) -> Column:
    """The value stands in the text, its rival doesn't, and nothing is denied. Markers are told in any case, values in their own."""
    denied = F.lit(False)
    for marker in NEGATIONS:
        denied = denied | F.contains(F.lower(s), F.lit(marker))
    return F.contains(s, value) & ~F.contains(s, other) & ~denied


# ---------------------------------------------------------------- answers of a language model


def parse_facts(s: Column, most: int = 10) -> Column:
    """Bulleted or numbered facts, each once whatever its case, the first ``most``."""
    own = F.transform(
        lines(s),
        lambda x: F.when(x.startswith("- ") | x.startswith("* "), stripped(F.substring(x, 3, 1 << 30))).when(x.rlike(r"^\p{Nd}") & F.contains(x, F.lit(".")), stripped(F.regexp_replace(x, r"^[^.]*\.", ""))).otherwise(""),
    )
    none = F.contains(F.upper(_t(s)), F.lit("NO_FACTS")) & ~F.exists(lines(s), lambda x: x.startswith("-"))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.slice(first_of(F.filter(own, lambda x: x != ""), F.lower), 1, most))


def _parts(x: Column) -> Column:
    return F.transform(F.split(x, r"\|"), stripped)


def parse_statements(s: Column) -> Column:
    """FACT | subject | attribute | value | when | certainty lines; lines with fewer parts or without the first three are dropped."""
    rows = F.filter(F.transform(lines(s), lambda x: stripped(F.regexp_replace(x, r"^[-* ]+", ""))), lambda x: F.upper(x).startswith("FACT"))
    parts = F.filter(F.transform(rows, _parts), lambda p: (F.size(p) >= 6) & (p[1] != "") & (p[2] != "") & (p[3] != ""))
    return F.transform(parts, lambda p: F.struct(p[1].alias("subject"), F.replace(F.lower(p[2]), F.lit(" "), F.lit("_")).alias("attribute"), p[3].alias("value"), p[4].alias("when"), F.upper(p[5]).alias("certainty")))


def _field(s: Column, name: str) -> Column:
    """What follows the last line that begins with the name and a colon, null without one."""
    found = F.filter(lines(s), lambda x: F.upper(x).startswith(f"{name}:"))
    return F.when(F.size(found) > 0, stripped(F.regexp_replace(F.element_at(found, -1), "^[^:]*:", "")))


def parse_belief_query(s: Column) -> Column:
    """SUBJECT, ATTRIBUTE, MODE and ASOF; an unknown mode is current."""
    mode, asof = F.lower(_field(s, "MODE")), _field(s, "ASOF")
    return F.struct(
        _t(_field(s, "SUBJECT")).alias("subject"), F.replace(F.lower(_t(_field(s, "ATTRIBUTE"))), F.lit(" "), F.lit("_")).alias("attribute"),
        F.when(mode.isin("current", "as_of", "history"), mode).otherwise("current").alias("mode"), F.when(~F.upper(asof).isin("NONE", ""), asof).alias("asof"),
    )


def parse_entities(s: Column) -> Column:
    """ENTITY | name | type | description lines, each (type, name) once."""
    parts = F.filter(F.transform(lines(s), _parts), lambda p: (F.upper(p[0]) == "ENTITY") & (F.size(p) >= 3) & (F.get(p, F.lit(1)) != ""))
    made = F.transform(parts, lambda p: F.struct(p[1].alias("name"), F.upper(p[2]).alias("type"), _t(F.get(p, F.lit(3))).alias("description")))
    return first_of(made, lambda e: F.concat(e["type"], F.lit(":"), norm(e["name"])))


def parse_relations(s: Column) -> Column:
    parts = F.filter(F.transform(lines(s), _parts), lambda p: (F.upper(p[0]) == "RELATION") & (F.size(p) >= 4))
    parts = F.filter(parts, lambda p: (p[1] != "") & (p[2] != "") & (p[3] != ""))
    return F.transform(parts, lambda p: F.struct(p[1].alias("from_name"), p[3].alias("to_name"), p[2].alias("relation"), _t(F.get(p, F.lit(4))).alias("description")))


def parse_decision(s: Column) -> Column:
    """The first DECISION line that can be read; ADD without one. In its own case."""
    said = F.transform(F.filter(lines(s), lambda x: x.startswith("DECISION:")), lambda x: stripped(F.substring(x, 10, 1 << 30)))
    good = F.filter(said, lambda p: p.isin("ADD", "NONE") | p.rlike(r"^(UPDATE|DELETE)\s+id=[\p{L}\p{N}_-]+"))
    p = F.get(good, F.lit(0))
    target = F.regexp_extract(p, r"^(?:UPDATE|DELETE)\s+id=([\p{L}\p{N}_-]+)", 1)
    return F.struct(F.coalesce(F.regexp_extract(p, r"^(ADD|NONE|UPDATE|DELETE)", 1), F.lit("ADD")).alias("kind"), F.when(target != "", target).alias("target_id"))


def parse_fact_detection(s: Column) -> Column:
    """FACT_TYPE, VALUE (null where empty) and CONFIDENCE (0 where it is no number)."""
    blank = lambda x: F.when(x != "", x)
    return F.struct(blank(F.lower(_field(s, "FACT_TYPE"))).alias("fact_type"), blank(_field(s, "VALUE")).alias("value"), F.coalesce(_field(s, "CONFIDENCE").try_cast("double"), F.lit(0.0)).alias("confidence"))


def judge_label_json(s: Column) -> Column:
    """CORRECT or INCORRECT from a JSON answer, fenced or not; else by the words; else INCORRECT."""
    text = stripped(_t(s))
    body = F.when(text.startswith("```"), F.regexp_replace(text, r"^```[a-zA-Z]*\s*|\s*```$", "")).otherwise(text)
    said = F.upper(stripped(F.get_json_object(body, "$.label")))
    quoted = F.upper(F.regexp_extract(text, r'(?i)"label"\s*:\s*"(CORRECT|WRONG)"', 1))
    word = F.upper(F.regexp_extract(text, r"(?i)\b(CORRECT|WRONG)\b", 1))
    label = F.coalesce(F.when(said != "", said), F.when(quoted != "", quoted), word)
    return F.when(label == "CORRECT", "CORRECT").otherwise("INCORRECT")


def judge_label_lines(s: Column) -> Column:
    """A label at a line's start, else one anywhere (INCORRECT, PARTIAL, CORRECT, in that order), else INCORRECT."""
    text = stripped(_t(s))
    label = F.when(text.rlike(r"(?i)\bINCORRECT\b"), "INCORRECT").when(text.rlike(r"(?i)\bPARTIAL\b"), "PARTIAL").when(text.rlike(r"(?i)\bCORRECT\b"), "CORRECT").otherwise("INCORRECT")
    for x in ("PARTIAL", "INCORRECT", "CORRECT"):
        label = F.when(text.rlike(rf"(?m)^\s*{x}\b"), x).otherwise(label)
    return label


def judge_score(label: Column) -> Column:
    return F.when(label == "CORRECT", 1.0).when(label == "PARTIAL", 0.5).otherwise(0.0)


def gold_answer(category: Column, gold: Column) -> Column:
    """Open-domain answers count up to the first semicolon."""
    return F.when((category == "open-domain") & F.contains(gold, F.lit(";")), stripped(F.substring_index(gold, ";", 1))).otherwise(gold)


# ---------------------------------------------------------------- dates


def _epoch(year: Column, month: Column, day: Column) -> Column:
    """Midnight UTC; days beyond the month's end run on."""
    return F.when(year.between(1, 9999), F.unix_date(F.date_add(F.make_date(year, month, F.lit(1)), day - 1)) * F.lit(86400.0))


def parse_when(phrase: Column, session: Column) -> Column:
    """A date phrase as seconds since 1970: ISO year-month(-day), month name with a day or without and a year, or a year of 19xx or 20xx; else the session's time."""
    w = F.lower(stripped(phrase))
    number = lambda pattern, k: F.regexp_extract(w, pattern, k).try_cast("int")
    edge, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    iso = edge + r"([0-9]{4})-([0-9]{1,2})" + rf"(?:-([0-9]{{1,2}})|){end}"
    day = r"([0-9]{1,2})(?:st|nd|rd|th|),?\s+"
    named = edge + r"([a-z]{3,9})[.]?\s+" + rf"(?:{day}|)([0-9]{{4}}){end}"
    bare = edge + r"(19[0-9]{2}|20[0-9]{2})" + end
    first = lambda n: F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
    by_iso = F.when(number(iso, 2).between(1, 12), _epoch(number(iso, 1), number(iso, 2), first(number(iso, 3))))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.left(F.regexp_extract(w, named, 1), F.lit(3))).cast("int")
    by_name = F.when(month > 0, _epoch(number(named, 3), month, F.coalesce(number(named, 2), F.lit(1))))
    found = F.coalesce(by_iso, by_name, _epoch(number(bare, 1), F.lit(1), F.lit(1)), session)
    return F.when(phrase.isNull() | (phrase == "") | w.isin(*NOW_WORDS), session).otherwise(found)


def relative_phrase(index: Column, now_index: Column) -> Column:
    """How a month of the grid is spoken of from another: this month, last month, n months ago, last year, n years ago; months ahead likewise."""
    back = now_index - index
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}s ago"))
    ahead = F.when(back == -1, "next month").when(back < -1, F.concat(F.lit("in "), (-back).cast("string"), F.lit(" months")))
    return F.when(back == 0, "this month").when(back == 1, "last month").when(back < 0, ahead).when(back == 12, "last year").when(back % 12 == 0, ago((back / 12).cast("int"), "year")).otherwise(ago(back, "month"))


def month_year(epoch: Column) -> Column:
    return F.when(epoch.isNull(), "present").otherwise(F.date_format(F.timestamp_seconds(epoch), "MMM yyyy"))


def grid_epoch(base_year: int, index: Column) -> Column:
    """The first day of a month counted from January of ``base_year``."""
    return F.unix_date(F.add_months(F.make_date(F.lit(base_year), F.lit(1), F.lit(1)), index)) * F.lit(86400.0)


# ---------------------------------------------------------------- scores and forms


def qa_tokens(s: Column) -> Column:
    return F.filter(tokenize(F.translate(_t(s), PUNCTUATION, "")), lambda x: ~x.isin("a", "an", "the"))


def token_f1(predicted: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over the two bags of words."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))

    def score(bags: Column) -> Column:
        p, g = bags["p"], bags["g"]
        common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda n, x: n + F.least(count(p, x), count(g, x)))
        both = F.size(p) + F.size(g)
        return F.when(both == 0, 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2.0 * common / both)

    # an array of one, so that the texts are cut once and not again for each word
    return F.get(F.transform(F.array(F.struct(qa_tokens(predicted).alias("p"), qa_tokens(gold).alias("g"))), score), F.lit(0))


def keyword_recall(predicted: Column, keywords: Column) -> Column:
    found = F.filter(keywords, lambda k: F.rlike(F.lower(_t(predicted)), F.concat(F.lit(r"(?U)\b\Q"), F.lower(k), F.lit(r"\E\b"))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(found) / F.size(keywords))


def importance(s: Column) -> Column:
    alone = lambda pattern: F.regexp_extract_all(_t(s), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"), 0)
    names, numbers = F.size(F.array_distinct(alone(r"[A-Z][a-z]{2,}"))), F.size(alone(r"\p{Nd}{2,}"))
    return 1.0 + 0.15 * F.least(names, F.lit(4)) + 0.1 * F.least(numbers, F.lit(3)) + 0.2 * F.least(F.length(_t(s)) / 200.0, F.lit(1.0))


def turn_text(when: Column, speaker: Column, text: Column) -> Column:
    said = F.concat(speaker, F.lit(": "), text)
    return F.when(_t(when) == "", said).otherwise(F.concat(F.lit("["), when, F.lit("] "), said))


def with_caption(text: Column, caption: Column) -> Column:
    """A photo's caption is part of what was said."""
    note = F.concat(F.lit(PHOTO[0]), caption, F.lit(PHOTO[1]))
    return F.when(_t(caption) == "", _t(text)).when(_t(text) == "", note).otherwise(F.concat(text, F.lit(" "), note))


def answer_core(s: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(s)), "^(a|an|the) ", "")


def n_tokens(s: Column) -> Column:
    return F.size(tokenize(s))


def hash_embedding(s: Column, dim: int = 64) -> Column:
    """A stand-in for a model: number i is the i-th (of eight, in turn) 32-bit word of the text's SHA-256, as a signed share of 2**31."""
    word = lambda i: F.conv(F.substr(F.sha2(s, 256), (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((word(i) - F.when(word(i) >= 2147483648.0, 4294967296.0).otherwise(0.0)) / 2147483648.0).cast("float"))
