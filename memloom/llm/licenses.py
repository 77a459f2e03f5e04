"""Operator 13, license scans: ordered signature rules behind a keyword gate, native Spark expressions only.

A rule is a regular expression over lower-cased words joined by single spaces, anchored at its first word. Three gates
keep the hundreds of rules cheap: a text must hold one of the keywords of ``GATE`` (one look into a hash set for each
word); only places of rules' first words go on; and a window of ``WINDOW`` words from there must match one expression
over all rules before the rules of that word are tried one by one. A detection is an interval of words. Sorted by start and
then by length, one fold over a text's detections keeps those that no earlier one of the same or a higher priority
contains, so overlapping detections resolve in linear time. All of it happens inside the row: nothing is shuffled,
joined or collected, and a text's cost grows with its length and its detections.

Base phrases (``PHRASES``) are counted beside the rules and never suppressed.

Defined results: a null or empty text has no words and no labels (counts 0, empty strings, score 0, null places).
Repeated rows give repeated results; ids may be null; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words that a rule may take.
WINDOW = 40
#: A text without any of these words has no detections; every base phrase holds one.
GATE = (
    "0bsd", "advertising", "afl", "affero", "agpl", "agplv3", "altered", "apache", "apache2", "artistic", "asl", "beerware", "bigscience", "boost", "bsd", "bsl", "busl", "cc", "cc0", "cddl", "cecill", "charge",
    "commercial", "confidential", "contents", "copying", "copyright", "cpal", "cpl", "creative", "creativecommons", "creativeml", "domain", "eclipse", "edl", "educational", "academic", "endorse", "epl", "eupl", "evil", "expat", "fdl", "freebsd", "gfdl", "gnu",
    "gpl", "gplv2", "gplv3", "hereby", "internal", "isc", "lgpl", "lgplv2", "lgplv3", "liable", "library", "licence", "licenced", "license", "licensed", "licenses", "mit", "mozilla", "mpl", "ms", "ncsa", "noncommercial", "odbl", "odc", "ofl", "ogl", "opendatacommons",
    "openrail", "opensource", "osl", "pddl", "permission", "polyform", "prohibited", "proprietary", "psf", "publication", "redistribute", "redistribution", "redistributions", "reproduced", "resale", "research", "reserved", "sil", "software", "spdx", "sspl", "unencumbered",
    "unlicense", "unlicence", "upl", "verbatim", "waived", "warranties", "warranty", "wtfpl", "x11", "zero", "zlib", "zpl",
)
#: Priorities: what a mere mention, a license's name, its name with a version, a grant or address, and a tag or the license's own text weigh.
MENTION, NAME, VERSION, GRANT, TEXT = range(5)
STRENGTH = {MENTION: 0.3, NAME: 0.6, VERSION: 0.8, GRANT: 0.95, TEXT: 1.0}


@dataclass(frozen=True)
class Rule:
    """``first``: the words that the pattern can begin with; ``pattern``: words and single spaces, without capturing groups."""

    label: str
    first: tuple[str, ...]
    pattern: str
    priority: int


#: Each family: label, first words of its name, the name, its versions (as words), the words of its identifier in tags.
FAMILIES = (
    ("apache", ("apache", "asl"), r"(?:apache(?: software)?(?: foundation)?(?: licen[sc]e)?|asl)", ("1 0", "1 1", "2 0"), "apache"),
    ("gpl", ("gnu", "gpl", "general"), r"(?:(?:gnu )?general public licen[sc]e(?: gpl)?|(?:gnu )?gpl)", ("1 0", "2 0", "3 0"), "gpl"),
    ("lgpl", ("gnu", "lgpl", "lesser", "library"), r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e(?: lgpl)?|(?:gnu )?lgpl)", ("2 0", "2 1", "3 0"), "lgpl"),
    ("agpl", ("gnu", "agpl", "affero"), r"(?:(?:gnu )?affero general public licen[sc]e(?: agpl)?|(?:gnu )?agpl)", ("1 0", "3 0"), "agpl"),
    ("gfdl", ("gnu", "gfdl", "fdl"), r"(?:gnu free documentation licen[sc]e|(?:gnu )?g?fdl)", ("1 1", "1 2", "1 3"), "gfdl"),
    ("mit", ("mit", "expat", "x11"), r"(?:mit(?: x11| expat)?|expat|x11) (?:style )?licen[sc]e", (), "mit"),
    ("mit-0", ("mit",), r"mit (?:0|no attribution)(?: licen[sc]e)?", (), "mit 0"),
    ("bsd", ("bsd", "berkeley"), r"(?:bsd|berkeley software distribution)(?: style)? licen[sc]e", (), "bsd"),
    ("bsd-1-clause", ("bsd", "one", "1"), r"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[sc]e)?", (), "bsd 1 clause"),
    ("bsd-2-clause", ("bsd", "two", "2", "simplified", "freebsd"), r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", (), "bsd 2 clause"),
    ("bsd-3-clause", ("bsd", "three", "3", "new", "modified", "revised"), r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)?", (), "bsd 3 clause"),
    ("bsd-4-clause", ("bsd", "four", "4", "original"), r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?", (), "bsd 4 clause"),
    ("0bsd", ("0bsd", "zero", "bsd"), r"(?:0bsd|(?:bsd )?zero clause(?: bsd)?|bsd 0 clause)(?: licen[sc]e)?", (), "0bsd"),
    ("isc", ("isc",), r"isc licen[sc]e", (), "isc"),
    ("mpl", ("mozilla", "mpl"), r"(?:mozilla public licen[sc]e(?: mpl)?|mpl)", ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", ("eclipse", "epl"), r"(?:eclipse public licen[sc]e(?: epl)?|epl)", ("1 0", "2 0"), "epl"),
    ("edl", ("eclipse", "edl"), r"(?:eclipse distribution licen[sc]e|edl)", ("1 0",), "edl"),
    ("cddl", ("common", "cddl"), r"(?:common development and distribution licen[sc]e(?: cddl)?|cddl)", ("1 0", "1 1"), "cddl"),
    ("cpl", ("common", "cpl"), r"(?:common public licen[sc]e|cpl)", ("1 0",), "cpl"),
    ("cpal", ("common", "cpal"), r"(?:common public attribution licen[sc]e|cpal)", ("1 0",), "cpal"),
    ("eupl", ("european", "eupl"), r"(?:european union public licen[sc]e(?: eupl)?|eupl)", ("1 0", "1 1", "1 2"), "eupl"),
    ("osl", ("open", "osl"), r"(?:open software licen[sc]e|osl)", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("afl", ("academic", "afl"), r"(?:academic free licen[sc]e|afl)", ("2 0", "2 1", "3 0"), "afl"),
    ("artistic", ("artistic", "perl"), r"(?:artistic|perl artistic) licen[sc]e", ("1 0", "2 0"), "artistic"),
    ("psf", ("python", "psf"), r"(?:python software foundation licen[sc]e|psf licen[sc]e)", ("2 0",), "psf"),
    ("zpl", ("zope", "zpl"), r"(?:zope public licen[sc]e|zpl)", ("2 0", "2 1"), "zpl"),
    ("php", ("php",), r"php licen[sc]e", ("3 0", "3 01"), "php"),
    ("ruby", ("ruby",), r"ruby licen[sc]e", (), "ruby"),
    ("boost", ("boost", "bsl"), r"(?:boost software licen[sc]e|bsl)", ("1 0",), "bsl"),
    ("busl", ("business", "busl"), r"(?:business source licen[sc]e|busl)", ("1 0", "1 1"), "busl"),
    ("sspl", ("server", "sspl"), r"(?:server side public licen[sc]e|sspl)", ("1 0",), "sspl"),
    ("elastic", ("elastic",), r"elastic licen[sc]e", ("1 0", "2 0"), "elastic"),
    ("polyform-noncommercial", ("polyform",), r"polyform noncommercial(?: licen[sc]e)?", ("1 0",), "polyform noncommercial"),
    ("polyform-shield", ("polyform",), r"polyform shield(?: licen[sc]e)?", ("1 0",), "polyform shield"),
    ("zlib", ("zlib",), r"zlib(?: libpng)? licen[sc]e", (), "zlib"),
    ("libpng", ("libpng", "png"), r"(?:lib)?png (?:reference library )?licen[sc]e", ("1 0", "2 0"), "libpng"),
    ("unlicense", ("unlicense", "unlicence"), r"unlicen[sc]e", (), "unlicense"),
    ("wtfpl", ("wtfpl", "do"), r"(?:wtfpl|do what the f\S* you want to public licen[sc]e)", ("1 0", "2 0"), "wtfpl"),
    ("ofl", ("sil", "ofl", "open"), r"(?:(?:sil )?open font licen[sc]e(?: ofl)?|(?:sil )?ofl)", ("1 0", "1 1"), "ofl"),
    ("odbl", ("open", "odbl"), r"(?:open (?:data commons open )?database licen[sc]e(?: odbl)?|odbl)", ("1 0",), "odbl"),
    ("odc-by", ("open", "odc"), r"(?:open data commons attribution licen[sc]e|odc by)", ("1 0",), "odc by"),
    ("pddl", ("public", "pddl", "open"), r"(?:(?:open data commons )?public domain dedication and licen[sc]e|pddl)", ("1 0",), "pddl"),
    ("ogl", ("open", "ogl"), r"(?:open government licen[sc]e|ogl(?: uk)?)", ("1 0", "2 0", "3 0"), "ogl uk"),
    ("cecill", ("cecill",), r"cecill(?: [bc])?(?: free software)?(?: licen[sc]e(?: agreement)?)?", ("1 0", "2 0", "2 1"), "cecill"),
    ("ms-pl", ("microsoft", "ms"), r"(?:microsoft public licen[sc]e|ms pl)", (), "ms pl"),
    ("ms-rl", ("microsoft", "ms"), r"(?:microsoft reciprocal licen[sc]e|ms rl)", (), "ms rl"),
    ("ncsa", ("university", "ncsa"), r"(?:university of illinois(?: ncsa)?(?: open source)? licen[sc]e|ncsa(?: open source)? licen[sc]e)", (), "ncsa"),
    ("upl", ("universal", "upl"), r"(?:universal permissive licen[sc]e|upl)", ("1 0",), "upl"),
    ("postgresql", ("postgresql",), r"postgresql licen[sc]e", (), "postgresql"),
    ("openssl", ("openssl",), r"openssl(?: ssleay)? licen[sc]e", (), "openssl"),
    ("curl", ("curl",), r"curl licen[sc]e", (), "curl"),
    ("vim", ("vim",), r"vim licen[sc]e", (), "vim"),
    ("openrail", ("openrail", "creativeml", "bigscience"), r"(?:creativeml |bigscience )?(?:open ?rail)(?: m)?(?: licen[sc]e)?", (), "openrail"),
    ("llama", ("llama",), r"llama (?:[234](?: \d)? )?(?:community )?licen[sc]e(?: agreement)?", (), "llama"),
    ("cc0", ("cc0", "creative"), r"(?:cc0|creative commons (?:cc0|zero)(?: public domain dedication)?)", ("1 0",), "cc0"),
    ("cc-by", ("cc", "creative"), r"(?:cc by|creative commons attribution(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by"),
    ("cc-by-sa", ("cc", "creative"), r"(?:cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by sa"),
    ("cc-by-nd", ("cc", "creative"), r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nd"),
    ("cc-by-nc", ("cc", "creative"), r"(?:cc by nc|creative commons attribution non ?commercial(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc"),
    ("cc-by-nc-sa", ("cc", "creative"), r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc sa"),
    ("cc-by-nc-nd", ("cc", "creative"), r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[sc]e)?)", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc nd"),
)

#: Short forms in one word, addresses, and sentences of the licenses' own texts: label, pattern (its first word is plain), priority.
SIGNATURES = (
    ("apache-2.0", r"apache2", VERSION), ("apache-2.0", r"www apache org licenses license 2 0(?: txt| html)?", GRANT), ("apache-1.1", r"www apache org licenses license 1 1(?: txt)?", GRANT),
    ("gpl-2.0", r"gplv2", VERSION), ("gpl-3.0", r"gplv3", VERSION), ("lgpl-2.1", r"lgplv2(?: 1)?", VERSION), ("lgpl-3.0", r"lgplv3", VERSION), ("agpl-3.0", r"agplv3", VERSION),
    ("gpl", r"www gnu org (?:licenses|copyleft) gpl(?: html| txt)?", GRANT), ("gpl-2.0", r"www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", GRANT), ("gpl-3.0", r"www gnu org licenses gpl 3 0(?: html| txt)?", GRANT),
    ("lgpl", r"www gnu org licenses lgpl(?: html| txt)?", GRANT), ("agpl-3.0", r"www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", GRANT), ("gfdl", r"www gnu org licenses fdl(?: html| txt)?", GRANT),
    ("mit", r"opensource org licenses mit(?: license)?(?: php)?", GRANT), ("bsd-2-clause", r"opensource org licenses bsd 2 clause", GRANT), ("bsd-3-clause", r"opensource org licenses bsd 3 clause", GRANT),
    ("isc", r"opensource org licenses isc", GRANT), ("zlib", r"opensource org licenses zlib", GRANT), ("apache-2.0", r"opensource org licenses apache 2 0", GRANT), ("osl-3.0", r"opensource org licenses osl 3 0(?: php)?", GRANT),
    ("afl-3.0", r"opensource org licenses afl 3 0(?: php)?", GRANT), ("mpl-2.0", r"(?:www )?mozilla org mpl 2 0", GRANT), ("mpl-1.1", r"mozilla org mpl mpl 1 1(?: html)?", GRANT), ("epl-1.0", r"eclipse org legal epl v10(?: html)?", GRANT),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)(?: html)?", GRANT), ("unlicense", r"unlicense org", GRANT), ("boost-1.0", r"boost org license 1 0(?: txt)?", GRANT), ("ofl-1.1", r"scripts sil org ofl", GRANT),
    ("wtfpl", r"wtfpl net", GRANT), ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", GRANT), ("public-domain", r"creativecommons org publicdomain mark 1 0", GRANT), ("odbl-1.0", r"opendatacommons org licenses odbl(?: 1 0)?", GRANT),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", TEXT), ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to", TEXT),
    ("mit", r"above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", TEXT),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", TEXT), ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", TEXT),
    ("isc", r"the software is provided as is and the author disclaims all warranties", TEXT), ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", TEXT),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", TEXT), ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", TEXT),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products", TEXT), ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", TEXT),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", TEXT),
    ("apache-2.0", r"you may not use this file except in compliance with the license", TEXT), ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", TEXT),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version", TEXT), ("gpl-3.0", r"either version 3 of the license or at your option any later version", TEXT), ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version", TEXT),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", TEXT), ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", TEXT), ("lgpl", r"this library is free software you can redistribute it and or modify it", TEXT),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", TEXT), ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", TEXT),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", TEXT), ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", TEXT),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v2|2) 0", TEXT),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", TEXT), ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", TEXT),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", TEXT), ("unlicense", r"this is free and unencumbered software released into the public domain", TEXT),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", TEXT), ("cc0", r"to the extent possible under law (?:\S+ ){1,8}has waived all copyright", TEXT), ("ofl", r"this font software is licensed under the sil open font license version 1 1", TEXT),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", TEXT), ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes", TEXT),
    ("beerware", r"you can do whatever you want with this stuff if we meet some day", TEXT), ("json", r"the software shall be used for good not evil", TEXT), ("sspl-1.0", r"if you make the functionality of the program or a modified version available to third parties as a service", TEXT),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", GRANT), ("public-domain", r"public domain (?:dedication|mark|work)", NAME),
    ("proprietary", r"proprietary and confidential", GRANT), ("proprietary", r"confidential and proprietary", GRANT), ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work|material)(?: via any medium)? is (?:strictly )?prohibited", TEXT),
    ("proprietary", r"may not be (?:reproduced|copied|distributed|used) (?:\S+ ){0,6}without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", GRANT), ("proprietary", r"no part of this (?:publication|work|book|document) may be reproduced", TEXT), ("proprietary", r"for internal use only", NAME),
    ("non-commercial", r"for (?:personal and )?non ?commercial use only", GRANT), ("non-commercial", r"not for (?:resale|commercial use)", NAME), ("educational", r"for (?:educational|academic|research) (?:use|purposes) only", GRANT),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d| present)?", MENTION), ("copyright", r"copyright (?:the )?(?:authors|contributors|holders|owners)", MENTION), ("reserved-some", r"some rights reserved", NAME), ("reserved-none", r"no rights reserved", NAME),
    ("unknown", r"licen[sc]ed under (?:\S+ ){1,8}?licen[sc]e", MENTION), ("unknown", r"see (?:the )?(?:license|licence|copying)(?: file| txt| md)? for (?:more )?(?:details|information|terms)", MENTION), ("unknown", r"open source licen[sc]e", MENTION), ("unknown", r"end user licen[sc]e agreement", NAME),
)
#: What may stand before the name in a grant.
_GRANT = r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: First words of the signatures whose pattern begins with a choice.
_CHOICES = {"(?:released|placed|dedicated)": ("released", "placed", "dedicated"), "(?:www )?mozilla": ("www", "mozilla"), "licen[sc]ed": ("licensed", "licenced")}


def _version(words: str) -> str:
    """The ways to write a version: "2 0" also as "2", "v2", "version 2 0"."""
    major, minor = words.split()
    number = rf"{major}(?: 0)?" if minor == "0" else words
    return rf"(?:(?:international|unported|generic) )?(?:licen[sc]e )?(?:version |ver |v )?v?{number}(?: or(?: any)? later(?: version)?| only| international| unported| generic)?"


@cache
def rules() -> tuple[Rule, ...]:
    """Every rule, in order; of two at the same interval and priority, the earlier wins."""
    made = []
    for label, pattern, priority in SIGNATURES:
        first = next((v for k, v in _CHOICES.items() if pattern.startswith(k)), None) or (re.match(r"\w+", pattern)[0],)
        made.append(Rule(label, first, pattern, priority))
    for family, first, name, versions, tag in FAMILIES:
        for v in versions:
            label, ver = f"{family}-{v.replace(' ', '.')}", _version(v)
            made.append(Rule(label, ("spdx",), rf"spdx licen[sc]e identifier {tag} {v}(?: or later| only)?", TEXT))
            made.append(Rule(label, ("under",), rf"{_GRANT}{name} {ver}", GRANT))
            made.append(Rule(label, first, rf"{name} {ver}", VERSION))
            if family.startswith("cc-"):
                made.append(Rule(label, ("creativecommons",), rf"creativecommons org licenses {tag.removeprefix('cc ')} {v}", GRANT))
        made.append(Rule(family, ("spdx",), rf"spdx licen[sc]e identifier {tag}", TEXT))
        made.append(Rule(family, ("under",), _GRANT + name, GRANT))
        made.append(Rule(family, first, name, NAME))
    return tuple(made)


def parts_of(text: Column) -> Column:
    """The words, A-Z lower-cased; an empty string before them or behind them where the text doesn't begin or end with a word."""
    # the Kelvin sign is the one other character whose lower case is ASCII alone; any character beyond ASCII does in its place
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _places(words: Column, phrase: list[str]) -> Column:
    """The word numbers where a phrase stands."""
    numbers = F.transform(words, lambda w, i: F.when((w == phrase[0]) & (F.array_join(F.slice(words, i + 1, F.lit(len(phrase))), " ") == " ".join(phrase)), i))
    return F.array_compact(numbers)


def _detections(words: Column, table: tuple[Rule, ...]) -> Column:
    """start, -end, -priority, rule number of each rule's match at each place of its first word, in that order."""
    by_word: dict[str, list[dict]] = {}
    for n, r in enumerate(table):
        for w in r.first:
            by_word.setdefault(w, []).append({"rule": n, "rank": -r.priority, "pattern": f"^(?:{r.pattern}) "})
    known = F.from_json(F.lit(json.dumps(by_word)), "map<string,array<struct<rule:int,rank:int,pattern:string>>>")
    any_rule = "^(?:" + "|".join(r.pattern for r in table) + ") "
    first = F.array_intersect(F.array(*[F.lit(w) for w in sorted(by_word)]), words)
    window = lambda i: F.concat(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " "), F.lit(" "))
    # the first words that the text holds are few, and found once
    places = F.flatten(F.transform(F.array(first), lambda own: F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(own, w), i)))))
    held = F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), F.get(words, i).alias("w"), window(i).alias("text"))), lambda p: F.rlike(p["text"], F.lit(any_rule)))

    def at(p: Column) -> Column:
        def found(r: Column) -> Column:
            match = F.call_function("regexp_extract", p["text"], r["pattern"], F.lit(0))
            end = p["i"] + F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))
            return F.struct(p["i"].alias("start"), (-end).alias("minus_end"), r["rank"].alias("rank"), r["rule"].alias("rule"))

        return F.filter(F.transform(F.try_element_at(known, p["w"]), found), lambda d: -d["minus_end"] > d["start"])

    return F.sort_array(F.flatten(F.transform(held, at)))


def _kept(found: Column) -> Column:
    """The rules of the detections that none of the same or a higher priority contains: one fold, with the furthest end of each priority so far."""
    levels = len(STRENGTH)
    zero = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast("array<int>").alias("rules"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = F.array_max(F.slice(acc["ends"], 1 - d["rank"], F.lit(levels))) >= end
        ends = F.transform(acc["ends"], lambda e, k: F.when(k == -d["rank"], F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(inside, acc["rules"]).otherwise(F.array_union(acc["rules"], F.array(d["rule"]))).alias("rules"))

    return F.aggregate(found, zero, step, lambda acc: acc["rules"])


def scan_licenses(docs: DataFrame, table: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the contract's columns, and ``detections`` (start, end, label, priority by word numbers, before suppression)."""
    table = rules() if table is None else table
    labels = F.array(*[F.lit(r.label) for r in table]) if table else F.array().cast("array<string>")
    ranks = F.array(*[F.lit(STRENGTH[r.priority]) for r in table]) if table else F.array().cast("array<double>")
    rows = docs.select("doc_id", parts_of(F.col("text")).alias("parts"))
    rows = rows.select("doc_id", "parts", F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0).alias("head"), F.when(F.element_at("parts", -1) == "", 1).otherwise(0).alias("tail"))
    rows = rows.select("doc_id", "parts", "head", F.greatest(F.size("parts") - F.col("head") - F.col("tail"), F.lit(0)).cast("bigint").alias("n_words"), F.arrays_overlap("parts", F.array(*[F.lit(w) for w in GATE])).alias("gated"))
    rows = rows.select("doc_id", "n_words", F.when(F.col("gated"), F.slice("parts", 1 + F.col("head"), F.col("n_words").cast("int"))).otherwise(F.array().cast("array<string>")).alias("words"))
    # each step is a plan node of its own: arrays are made once for a row
    rows = rows.select("doc_id", "n_words", *[_places(F.col("words"), p.split()).alias(f"base_{k}") for k, p in enumerate(PHRASES)], (_detections(F.col("words"), table) if table else F.array().cast("array<struct<start:int,minus_end:int,rank:int,rule:int>>")).alias("found"))
    base = [F.col(f"base_{k}") for k in range(len(PHRASES))]
    rows = rows.select("doc_id", "n_words", F.concat(*base).alias("places"), F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(v)) for b, v in zip(base, PHRASES.values())])).alias("base"), "found", _kept(F.col("found")).alias("kept"))
    own = F.transform("kept", lambda k: F.get(labels, k))
    score = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda k: F.get(ranks, k))), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(STRENGTH[NAME])).otherwise(F.lit(0.0)))
    shown = F.transform("found", lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), F.get(labels, d["rule"]).alias("label"), (-d["rank"]).alias("priority")))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("base", own)), ",").alias("labels"), score.alias("score"), shown.alias("detections"),
    )
