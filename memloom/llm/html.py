"""Operator 10, main text of web pages: a host's suffix arrays find what its pages repeat, and tags say what the rest is.

Each page is cut into blocks of visible text in page order. The words of the blocks that aren't noise by their tags are
the page's token stream. A host's pages are dealt into groups of about ``GROUP`` by the hash of their stream; the streams
of a group lie one after another under a suffix array, ordered by prefix doubling to ``DEPTH`` tokens, which brings
equal runs together (a token lies in a repeated substring of DEPTH tokens or more exactly if it lies in one of DEPTH).
Each run that two or more pages of a group have is counted over the whole host by partial sums of (host, run, pages);
equal streams lie in one group and count as one page, whatever their number. A run is boilerplate if it is on a share
``LEAST_SHARE`` of the host's distinct pages, and common to the host if it is on ``MAIN_SHARE`` of them.

A block goes if its tags say that it is a menu, header, footer, sidebar, notice, advert, form or reader comment; where a
page has an ``article`` or ``main`` element, if it is outside; and if runs cover it: boilerplate where no such element
vouches for it, what is common to the host inside one. So a notice that half of a host's pages have goes from their
articles, and a passage that some articles share stays.

By the pigeonhole a run on the share of the pages is on two pages of one group at least, so none is missed; its count may
lack the pages that are the only ones of their group to have it, one in GROUP pages at most. A host's runs that are on the
share of its pages are no more than its mean page has tokens, ten times; they go to the executors by broadcast if all
hosts together have at most ``MOST_RUNS``, else by a shuffle, once for each GROUP pages.

Defined results: a null or empty html gives an empty text. Pages without a host in the url (null too) count as one host.
Copies of a page get the same text, however many there are; repeated rows give repeated results. Hosts with fewer than
LEAST_PAGES distinct pages have no runs, and tags decide. Other input columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import struct

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, loose, map_batches, small_batches

#: Tokens of a run; the pages and the share of a host's pages that boilerplate is on at least, and what is common to the host; the share of a block that runs must cover.
DEPTH, LEAST_PAGES, LEAST_SHARE, MAIN_PAGES, MAIN_SHARE, COVERED = 8, 4, 0.1, 8, 0.5, 0.8
GROUP = 128
#: Hosts of more than one group that are broadcast, and runs of all hosts; beyond that they are joined by a shuffle.
MOST_HOSTS, MOST_RUNS = 200_000, 4_000_000
#: Streams that a task remembers, to send each of several copies once.
SEEN = 100_000

# Fixed names of HTML. No part of the pattern but a quoted value, a comment or a script's body runs over another "<", so broken markup stays cheap.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^<>]*+>|[^<]++|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = frozenset("head nav footer aside form button select option dialog menu object audio video canvas map datalist".split())
MAIN = frozenset("article main".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w+|banners?|sponsor\w*|promos?|promotions?|side-?bars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|comments?|disqus|replies|reply|widgets?|toolbar|pagination|pager|complementary|contentinfo|hidden)(?:$|[\s_-])",
    re.I,
)


def noisy(tag: str, attributes: str, inside: bool) -> bool:
    if tag in GONE or tag == "header" and not inside:
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role") and NOISE.search(value) or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """The visible blocks in page order: their text, and 0 for noise by its tags, 1 for text outside ``article`` and ``main``, 2 for text inside."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, is noise, is main
    open_tags: dict[str, int] = {}
    noise = main = 0

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((text, 0 if noise else 2 if main else 1))
            parts.clear()

    def close(n: int) -> None:
        nonlocal noise, main
        while len(stack) > n:
            name, a, b = stack.pop()
            open_tags[name] -= 1
            noise -= a
            main -= b

    for m in TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            if m[1] is None and m[0][0] != "<":
                parts.append(m[0])
            elif m[0] == "<":
                parts.append("&lt;")
            continue
        tag = tag.lower()
        if m[2]:
            at = None
            if open_tags.get(tag):
                at = len(stack) - 1
                while at >= 0 and stack[at][0] != tag:
                    if tag in INLINE and stack[at][0] not in INLINE:
                        at = -1  # an inline tag closes nothing across a block
                        break
                    at -= 1
                at = None if at < 0 else at
            if tag not in INLINE or at is not None and stack[at][1]:
                flush()
            if at is not None:
                close(at)
        elif tag == "br":
            parts.append(" ")
        else:
            a = noisy(tag, m[4], main > 0)
            if tag not in INLINE or a:
                flush()
            if tag not in INLINE:  # a block ends an open paragraph, list items end one another
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag == "li":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if tag not in VOID and not m[4].endswith("/"):
                stack.append((tag, a, tag in MAIN))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                noise += a
                main += tag in MAIN
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens, by prefix doubling; equal ranks share them all."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        step = min(k, depth - k)
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[: max(0, len(rank) - step)] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        k += step
    return rank


class Words(dict):
    """Hashes of the words met so far; emptied when it holds ``MOST``."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def stream(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all blocks, and the number of words of each."""
    words = [t.split() for t in texts]
    return np.array([known[w] for x in words for w in x], dtype=np.uint64), np.array([len(x) for x in words], dtype=np.int64)


def run_hashes(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The hash of each run of ``depth`` tokens."""
    n = len(tokens) - depth + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.full(n, depth, dtype=np.uint64)
    for k in range(depth):
        h = (h ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def repeated(streams: list[np.ndarray], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Runs (their hashes) that two or more of the streams have, and the number of streams that have each."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    none = np.empty(0, dtype=np.int64)
    if not sizes.sum():
        return none, none
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.empty(sizes.sum() + len(streams), dtype=np.int64)
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    text = np.ones(len(tokens), dtype=bool)
    text[ends] = False
    numbers = np.unique(np.concatenate(streams), return_inverse=True)[1]
    tokens[text] = numbers
    tokens[ends] = -1 - np.arange(len(streams))  # no run crosses a page's end
    rank = suffix_ranks(tokens, depth)
    pairs = np.unique(rank * len(streams) + page)
    pages = np.bincount(pairs // len(streams), minlength=int(rank.max()) + 1)
    first = np.unique(rank, return_index=True)[1]  # a place of each rank
    first = first[pages >= 2]
    hashed = np.concatenate([np.append(run_hashes(s, depth), np.zeros(min(depth, len(s) + 1), dtype=np.int64)) for s in streams])
    return hashed[first], pages[pages >= 2]


def covered_share(tokens: np.ndarray, sizes: np.ndarray, runs: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The share of each block's tokens that the (sorted) runs cover."""
    h = run_hashes(tokens, depth)
    cover = np.zeros(len(tokens) + 1, dtype=np.int64)
    if len(runs) and len(h):
        hit = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, h), len(runs) - 1)] == h)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + depth, -1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(cover[: len(tokens)]) > 0)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, sizes)


def main_text(blocks: list[tuple[str, int]], boilerplate: np.ndarray, common: np.ndarray, known: Words) -> tuple[str, int]:
    """The text of a page from its blocks and its host's runs (sorted hashes), and the number of blocks that runs took."""
    best = max((role for _, role in blocks), default=0)
    if not best:
        return "", 0
    own = [(t, role) for t, role in blocks if role]
    runs = common if best == 2 else boilerplate
    if not len(runs):
        return "\n".join(t for t, role in own if role == best), 0
    share = covered_share(*stream([t for t, _ in own], known), runs)
    rest = [(t, s < COVERED) for (t, role), s in zip(own, share) if role == best]
    return "\n".join(t for t, stays in rest if stays), sum(not stays for _, stays in rest)


RUNS = "host bigint, run bigint, pages bigint"
TEXTS = "page_id bigint, url string, text string, n_chars bigint, n_repeated int"


def _streams(batch: dict, seen: set[tuple[int, int]]) -> dict:
    """The words of each page that aren't noise, packed; copies that the task has ``seen`` are left out."""
    out: dict[str, list] = {k: [] for k in ("host", "key", "stream", "packed")}
    press = zstandard.ZstdCompressor(level=3).compress
    for host, groups, page in zip(batch["host"], batch["groups"], batch["html"]):
        line = " ".join(t for t, role in blocks_of(page) if role).encode()
        number = xxhash.xxh3_64_intdigest(line)
        if (host, number) in seen:
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add((host, number))
        out["host"].append(host)
        out["key"].append(xxhash.xxh3_64_intdigest(struct.pack("<qq", host, number % groups)) - (1 << 63))
        out["stream"].append(number - (1 << 63))
        out["packed"].append(press(line))
    return out


def _group_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """The repeated runs of a group of a host's pages; run 0 stands for the pages themselves."""
    unpack = zstandard.ZstdDecompressor().decompress
    known = Words()
    lines = rows.drop_duplicates(["host", "stream"])  # a hash of host and group may, once in a long while, be that of another
    made = []
    for host, packed in lines.groupby("host")["packed"]:
        runs, pages = repeated([stream([unpack(p).decode()], known)[0] for p in packed])
        live = runs != 0
        made.append(pd.DataFrame({"host": host, "run": np.append(runs[live], 0), "pages": np.append(pages[live], len(packed))}))
    return pd.concat(made)


def host_runs(rows: DataFrame) -> DataFrame:
    """rows: host (a hash), groups, html. host, boilerplate, common: the runs of each host that has any, sorted."""
    dealt = map_batches(rows.select("host", "groups", "html"), _streams, "host bigint, key bigint, stream bigint, packed binary", set)
    counted = dealt.groupBy("key").applyInPandas(lambda group: _group_runs(group), RUNS).groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    counted = checkpointed(counted)
    sizes = counted.where("run = 0").select("host", F.col("pages").alias("all"))
    share = lambda least, part: F.col("pages") >= F.greatest(F.lit(float(least)), F.lit(part) * F.col("all"))
    kept = counted.where("run <> 0").join(loose(sizes, "host"), "host").where(share(LEAST_PAGES, LEAST_SHARE))
    main = F.when(share(MAIN_PAGES, MAIN_SHARE), F.col("run"))
    return checkpointed(kept.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("boilerplate"), F.sort_array(F.collect_list(main)).alias("common")))


def _page_texts(columns: dict, runs_of) -> dict:
    known = Words()
    made = [main_text(blocks_of(page), *runs_of(host), known) for host, page in zip(columns["host"], columns["html"])]
    return {"page_id": columns["page_id"], "url": columns["url"], "text": [t for t, _ in made], "n_chars": [len(t) for t, _ in made], "n_repeated": [n for _, n in made]}


def extract_main_text(pages: DataFrame, group: int = GROUP, most_runs: int = MOST_RUNS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_repeated (blocks that runs took)."""
    host = F.xxhash64(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    many = checkpointed(rows.groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")).where("groups > 1"))
    many = F.broadcast(many) if many.count() <= MOST_HOSTS else loose(many, "host")
    rows = rows.join(many, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    runs = host_runs(rows)
    none = np.empty(0, dtype=np.int64)
    if (runs.agg(F.sum(F.size("boilerplate"))).first()[0] or 0) <= most_runs:
        small = {r["host"]: (np.array(r["boilerplate"], dtype=np.int64), np.array(r["common"], dtype=np.int64)) for r in runs.collect()}  # at most most_runs numbers, checked
        handle = pages.sparkSession.sparkContext.broadcast(small)
        return map_batches(rows.select("page_id", "url", "host", "html"), lambda batch, held: _page_texts(batch, lambda h: held.get(h, (none, none))), TEXTS, lambda: handle.value)
    # a host's runs go to each part of its pages; the parts don't matter to the result, so pages are dealt by their place
    part = F.pmod(F.monotonically_increasing_id(), F.col("groups"))
    placed = rows.select("page_id", "url", "host", "html", part.alias("part"))
    parts = runs.join(rows.select("host", "groups").distinct(), "host").select("host", "boilerplate", "common", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("part"))
    small_batches(pages.sparkSession)

    def texts(found: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = (held["boilerplate"].iloc[0], held["common"].iloc[0]) if len(held) else (none, none)
        own = tuple(np.asarray(x, dtype=np.int64) for x in own)
        out = pd.DataFrame(_page_texts({k: found[k].tolist() for k in ("host", "html", "url")} | {"page_id": found["page_id"].astype("Int64")}, lambda h: own))
        return out[["page_id", "url", "text", "n_chars", "n_repeated"]]

    return placed.groupBy("host", "part").cogroup(parts.groupBy("host", "part")).applyInPandas(lambda a, b: texts(a, b), TEXTS)
