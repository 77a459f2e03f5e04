"""Tamper evidence of an op log by segments: lines are hashed beside one another, not one after another.

The log is cut into segments of ``SEGMENT`` numbers. Within a segment a line's leaf is SHA-256 (HMAC with a key) over
its number and canonical text; leaves are paired level by level into the segment's root, and the segments' roots, in
order and by segments again, into the log's root. The root with the number of lines is the checkpoint that an owner
keeps apart. A task holds the hashes of one segment, whatever the log's length, and no line waits for the one before.

A node without a partner goes up as it is. A gap leaves its leaf out; every number that is missing is named.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Lines of a segment, a power of two.
SEGMENT = 1 << 16
#: The inner block of SHA-256, and the bytes that a key is mixed with on its way in and out.
BLOCK_BYTES, INNER, OUTER = 64, 0x36, 0x5C


def signed(text: Column, key: bytes | None = None) -> Column:
    """SHA-256 of a text, or its HMAC with ``key``, in hex, by built-in functions."""
    body = F.encode(text, "UTF-8")
    if key is None:
        return F.sha2(body, 256)
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK_BYTES else key).ljust(BLOCK_BYTES, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(OUTER), F.unhex(F.sha2(F.concat(pad(INNER), body), 256))), 256)


def leaves(lines: DataFrame, line: Column, key: bytes | None = None) -> DataFrame:
    """lines: seq. seq, hash of each line; its number is part of what is hashed."""
    return lines.select(F.col("seq").cast("bigint").alias("seq"), signed(F.concat_ws("\n", F.col("seq").cast("string"), line), key).alias("hash"))


def _levels(at: list[int], hashes: list[str]) -> list[dict[int, bytes]]:
    """The levels of a segment's tree, from its leaves by their place up to its root."""
    level = {a: bytes.fromhex(h) for a, h in zip(at, hashes)}
    out = [level]
    while len(level) > 1 or max(level, default=0):
        above: dict[int, bytes] = {}
        for a in sorted(level):
            above[a // 2] = hashlib.sha256(above[a // 2] + level[a]).digest() if a // 2 in above else level[a]
        out.append(level := above)
    return out


def _placed(leaf: DataFrame, segment: int) -> DataFrame:
    if segment < 2 or segment & (segment - 1):
        raise ValueError(f"a segment has a power of two of lines, 2 at least, not {segment}")
    return leaf.select(F.floor((F.col("seq") - 1) / segment).cast("bigint").alias("segment"), ((F.col("seq") - 1) % segment).cast("bigint").alias("at"), "hash")


def sealed(leaf: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """segment, first, n, root of each segment that has lines."""
    import pandas as pd

    ship(leaf.sparkSession)

    def seal(rows):
        levels = _levels(rows["at"].tolist(), rows["hash"].tolist())
        return pd.DataFrame({"segment": rows["segment"][:1], "first": rows["segment"][:1] * segment + 1, "n": [len(rows)], "root": [levels[-1][0].hex()]})

    return _placed(leaf, segment).groupBy("segment").applyInPandas(lambda rows: seal(rows), "segment bigint, first bigint, n bigint, root string")


def _as_leaves(seals: DataFrame) -> DataFrame:
    return seals.select((F.col("segment") + 1).alias("seq"), F.col("root").alias("hash"))


def root(seals: DataFrame, segment: int = SEGMENT) -> tuple[int, str]:
    """The checkpoint: the number of lines, and the root over the segments' roots; (0, "") of an empty log, which proves nothing."""
    n = seals.agg(F.sum("n")).first()[0] or 0
    while seals.agg(F.max("segment")).first()[0]:
        seals = checkpointed(sealed(_as_leaves(seals), segment))
    top = seals.first()
    return n, top["root"] if top else ""


def faults(lines: DataFrame, line: Column, kept: DataFrame, key: bytes | None = None) -> DataFrame:
    """lines: seq and what ``line`` is made of; kept: seq, hash (the leaves that the writer kept). seq, fault of each number that isn't what was written: ``gap`` (gone), ``hash`` (changed), ``extra`` (added), ``twice``."""
    now = leaves(lines, line, key).groupBy("seq").agg(F.count("*").alias("times"), F.min("hash").alias("hash"), F.max("hash").alias("other"))
    was = kept.select("seq", F.col("hash").alias("kept"))
    both = was.join(now, "seq", "full")
    same = F.coalesce((F.col("hash") == F.col("kept")) & (F.col("other") == F.col("kept")), F.lit(False))
    fault = F.when(F.col("kept").isNull(), "extra").when(F.col("hash").isNull(), "gap").when(F.col("times") > 1, "twice").when(~same, "hash")
    return both.select("seq", fault.alias("fault")).where("fault IS NOT NULL")


def broken_segments(lines: DataFrame, line: Column, seals: DataFrame, key: bytes | None = None, segment: int = SEGMENT) -> DataFrame:
    """segment, first, fault of the segments whose lines don't give the root that was kept: what has to be looked at line by line."""
    now = sealed(leaves(lines, line, key), segment).select("segment", F.col("root").alias("now"), F.col("n").alias("now_n"))
    both = seals.join(now, "segment", "full")
    fault = F.when(F.col("root").isNull(), "extra").when(F.col("now").isNull(), "gone").when(F.col("n") != F.col("now_n"), "count").when(F.col("root") != F.col("now"), "hash")
    return both.select("segment", F.coalesce("first", F.col("segment") * segment + 1).alias("first"), fault.alias("fault")).where("fault IS NOT NULL")


def proof(leaf: DataFrame, seqs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """leaf: seq, hash; seqs: seq, a stated set. seq, path: for each number the hashes that lead from its leaf to the log's root, in order, each with its side (``left``, ``right``)."""
    import pandas as pd

    step = "struct<side:string,hash:string>"
    ship(leaf.sparkSession)

    def paths(rows, asked):
        levels, out = _levels(rows["at"].tolist(), rows["hash"].tolist()) if len(rows) else [], []
        for seq, at in zip(asked["seq"].tolist(), asked["at"].tolist()):
            path, k = [], at
            for level in levels[:-1]:
                if k ^ 1 in level:
                    path.append({"side": "left" if k & 1 else "right", "hash": level[k ^ 1].hex()})
                k //= 2
            out.append((seq, path))
        return pd.DataFrame(out, columns=["seq", "path"])

    where = seqs.select(F.col("seq").cast("bigint").alias("seq")).distinct()
    asked = where.select("seq", F.floor((F.col("seq") - 1) / segment).cast("bigint").alias("segment"), ((F.col("seq") - 1) % segment).cast("bigint").alias("at"))
    own = _placed(leaf, segment).join(F.broadcast(asked.select("segment").distinct()), "segment", "left_semi")  # a stated set
    found = own.groupBy("segment").cogroup(asked.groupBy("segment")).applyInPandas(lambda r, q: paths(r, q), f"seq bigint, path array<{step}>")
    if not leaf.where(F.col("seq") > segment).limit(1).count():
        return found
    above = proof(checkpointed(_as_leaves(sealed(leaf, segment))), asked.select((F.col("segment") + 1).alias("seq")), segment)
    upper = above.select((F.col("seq") - 1).alias("segment"), F.col("path").alias("upper"))
    return found.join(asked.select("seq", "segment"), "seq").join(upper, "segment").select("seq", F.concat("path", "upper").alias("path"))


def proven(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    join = lambda a, b: F.sha2(F.concat(F.unhex(a), F.unhex(b)), 256)
    return F.aggregate(path, leaf_hash, lambda at, step: F.when(step["side"] == "right", join(at, step["hash"])).otherwise(join(step["hash"], at)))
