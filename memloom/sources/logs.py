"""The op log's files as a source: read by ranges of bytes in a batch, and followed by offsets as a stream.

A batch goes through Spark's text reader, which cuts a file anywhere and gives each line to the range that it begins in,
on any file system that Spark reads, in ranges as large as the session's setting makes them. Lines are numbered by a count
of each range: a task numbers its own ranges' lines as they come, the ranges' sizes are summed up in order of their place
(one row each), and a line's number is its range's sum and its own.

The stream source ``memloom_log`` follows one growing file, or a folder of segments in order of their names, of which
the last one grows; bytes are counted through all segments. An offset is a number of bytes: the end of the last whole
line that was seen. A batch between two offsets is cut into ranges of ``rangeBytes``; each task reads its own range and
on to the end of its last line. A torn line is left until its end has been written. Numbers aren't known to a stream
without reading what was before, so it gives ``at``, the byte that a line begins at, which orders lines like numbers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import checkpointed, ship, written

RANGE_BYTES = 64 << 20
#: Ranges whose places are broadcast to the lines.
MOST_RANGES = 1_000_000


def numbered_lines(spark: SparkSession, path: str, through: bool = False, kept: Column | None = None) -> DataFrame:
    """file, n, value: the lines of each file below ``path`` with their numbers, from 1; empty lines count and are left out. With ``through`` the files are one log's segments, and the numbers go on from file to file in order of their names.

    With ``kept``, made of ``value``: file, n, whole, kept. Then a text goes no further than the task that reads it.
    """
    own = [F.col("value")] if kept is None else [_whole().alias("whole"), kept.alias("kept")]
    block = F.col("_metadata.file_block_start").alias("block")
    # a task's ranges come one after another, each in the file's order, so a range's lines have ids without gaps
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block, F.monotonically_increasing_id().alias("at"), (F.col("value") != "").alias("filled"), *own)
    lines, _ = written(rows)  # written once: reading it again must give the same ranges
    sizes = checkpointed(lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("size")))
    order = Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")  # one row for each range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + 1).alias("base"))
    few = sizes.count() <= MOST_RANGES  # then the lines aren't shuffled for it
    return lines.join(F.broadcast(base) if few else base, ["file", "block"]).where("filled").select("file", (F.col("base") + F.col("at")).alias("n"), *(["value"] if kept is None else ["whole", "kept"]))


def _whole() -> Column:
    return F.json_object_keys("value").isNotNull()


def whole_lines(rows: DataFrame) -> DataFrame:
    """rows: file, n, value (a JSON line), or file, n, whole, kept. Those that were written whole: a broken last line of a file is a torn write and goes, any other is an error."""
    last = rows.groupBy("file").agg(F.max("n").alias("last_n"))
    parsed = rows.join(F.broadcast(last), "file")
    if "whole" not in rows.columns:
        parsed = parsed.withColumn("whole", _whole())
    broken = F.raise_error(F.format_string("line %d of %s is broken", "n", "file")).cast("boolean")
    return parsed.where(F.when(F.col("whole"), True).when(F.col("n") == F.col("last_n"), False).otherwise(broken)).select("file", "n", *[c for c in rows.columns if c not in ("file", "n", "whole")])


class Bytes(InputPartition):
    """Lines that begin in [start, end) of the file ``path``; ``limit`` is where the file's last whole line ends, ``base`` the bytes of the segments before it."""

    def __init__(self, start: int, end: int, limit: int, path: str = "", base: int = 0):
        self.start, self.end, self.limit, self.path, self.base = start, end, limit, path, base


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def _segments(path: str) -> list[tuple[str, int, int]]:
    """Each file of the log, in order: its path, the bytes before it, its size. Names that begin with ``_`` or ``.`` are no segments."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, 0, info.size or 0)]
    found = sorted((x.base_name, x.size or 0) for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name[0] not in "_.")
    out, base = [], 0
    for name, size in found:
        out.append((f"{path.rstrip('/')}/{name}", base, size))
        base += size
    return out


def _end_of_lines(path: str, known: int) -> int:
    """The byte behind the last newline of the log, looked for from its end back to ``known``."""
    if not (held := _segments(path)):
        return known
    last, base, size = held[-1]
    known = max(0, known - base)
    return base + _end_in(last, size, known)


def _end_in(path: str, size: int, known: int) -> int:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        while size > known:
            start = max(known, size - (1 << 20))
            f.seek(start)
            found = f.read(size - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            size = start
    return known


def _ranges(start: int, limit: int, step: int, path: str = "", base: int = 0) -> list[Bytes]:
    return [Bytes(a, min(a + step, limit), limit, path, base) for a in range(start, limit, step)]


def _log_ranges(path: str, start: int, limit: int, step: int) -> list[Bytes]:
    """The log's bytes from ``start`` to ``limit``, each range within a segment."""
    return [part for own, base, size in _segments(path) for part in _ranges(max(start - base, 0), min(limit - base, size), step, own, base)]


def _lines(path: str, part: Bytes) -> Iterator[tuple[int, str]]:
    if part.start >= part.end:
        return
    system, inner = _open(part.path or path)
    with system.open_input_file(inner) as f:
        at = part.start
        if at:  # the line that runs into this range is the range's before
            f.seek(at - 1)
            at -= 1
        else:
            f.seek(0)
        kept, skip = b"", part.start > 0
        while at < part.end and at + len(kept) <= part.limit:
            cut = kept.find(b"\n")
            if cut < 0:
                more = f.read(min(1 << 20, part.limit - at - len(kept)))
                if not more:
                    return
                kept += more
                continue
            line, kept = kept[:cut], kept[cut + 1 :]
            if skip:
                skip = False
            elif line:
                yield part.base + at, line.decode()
            at += cut + 1


class LogSource(DataSource):
    """``format("memloom_log")``, options ``path`` and ``rangeBytes``; columns at, value."""

    @classmethod
    def name(cls) -> str:
        return "memloom_log"

    def schema(self) -> str:
        return "at bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class LogReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[Bytes]:
        return _log_ranges(self.path, 0, _end_of_lines(self.path, 0), self.step) or [Bytes(0, 0, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple[int, str]]:
        return _lines(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, step: int):
        self.path, self.step, self.seen = path, step, 0

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        self.seen = _end_of_lines(self.path, self.seen)
        return {"bytes": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        return _log_ranges(self.path, start["bytes"], end["bytes"], self.step)

    def read(self, partition: Bytes) -> Iterator[tuple[int, str]]:
        return _lines(self.path, partition)


def followed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """at, value: the whole lines of the growing file ``path``, or of the segments in that folder, as a stream."""
    ship(spark)
    spark.dataSource.register(LogSource)
    return spark.readStream.format("memloom_log").option("path", path).option("rangeBytes", str(range_bytes)).load()


def ranged(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """at, value: the whole lines that are there now, by the same ranges."""
    ship(spark)
    spark.dataSource.register(LogSource)
    return spark.read.format("memloom_log").option("path", path).option("rangeBytes", str(range_bytes)).load()
