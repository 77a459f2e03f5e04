"""A table that changes in place: copy-on-write by buckets of keys, versions that stay readable, and an atomic commit.

Rows lie in buckets by a hash of their key. A version is a small manifest: for each bucket the folder that holds it. A
change is a table of rows; the buckets that its keys fall into are read, joined with it and written anew, all others are
named by the new manifest as they are. So ten touched rows rewrite the buckets that hold them and nothing else, every
read starts from files (no plan grows from change to change), and an older manifest is an older snapshot.

A commit is the creation of the manifest's file under the next number, which fails if it is there: of two writers from
the same version one wins, and the other one's change raises ``Conflict`` and can be made again. Files that no manifest
names are left by lost writers and harmless; ``vacuum`` removes what no kept version names. Names go through Spark's
own file systems, so the folder may be anywhere that Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Changes of one merge, and characters of their strings, that are broadcast to the rows; with more, both are shuffled by key.
MOST_CHANGES, MOST_CHARACTERS = 1_000_000, 64_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class VersionedTable:
    """``path``: the table's folder; ``key``: the column that tells its rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = json.loads(self._text(f"{path}/table.json"))
        self.key, self.buckets, self.schema = about["key"], about["buckets"], about["schema"]

    # -------------------------------------------------------- files

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        at, system = self._at(path)
        stream = system.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        at, system = self._at(path)
        try:
            stream = system.create(at, False)
        except Exception as taken:  # whatever a file system says when the name is taken
            if system.exists(at):
                raise Conflict(path) from taken
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    # -------------------------------------------------------- versions

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> VersionedTable:
        """Writes ``rows`` as version 1. A key that several rows have is an error, and so is one without a value."""
        spark = rows.sparkSession
        twice = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(key).isNull()).limit(1).collect()
        if twice:
            raise ValueError(f"key {twice[0][key]!r} has {twice[0]['n']} rows")
        self = object.__new__(cls)
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._create(f"{path}/table.json", json.dumps({"key": key, "buckets": buckets, "schema": self.schema}))
        folder = self._write(rows)
        self._commit(1, {str(b): folder for b in range(buckets)})
        return self

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        return self._save(rows.withColumn("_bucket", self._bucket()).repartition("_bucket"))

    def _save(self, rows: DataFrame) -> str:
        """rows: with ``_bucket``, by which they needn't be dealt."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, version: int, folders: dict[str, str]) -> int:
        self._create(f"{self.path}/versions/{version:012d}.json", json.dumps(folders, sort_keys=True))
        return version

    def versions(self) -> list[int]:
        at, system = self._at(f"{self.path}/versions")
        return sorted(int(x.getPath().getName()[:-5]) for x in system.listStatus(at) if x.getPath().getName().endswith(".json"))

    def folders(self, version: int | None = None) -> dict[str, str]:
        """The folder of each bucket in a version (the last, if none is named)."""
        return json.loads(self._text(f"{self.path}/versions/{version or self.versions()[-1]:012d}.json"))

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        """The rows of some buckets, from the files of those alone."""
        by_folder: dict[str, list[int]] = {}
        for bucket, folder in folders.items():
            by_folder.setdefault(folder, []).append(int(bucket))
        out = None
        for folder, own in sorted(by_folder.items()):
            part = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/{folder}").where(F.col("_bucket").isin(own)).drop("_bucket")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.folders(version))

    # -------------------------------------------------------- changes

    def merge(self, changes: DataFrame, base: int | None = None) -> int:
        """changes: the key, any of the other columns, and optionally ``_deleted``. The number of the version that has them.

        A key that the table has takes the values that aren't null (an update names what it sets); one that it hasn't is
        added; one whose ``_deleted`` is true goes. Of several changes of a key in one merge, it is undefined which holds;
        a key without a value is passed over. ``base``: the version that the change was made from.
        """
        base = base or self.versions()[-1]
        held = self.folders(base)
        names = [n for n in changes.columns if n not in (self.key, "_deleted")]
        gone = F.coalesce("_deleted", F.lit(False)) if "_deleted" in changes.columns else F.lit(False)
        new = changes.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        new = new.select(F.col(self.key), gone.alias("_deleted"), F.lit(True).alias("_changed"), *[F.col(n).alias(f"_new_{n}") for n in names])
        touched = sorted(r[0] for r in new.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return base
        rows, left = self._rows({str(b): held[str(b)] for b in touched}), ~F.coalesce("_deleted", F.lit(False))
        columns = [F.col(n) if n not in names else F.coalesce(f"_new_{n}", n).alias(n) for n in self.spark.createDataFrame([], self.schema).columns]
        strings = [F.coalesce(F.length(f.name), F.lit(0)) for f in new.schema if f.dataType.simpleString() == "string"]
        count, characters = new.agg(F.count("*"), F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0))).first()
        if count > MOST_CHANGES or characters > MOST_CHARACTERS:
            folder = self._write(rows.join(new, self.key, "full").where(left).select(*columns))
        else:
            # rows stay where they are read, bucket by bucket, and only what is added is dealt out
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != self.key]
            added = new.join(F.broadcast(rows.select(self.key).join(F.broadcast(new.select(self.key)), self.key, "left_semi")), self.key, "left_anti")  # as many as there are changes at most
            added = added.select("*", *none).where(left).select(*columns).withColumn("_bucket", self._bucket()).repartition("_bucket")
            kept = rows.join(F.broadcast(new), self.key, "left").where(left).select(*columns).withColumn("_bucket", self._bucket())
            folder = self._save(kept.unionByName(added))
        return self._commit(base + 1, held | {str(b): folder for b in touched})

    def touch(self, ids: DataFrame, now: float, count: str = "access_count", at: str = "accessed_at") -> int:
        """Counts one more use of each of ``ids`` (the key; a stated set), at ``now``; ids that the table hasn't are passed over."""
        base = self.versions()[-1]
        asked = ids.select(self.key).distinct()
        buckets = {str(r[0]) for r in asked.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._rows({b: f for b, f in self.folders(base).items() if b in buckets}).join(asked, self.key, "left_semi")
        return self.merge(rows.select(self.key, (F.coalesce(F.col(count), F.lit(0)) + 1).alias(count), F.lit(float(now)).alias(at)), base)

    def vacuum(self, keep: int = 1) -> int:
        """Removes the versions before the last ``keep`` ones, and every folder that none of the others names. The number of folders removed."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for f in self.folders(v).values()}
        for v in versions[:-keep]:
            at, system = self._at(f"{self.path}/versions/{v:012d}.json")
            system.delete(at, False)
        at, system = self._at(f"{self.path}/data")
        left = [x.getPath() for x in system.listStatus(at) if f"data/{x.getPath().getName()}" not in named]
        for x in left:
            system.delete(x, True)
        return len(left)
