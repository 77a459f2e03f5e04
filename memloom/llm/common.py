"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of one Arrow batch, where the session doesn't say; keeps a Python worker's memory bounded with long texts.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's reader only (the path may be a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, as in local tests, one of its own.

    Executors of a cluster don't share the driver's folders, so an unset folder is an error there.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="memloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, read again, and its path: for what is read more than once and soon removed."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, wherever the path's file system is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, object]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Applies ``work`` to the columns of each Arrow batch; it returns the columns of ``schema`` (lists, numpy or Arrow arrays).

    ``setup``, if given, runs once per task, and its result is ``work``'s second argument.
    Neither keeps state between tasks, so a lost executor's tasks can run again anywhere.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = setup() if setup else None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.to_pydict()
            made = work(columns, tools) if setup else work(columns)
            arrays = [v if isinstance(v := made[f.name], pa.Array) and v.type == f.type else pa.array(v, type=f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt out anew by a join on the (long) ``keys``.

    The result of an aggregate lies by its keys already, and a join would take it as it lies; then both sides of a hot key
    are stuck in one task. Keys that come from an expression make the join deal both sides, and adaptive execution
    can split a hot key's rows.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("bigint")) for k in keys})


def small_batches(spark: SparkSession) -> None:
    """Gets the session ready for this package's Python workers."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def filter_rows(docs: DataFrame, keep: Callable[[list, object], object], setup: Callable[[], object]) -> DataFrame:
    """The rows of ``docs``, with all their columns, where ``keep`` (of the texts of a batch, and of what ``setup`` made for the task) is true."""
    small_batches(docs.sparkSession)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = setup()
        for batch in batches:
            yield batch.filter(pa.array([bool(x) for x in keep(batch.column(column).to_pylist(), tools)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is a multiple of 5: rows that no label may be learned from. A null id counts as text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0
