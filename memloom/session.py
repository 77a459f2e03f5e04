"""Session helpers: a local session for tests and benches, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("memloom")
    own = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
    }
    return builder.config(map=own | conf).getOrCreate()


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
    """The rows as a Parquet table in the shared folder, read again, and its path: for what is read more than once."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="memloom-")) / "memloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
