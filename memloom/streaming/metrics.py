"""Counts that a query takes of its own rows while it runs, and sinks for them.

``observed`` puts aggregates beside a plan; they come with the plan's one run, without a second pass over the data. What
they give is a row for each metric, ready for a table. ``StreamMetrics`` listens to streams: the observed counts of every
trigger, its rows and times, and the error that ended a stream, each as a row of the same form.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "source string, step bigint, metric string, value double, error string"


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and where the metrics (aggregates by name) are found once an action over them has run."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def rows_of(source: str, step: int, metrics: dict) -> list[tuple]:
    """A row for each metric that is a number; a metric without a value (of no rows) has none."""
    return [(source, step, n, None if v is None else float(v), None) for n, v in metrics.items() if v is None or isinstance(v, (int, float)) or hasattr(v, "__float__")]


def metric_rows(spark: SparkSession, *seen: Observation, names: tuple[str, ...] = ()) -> DataFrame:
    """source, step, metric, value, error of what was observed; waits for the actions to have run."""
    made = [r for k, s in enumerate(seen) for r in rows_of(names[k] if k < len(names) else f"observed {k}", 0, s.get)]
    return spark.createDataFrame(made, SCHEMA)


class StreamMetrics(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; ``flush`` appends what has come so far to a table."""

    def __init__(self):
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def _add(self, rows: list[tuple]) -> None:
        with self._lock:
            self._rows += rows

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = {"input_rows": p.numInputRows, **{f"ms {k}": v for k, v in p.durationMs.items()}}
        for name, row in p.observedMetrics.items():
            own |= {f"{name}.{k}": v for k, v in row.asDict().items()}
        self._add(rows_of(p.name or str(p.id), p.batchId, own))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add([(str(event.id), -1, "failed", 1.0, event.exception)])

    def taken(self) -> list[tuple]:
        """What has come since the last time."""
        with self._lock:
            out, self._rows = self._rows, []
        return out

    def flush(self, spark: SparkSession, path: str) -> int:
        """Appends to the Parquet table at ``path``; the number of rows."""
        rows = self.taken()
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return len(rows)


def errors(rows: DataFrame) -> DataFrame:
    """The errors among metric rows: source, error."""
    return rows.where("error IS NOT NULL").select("source", "error")


def as_json(rows: DataFrame) -> list[str]:
    """A line for each metric, for a log."""
    return [json.dumps(r.asDict(), sort_keys=True) for r in rows.collect()]
