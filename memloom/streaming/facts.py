"""Streams: the journal tailed, event windows, and open facts kept as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SLOT = ["entity_id", "fact_type", "believed_by"]
#: Groups that slots are dealt into by hash: a trigger calls Python once for each group with arrivals, however many slots it has.
GROUPS = 1024
STATE = "held binary"
CHANGES = "entity_id string, fact_type string, believed_by string, id bigint, valid_from double, valid_until double"


def tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The journal's files as a stream of ops."""
    return spark.readStream.schema(schema).json(folder)


def _changed(held, rows):
    """The changes that arrivals make, and the facts that are open then; ``held`` are those open before, one for each slot. Both hold many slots."""
    import numpy as np
    import pandas as pd

    rows = pd.concat([held, rows.sort_values(["seq", "id"], kind="stable")], ignore_index=True)
    slot = rows.groupby(SLOT, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(slot, kind="stable")  # slot by slot, the open fact before the arrivals
    rows, slot = rows.iloc[order].reset_index(drop=True), slot[order]
    first = np.concatenate(([True], slot[1:] != slot[:-1]))
    start = rows["valid_from"].fillna(-np.inf)
    before = np.where(first, -np.inf, start.groupby(slot).cummax().shift())
    late = start.to_numpy() < before
    opens = np.flatnonzero(~late)
    next_opens = slot[opens[1:]] == slot[opens[:-1]]
    closed, ends = opens[:-1][next_opens], rows["valid_from"].to_numpy()[opens[1:][next_opens]]
    born = opens[order[opens] >= len(held)]
    names = [*SLOT, "id", "valid_from"]
    own = [rows.loc[late, names].assign(valid_until=before[late]), rows.loc[born, names].assign(valid_until=np.nan), rows.loc[closed, names].assign(valid_until=ends)]
    return pd.concat(own, ignore_index=True), rows.loc[opens[np.concatenate((~next_opens, [True]))], names]


def fact_changes(facts: DataFrame, groups: int = GROUPS) -> DataFrame:
    """A stream of facts in order of arrival as changes of intervals: each new fact, and the one that it closes with its end.

    The state of a slot is the open fact's id and start, whatever the number of facts; late facts of an earlier date
    are born closed, so no watermark drops them. Within a trigger the order of arrival is ``seq``, then ``id``, over all
    of a slot's rows, in however many Arrow batches they come; between triggers it is that of the triggers: a row that
    comes in a later one has arrived later, whatever its ``seq``.

    Slots are dealt by hash into ``groups``, a number that a stream keeps for life. A group's slots are folded together as
    columns, and their open facts are one row of state, which a trigger with arrivals for any of them writes anew. A task
    holds one group at a time: its open facts, and its rows of the trigger.
    """
    import pandas as pd
    import pyarrow as pa

    ship(facts.sparkSession)
    names = [*SLOT, "id", "valid_from"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else pd.DataFrame(columns=names).astype({"id": "int64", "valid_from": "float64"})
        changes, held = _changed(held, pd.concat([p[[*names, "seq"]] for p in parts], ignore_index=True))
        table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        yield changes

    from pyspark.sql.streaming.state import GroupStateTimeout

    # ids of entities as strings: a column of numbers with nulls would come as floats
    slots = facts.select(F.col("entity_id").cast("string").alias("entity_id"), "fact_type", F.coalesce("believed_by", F.lit("")).alias("believed_by"), "id", "valid_from", "seq")
    dealt = slots.withColumn("group", F.pmod(F.xxhash64(*SLOT), F.lit(groups))).groupBy("group")
    return dealt.applyInPandasWithState(lambda k, p, s: step(k, p, s), CHANGES, STATE, "append", GroupStateTimeout.NoTimeout).withColumn("entity_id", F.col("entity_id").cast("bigint"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table below ``folder`` (which the cluster shares), and reads the table."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def settled(changes: DataFrame) -> DataFrame:
    """The intervals that a stream of changes comes to: a fact's end is the one it was told of, if any."""
    slot = ("entity_id", "fact_type", "believed_by", "id")
    return changes.groupBy(*slot).agg(F.max("valid_from").alias("valid_from"), F.max(F.when(~F.isnan("valid_until"), F.col("valid_until"))).alias("valid_until")).withColumn("believed_by", F.nullif("believed_by", F.lit("")))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows; rows later than the watermark are left out. Works on streams and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's events without a pause of ``gap`` as one session."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
