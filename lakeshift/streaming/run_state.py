"""Streaming run state, without state in Python.

Every micro-batch is reduced to one row per run by a plain aggregate (map-side first, so a run that holds
a third of all events costs one row per partition) and added to a versioned table, whose rows are combined in any order
when it is read or compacted: first START = min, last terminal event = max, current state = newest event.  No watermark drops a late
event: in whatever order events arrive, the table equals the batch ``run_state`` of what has arrived.

A run is *stale* when it is still open and its last event is older than ``stale_after`` before the newest event of the
table; that depends on all runs, so it is derived when the table is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from .stream import load_of, stream_identity

TABLE_DDL = "run_id string, state string, started_at timestamp_ntz, ended_at timestamp_ntz, last_event_at timestamp_ntz, last_seq bigint"
TERMINAL = ("COMPLETE", "FAIL")
OPEN = ("START", "RUNNING")


def reduce_events(events: DataFrame) -> DataFrame:
    """Batch of run events -> one row per run, in the columns of the table."""
    newest = F.struct(F.col("event_time").cast("timestamp_ntz"), "seq")
    at = F.col("event_time").cast("timestamp_ntz")
    return events.groupBy("run_id").agg(
        F.max_by("event_type", newest).alias("state"),
        F.min(F.when(F.col("event_type") == "START", at)).alias("started_at"),
        F.max(F.when(F.col("event_type").isin(*TERMINAL), at)).alias("ended_at"),
        F.max(at).alias("last_event_at"),
        F.max_by("seq", newest).alias("last_seq"),
    )


def combine_run_state(both: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Order-independent combine of run-state rows."""
    newest = F.struct("last_event_at", "last_seq")
    return both.groupBy(*keys).agg(
        F.max_by("state", newest).alias("state"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.max("last_event_at").alias("last_event_at"),
        F.max_by("last_seq", newest).alias("last_seq"),
    )


def with_stale(table: DataFrame, stale_after: str = "1 day") -> DataFrame:
    """The table with its ``stale`` flag; the newest event of the table is the clock (one row, joined to all)."""
    now = table.select(F.lit(1).alias("_one"), "last_event_at").groupBy("_one").agg(F.max("last_event_at").alias("_now"))
    rows = table.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one", "left")
    stale = F.col("state").isin(*OPEN) & (F.col("last_event_at") < F.col("_now") - F.expr(f"INTERVAL {stale_after}"))
    return rows.withColumn("stale", F.coalesce(stale, F.lit(False))).drop("_one", "_now")


def sink_batch(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, table: str, run_id: str, stream: str) -> None:
    load = load_of(stream, batch_id)
    if upsert.committed(spark, root, table, load):
        return
    staged = upsert.materialised(reduce_events(batch))
    markers = [("stream", "checkpoint", stream), ("stream", "batch_id", str(batch_id))]
    upsert.merge_into_table(
        spark, root, table, TABLE_DDL, staged, ["run_id"], resolve=combine_run_state, operation="stream-merge", app_id=run_id, batch_id=batch_id, load_id=load, run_id=run_id, markers=markers
    )


def read_run_state(spark: SparkSession, root: str, table: str = "lineage.run_state") -> DataFrame:
    return upsert.read_current(spark, root, table, TABLE_DDL, resolve=combine_run_state)


def stream_run_state(
    spark: SparkSession,
    events_dir: str,
    events_ddl,
    root: str,
    checkpoint: str,
    table: str = "lineage.run_state",
    max_files_per_trigger: int = 1,
    run_id: str = "run-state",
):
    """Start the streaming run-state job over a folder of run-event files (drains and stops)."""
    stream = spark.readStream.schema(events_ddl).option("maxFilesPerTrigger", max_files_per_trigger).parquet(events_dir)
    return (
        stream.select("run_id", "seq", "event_type", "event_time")
        .writeStream.foreachBatch(lambda df, bid: sink_batch(spark, df, bid, root, table, run_id, stream_identity(spark, checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
