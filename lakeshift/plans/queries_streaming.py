"""Registered streaming query: the events change log dropped as files and drained by a
Structured Streaming ``foreachBatch`` upsert; the result must equal the batch load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import derived as d
from ..streaming.run_state import read_run_state, stream_run_state, with_stale
from ..streaming.stream import current_table, stream_upsert, write_log_files
from . import loader

LOG_FILES = 4


def q_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stream_upsert")
    log_dir = f"{root}/log"
    par = spark.sparkContext.defaultParallelism
    write_log_files(d.events_log(spark, sf_dir), log_dir, LOG_FILES * par)
    spec = loader.events_spec("json")
    # newer-offset-wins merge: batch boundaries and file order do not affect the result
    query = stream_upsert(spark, log_dir, spec, f"{root}/tables", loader.EVENTS_SINK_DDL, f"{root}/_checkpoint", max_files_per_trigger=par)
    query.awaitTermination()
    return current_table(spark, f"{root}/tables", spec, loader.EVENTS_SINK_DDL)


def write_time_sliced(df: DataFrame, path: str, time_col: str, slices: int, files_per_slice: int | None = None, late: bool = False) -> None:
    """Drop ``df`` in ``slices`` event-time slices, one write per slice (so file modification order follows event time,
    or runs against it with ``late``).  Rows without a time come with the last slice written."""
    spark = df.sparkSession
    files = files_per_slice or spark.sparkContext.defaultParallelism
    bounds = df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    lo, step = bounds["lo"], (bounds["hi"] - bounds["lo"]) / slices
    order = list(range(slices))[:: -1 if late else 1]
    for i in order:
        part = (F.lit(True) if i == 0 else F.col(time_col) >= F.lit(lo + step * i)) & (F.lit(True) if i == slices - 1 else F.col(time_col) < F.lit(lo + step * (i + 1)))
        part = F.coalesce(part, F.lit(i == order[-1])) if slices > 1 else F.lit(True)
        df.filter(part).repartition(files).write.mode("append").parquet(path)


def q_stream_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events as a stream whose files arrive newest first -> run-state table -> stale runs."""
    root = scratch_path(spark, "stream_run_state")
    write_time_sliced(d.run_events(spark, sf_dir), f"{root}/events", "event_time", LOG_FILES, late=True)
    ddl = spark.read.parquet(f"{root}/events").schema
    q = stream_run_state(spark, f"{root}/events", ddl, f"{root}/tables", f"{root}/_checkpoint", max_files_per_trigger=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return with_stale(read_run_state(spark, f"{root}/tables")).select("run_id", "state", "started_at", "ended_at", "last_event_at", "stale")


def q_load_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the log by a batch load, then the rest by a stream, into one table: whatever is newer stays."""
    root = scratch_path(spark, "load_then_stream")
    spec = loader.events_spec("json")
    log = d.events_log(spark, sf_dir)
    first = F.col("offset") % 3 != 0  # interleaved: both parts hold newer and older images of the same keys
    loader.load_table(spark, spec, log.filter(first), f"{root}/tables", loader.EVENTS_SINK_DDL)
    write_log_files(log.filter(~first), f"{root}/log", LOG_FILES)
    stream_upsert(spark, f"{root}/log", spec, f"{root}/tables", loader.EVENTS_SINK_DDL, f"{root}/_checkpoint", max_files_per_trigger=2).awaitTermination()
    return current_table(spark, f"{root}/tables", spec, loader.EVENTS_SINK_DDL)


QUERIES = {"stream_upsert": q_stream_upsert, "load_then_stream": q_load_then_stream, "stream_run_state": q_stream_run_state}
