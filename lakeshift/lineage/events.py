"""Run events -> runs, run state, parent/child links, attempts and the run of record.

``run_events``: ``event_time, seq, event_type (START|RUNNING|COMPLETE|FAIL), run_id,
parent_run_id, job_ns, job_name, inputs ARRAY<STRUCT<ns,name>>, outputs ..., facets
MAP<STRING,STRING>, instance_id, stack_epoch``.  All per-run results are aggregates with
map-side combine, so a run with a third of all events is pre-reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("COMPLETE", "FAIL")
# Run-type precedence for the run of record (scheduled wins over manual
# re-runs, which win over backfills).
RUN_TYPE_RANK = {"scheduled": 0, "manual": 1, "backfill": 2}


_DATASETS = "array<struct<namespace:string,name:string>>"
#: Fixed format: the run-event document, as far as it is read.
EVENT_JSON_DDL = (
    "eventTime timestamp_ntz, eventType string, run struct<runId:string,facets:struct<parent:struct<run:struct<runId:string>>>>, "
    f"job struct<namespace:string,name:string>, inputs {_DATASETS}, outputs {_DATASETS}"
)


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Run-event documents (one JSON text per row) -> the typed event columns.  Malformed text gives a row of NULLs."""
    e = lines.select(F.from_json(F.col(column), EVENT_JSON_DDL, {"mode": "PERMISSIVE"}).alias("e"))
    io = lambda c: F.transform(F.col(f"e.{c}"), lambda x: F.struct(x["namespace"].alias("ns"), x["name"].alias("name")))
    return e.select(
        F.col("e.eventTime").alias("event_time"), F.col("e.eventType").alias("event_type"), F.col("e.run.runId").alias("run_id"),
        F.col("e.run.facets.parent.run.runId").alias("parent_run_id"), F.col("e.job.namespace").alias("job_ns"), F.col("e.job.name").alias("job_name"),
        io("inputs").alias("inputs"), io("outputs").alias("outputs"),
    )


def event_jobs(events: DataFrame) -> DataFrame:
    """Distinct jobs of the events."""
    return events.select(F.col("job_ns").alias("namespace"), F.col("job_name").alias("name")).distinct()


def event_datasets(events: DataFrame) -> DataFrame:
    """Distinct datasets that any event reads or writes."""
    return events.select(F.explode(F.concat("inputs", "outputs")).alias("d")).select(F.col("d.ns").alias("namespace"), F.col("d.name").alias("name")).distinct()


def flatten_events(events: DataFrame) -> DataFrame:
    """One row per (event, dataset, direction): the dataset I/O edges of each event, in one pass over the log."""
    marked = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<ns:string,name:string>>")), lambda d: F.struct(F.lit(kind).alias("io_type"), d["ns"].alias("namespace"), d["name"].alias("name")))
    io = F.explode(F.concat(marked("inputs", "INPUT"), marked("outputs", "OUTPUT"))).alias("io")
    seq = ["seq"] if "seq" in events.columns else []
    return events.select("run_id", *seq, "job_ns", "job_name", io).select("run_id", *seq, "job_ns", "job_name", "io.io_type", "io.namespace", "io.name")


def emit_events(events: DataFrame, path: str) -> None:
    """Append run events to the central store (parquet, partitioned by day)."""
    events.withColumn("event_date", F.to_date("event_time")).write.mode("append").partitionBy("event_date").parquet(path)


def runs(events: DataFrame) -> DataFrame:
    """Run attributes (constant per run) and its time span."""
    return events.groupBy("run_id").agg(
        F.max("parent_run_id").alias("parent_run_id"),
        F.max("job_ns").alias("job_ns"),
        F.max("job_name").alias("job_name"),
        F.max(F.col("facets")["run_type"]).alias("run_type"),
        F.max(F.col("facets")["app_id"]).alias("app_id"),
        F.max(F.col("facets")["logical_date"]).try_cast("date").alias("logical_date"),
        F.min("event_time").alias("started_at"),
        F.max("event_time").alias("last_event_at"),
    )


def run_state(events: DataFrame, now: str, stale_after: str = "1 day") -> DataFrame:
    """Current state per run = type of its latest event by ``(event_time, seq)``.

    ``started_at`` = first START, ``ended_at`` = last terminal event; a run whose state
    is START/RUNNING and whose last event is older than ``now - stale_after`` is stale.
    """
    agg = events.groupBy("run_id").agg(
        F.max_by("event_type", F.struct("event_time", "seq")).alias("state"),
        F.min(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("started_at"),
        F.max(F.when(F.col("event_type").isin(*TERMINAL), F.col("event_time"))).alias("ended_at"),
        F.max("event_time").alias("last_event_at"),
    )
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {stale_after}")
    return agg.withColumn("stale", F.col("state").isin("START", "RUNNING") & (F.col("last_event_at") < limit))


def parent_child_runs(run_table: DataFrame) -> DataFrame:
    """Child run -> parent run through the parentRun facet (left join: orphans kept)."""
    c = run_table.select("run_id", "job_name", "parent_run_id")
    p = run_table.select(F.col("run_id").alias("parent_run_id"), F.col("job_name").alias("parent_job_name"), F.col("job_ns").alias("parent_job_ns"))
    return c.filter(F.col("parent_run_id").isNotNull()).join(p, "parent_run_id", "left")


def latest_attempt(run_table: DataFrame) -> DataFrame:
    """Latest attempt per parent run and job (a retry re-submits the job under the same parent)."""
    return (
        run_table.filter(F.col("parent_run_id").isNotNull())
        .groupBy("parent_run_id", "job_ns", "job_name")
        .agg(
            F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run_id"),
            F.count(F.lit(1)).alias("attempts"),
        )
    )


def run_of_record(run_table: DataFrame) -> DataFrame:
    """Flag the run of record per (job, logical date): scheduled > manual > backfill, then
    the latest start.  All runs are kept; backfills never overwrite the scheduled run.

    The logical date is the one that the run carries, as a backfill starts long after the date it is for; a run without one stands
    for the day it started.
    """
    rank = F.coalesce(*[F.when(F.col("run_type") == k, F.lit(v)) for k, v in RUN_TYPE_RANK.items()], F.lit(99))
    r = run_table.withColumn("logical_date", F.coalesce("logical_date", F.to_date("started_at"))).withColumn("_rank", rank)
    chosen = r.groupBy("job_name", "logical_date").agg(
        F.max_by("run_id", F.struct(-F.col("_rank"), F.col("started_at"), F.col("run_id"))).alias("_chosen")
    )
    # one row per (job, day): few keys with many runs each.  ``chosen`` leaves a shuffle
    # stage, so adaptive execution broadcasts it at runtime when small (skew-join
    # splitting otherwise) without a separate counting pass.
    return r.join(chosen, ["job_name", "logical_date"], "inner").select(
        "run_id", "job_name", "logical_date", "run_type", (F.col("run_id") == F.col("_chosen")).alias("is_run_of_record")
    )


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """Most recent ``n`` events (a top-n: ``TakeOrderedAndProject``)."""
    return events.orderBy(F.col("event_time").desc(), F.col("seq").desc()).limit(n)
