"""The lineage store folded from run events: datasets, jobs, job versions and their inputs and outputs.

A run's inputs and outputs are the datasets that any of its events names.  A job version is a job with such a set: its uuid is a hash of
the job and of the set, whatever the order in which the datasets were named.  The set is never collected: every distinct
(run, direction, dataset) adds its hash to two sums and a count.  A job's current version is that of its last completed run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import flatten_events


def content_uuid(*parts: Column | str) -> Column:
    """A uuid that follows from the content alone."""
    return F.md5(F.concat_ws("\x1f", *parts))


def _hash_halves(digest: Column) -> list[Column]:
    """Two 60-bit numbers of a hexadecimal digest, wide enough to be added up."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]


def run_versions(events: DataFrame) -> DataFrame:
    """``run_id, job_uuid, job_ns, job_name, job_version_uuid, completed_at`` per run; ``completed_at`` of its last COMPLETE, or NULL."""
    runs = events.groupBy("run_id").agg(
        F.max("job_ns").alias("job_ns"), F.max("job_name").alias("job_name"), F.max(F.when(F.col("event_type") == "COMPLETE", F.col("event_time"))).alias("completed_at")
    )
    io = flatten_events(events).select("run_id", content_uuid("io_type", "namespace", "name").alias("h")).distinct()
    one, two = _hash_halves(F.col("h"))
    sets = io.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("s1"), F.sum(two).alias("s2"))
    job = content_uuid("job_ns", "job_name")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    version = content_uuid(job, number("n"), number("s1"), number("s2"))
    return runs.join(sets, "run_id", "left").select("run_id", job.alias("job_uuid"), "job_ns", "job_name", version.alias("job_version_uuid"), "completed_at")


def store_from_events(events: DataFrame) -> dict[str, DataFrame]:
    """``datasets, jobs, job_versions, io_mapping`` of run events (``run_id, event_type, event_time, job_ns, job_name, inputs, outputs``).

    Events without a run are ignored.  A job none of whose runs completed has versions, but no current one.
    """
    events = events.filter("run_id IS NOT NULL")
    edges = flatten_events(events)
    versions = run_versions(events)
    datasets = edges.select("namespace", "name").distinct().select(content_uuid("namespace", "name").alias("uuid"), F.col("namespace").alias("namespace_name"), "name")
    jobs = versions.select(F.col("job_uuid").alias("uuid"), F.col("job_ns").alias("namespace_name"), F.col("job_name").alias("name")).distinct()
    job_versions = versions.select(F.col("job_version_uuid").alias("uuid"), "job_uuid").distinct()
    done = versions.filter("completed_at IS NOT NULL").groupBy("job_uuid").agg(F.max_by("job_version_uuid", F.struct("completed_at", "run_id")).alias("job_version_uuid"))
    current = done.select("job_version_uuid", F.lit(True).alias("_current"))
    # the set of a version is that of any of its runs: the least one
    of = versions.groupBy("job_version_uuid").agg(F.min("run_id").alias("run_id"))
    io = edges.join(of, "run_id").select("job_version_uuid", content_uuid("namespace", "name").alias("dataset_uuid"), "io_type").distinct()
    io = io.join(current, "job_version_uuid", "left").select("job_version_uuid", "dataset_uuid", "io_type", F.coalesce("_current", F.lit(False)).alias("is_current_job_version"))
    return {"datasets": datasets, "jobs": jobs, "job_versions": job_versions, "io_mapping": io}
