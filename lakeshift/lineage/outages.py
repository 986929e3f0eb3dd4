"""Outages of long-running runs: spans without a heartbeat, found from session windows.

A connector run may hold a third of all heartbeats, so they are first folded by (run, day): one row per
session inside such a slice. What lies between slices is found from one row per (run, slice), and between groups of ``SLICES`` slices from one row
per (run, group), so no task holds a run's heartbeats.  Heartbeats may arrive in any order; a late one closes its gap when the table is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices that one task looks at, at most, for one run.
SLICES = 1000


def _before(rows: DataFrame, *within: str) -> DataFrame:
    """``rows`` with ``before``, the last heartbeat of the row before it among those that agree in ``within``; NULL for the first."""
    return rows.withColumn("before", F.lag("last").over(Window.partitionBy("run_id", *within).orderBy("first")))


def run_outages(heartbeats: DataFrame, until: str, silence: str = "2 hours") -> DataFrame:
    """``run_id, silent_from, resumed_at, seconds``: spans of ``silence`` or more between a run's heartbeats (``run_id, at, ended``).

    After its last heartbeat a run is out until ``until``, with a NULL ``resumed_at``, unless that heartbeat says ``ended`` (of several at that
    time, one).  Heartbeats without a run or a time are ignored; repeated ones change nothing.
    """
    beats = heartbeats.filter("run_id IS NOT NULL AND at IS NOT NULL").select("run_id", F.col("at").cast("timestamp_ntz").alias("at"), F.coalesce("ended", F.lit(False)).alias("ended"))
    beats = beats.withColumn("slice", F.date_diff(F.to_date("at"), F.lit("1970-01-01").cast("date")))
    session = F.session_window("at", f"{silence} -1 microseconds")  # windows that touch are one
    sessions = beats.groupBy("run_id", "slice", session).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.struct("at", "ended")).alias("end"))
    sessions = _before(sessions.select("run_id", "slice", "first", "last", "end"), "slice")
    span = [F.min("first").alias("first"), F.max("last").alias("last"), F.max("end").alias("end")]
    slices = sessions.groupBy("run_id", "slice").agg(*span).withColumn("part", F.floor(F.col("slice") / SLICES))
    parts = slices.groupBy("run_id", "part").agg(*span)
    # the first session of a slice follows the slice before it, the first slice of a group the group before it
    gaps = [r.filter("before IS NOT NULL").select("run_id", F.col("before").alias("silent_from"), F.col("first").alias("resumed_at")) for r in (sessions, _before(slices, "part"), _before(parts))]
    ends = parts.groupBy("run_id").agg(F.max("end").alias("end")).filter(~F.col("end.ended"))
    gaps.append(ends.select("run_id", F.col("end.at").alias("silent_from"), F.lit(None).cast("timestamp_ntz").alias("resumed_at")))
    out = gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).unionByName(gaps[3])
    stop = F.coalesce("resumed_at", F.lit(until).cast("timestamp_ntz"))
    long = stop >= F.col("silent_from") + F.expr(f"INTERVAL {silence}")
    seconds = F.expr("timestampdiff(SECOND, silent_from, _stop)")
    return out.filter(long).withColumn("_stop", stop).select("run_id", "silent_from", "resumed_at", seconds.alias("seconds"))
