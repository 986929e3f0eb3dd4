"""Run chains inside one deployment: source table -> connector run -> topic -> run -> sink snapshot.

A run belongs to the connector run that produced what it consumed: its offset range lies within the connector run's, in the
same topic partition of the same deployment ``(instance_id, stack_epoch)``.

The containment join is an equi-join.  A produced range of length ``n`` is kept at the level ``floor(log2(n)) + 1``, whose cells are
longer than it, so it touches at most two of them.  A consumed range looks up the cell of its start at every level
that occurs.  Whatever the lengths, a produced range makes two rows at most and a consumed one as many as there are levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPLOYMENT = ("instance_id", "stack_epoch")


def contained_in(inner: DataFrame, outer: DataFrame, on: list[str], carry: list[str]) -> DataFrame:
    """Rows of ``inner`` with ``carry`` of every row of ``outer`` whose ``[start_offset, end_offset)`` contains theirs; both agree ``on``.

    Empty ranges contain nothing and lie in nothing.
    """
    full = "start_offset < end_offset"
    level = F.floor(F.log2((F.col("end_offset") - F.col("start_offset")).cast("double"))).cast("int") + 1
    o = outer.filter(full).withColumn("_level", level)
    cells = F.expr("explode(sequence(shiftright(start_offset, _level), shiftright(end_offset - 1, _level)))").alias("_cell")
    o = o.select(*on, *carry, F.col("start_offset").alias("_from"), F.col("end_offset").alias("_to"), "_level", cells)
    levels = o.select(*on, "_level").distinct()  # at most 63 for each group
    i = inner.filter(full).join(levels, on).withColumn("_cell", F.expr("shiftright(start_offset, _level)"))
    met = i.join(o, [*on, "_level", "_cell"])
    return met.filter((F.col("_from") <= F.col("start_offset")) & (F.col("end_offset") <= F.col("_to"))).drop("_level", "_cell", "_from", "_to")


def run_chains(consumed: DataFrame, produced: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per consumed range: its connector run and snapshot in its own deployment, and whether the chain is whole.

    ``consumed``: ``run_id, topic, partition, start_offset, end_offset`` and the deployment; ``produced``: the same of
    ``connector_run_id`` with its ``source``; ``snapshots``: ``run_id, snapshot_id`` and the deployment.  Of several
    connector runs that contain a range the least id is named.
    """
    on = [*DEPLOYMENT, "topic", "partition"]
    key = ["run_id", *on, "start_offset", "end_offset"]
    within = contained_in(consumed.select(*key).distinct(), produced, on, ["connector_run_id", "source"])
    first = within.groupBy(*key).agg(F.min(F.struct("connector_run_id", "source")).alias("_c"))
    last = snapshots.groupBy("run_id", *DEPLOYMENT).agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = consumed.select(*key).distinct().join(first, key, "left").join(last, ["run_id", *DEPLOYMENT], "left")
    whole = F.col("_c").isNotNull() & F.col("snapshot_id").isNotNull()
    return rows.select(*key, F.col("_c.connector_run_id").alias("connector_run_id"), F.col("_c.source").alias("source"), "snapshot_id", whole.alias("whole"))


def complete_runs(chains: DataFrame, markers: DataFrame, required: list[str]) -> DataFrame:
    """``run_id, instance_id, stack_epoch``: deployments in which all consumed ranges of a run are in whole chains, of runs with every required marker.

    A run that is seen in two deployments is complete in the one that holds its whole chain, if any does.
    """
    have = markers.filter(F.col("marker_kind").isin(*required)).groupBy("run_id").agg(F.count_distinct("marker_kind").alias("_kinds"))
    every = chains.groupBy("run_id", *DEPLOYMENT).agg(F.bool_and("whole").alias("_whole")).filter("_whole")
    return every.join(have.filter(F.col("_kinds") == len(required)), "run_id").select("run_id", *DEPLOYMENT)
