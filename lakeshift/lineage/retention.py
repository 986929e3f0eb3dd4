"""Retention per consumed offset range: can a snapshot still be built again from its topic, and how far did it lag behind.

The oldest message of a range is looked up in a sparse index, not among the messages.  The index holds the oldest time of every
``STEP`` offsets and, level by level, of every two cells below; a range is made of at most two cells a level.  Only the
messages of the two cells in which a range begins and ends are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 64


def time_index(messages: DataFrame, step: int = STEP) -> DataFrame:
    """``topic, partition, level, cell, oldest``: the oldest ``ts`` of every cell of ``step * 2**level`` offsets that holds a message.

    A level ends where it has one cell, so the index has about two rows for every ``step`` offsets and one per level above.
    """
    cell = F.floor(F.col("offset") / F.lit(step)).cast("long")
    base = messages.groupBy("topic", "partition", cell.alias("cell")).agg(F.min("ts").alias("oldest"))
    top = base.groupBy("topic", "partition").agg(F.floor(F.log2(F.max("cell").cast("double") + 1)).cast("int").alias("_top"))
    levels = base.join(top, ["topic", "partition"]).withColumn("level", F.explode(F.expr("sequence(0, _top)")))
    return levels.groupBy("topic", "partition", "level", F.expr("shiftright(cell, level)").alias("cell")).agg(F.min("oldest").alias("oldest"))


def oldest_consumed(ranges: DataFrame, messages: DataFrame, step: int = STEP) -> DataFrame:
    """``range_id, oldest``: time of the oldest message with ``start_offset <= offset < end_offset``; ranges without messages are left out.

    ``ranges``: ``range_id, topic, partition, start_offset, end_offset``; ``messages``: ``topic, partition, offset, ts``, offsets from 0 on.
    """
    on = ["topic", "partition"]
    ends = messages.groupBy(*on).agg((F.max("offset") + 1).alias("_end"))  # a row per topic partition; what lies beyond it holds nothing
    within = ranges.join(ends, on).withColumn("end_offset", F.least("end_offset", "_end"))
    full = within.filter("start_offset < end_offset").selectExpr(
        "range_id", "topic", "partition", "start_offset", "end_offset",
        f"CAST(ceil(start_offset / {step}D) AS BIGINT) AS a", f"CAST(floor(end_offset / {step}D) AS BIGINT) AS b",
    )
    # whole cells [a, b): at each level an odd first cell and the cell before an odd end
    inner = full.filter("a < b").withColumn("level", F.expr("explode(sequence(0, CAST(floor(log2(CAST(b - a AS DOUBLE))) AS INT) + 1))"))
    inner = inner.selectExpr("*", "shiftright(a + shiftleft(1L, level) - 1, level) AS lo", "shiftright(b, level) AS hi").filter("lo < hi")
    cells = F.expr("explode(filter(array(IF(lo % 2 = 1, lo, NULL), IF(hi % 2 = 1, hi - 1, NULL)), x -> x IS NOT NULL))")
    whole = inner.select("range_id", *on, "level", cells.alias("cell")).join(time_index(messages, step), [*on, "level", "cell"]).select("range_id", "oldest")
    # the cells at both ends, message by message
    edge = F.expr(f"explode(array_distinct(array(CAST(floor(start_offset / {step}D) AS BIGINT), CAST(floor((end_offset - 1) / {step}D) AS BIGINT))))")
    edges = full.select("range_id", *on, "start_offset", "end_offset", edge.alias("cell"))
    at = messages.select(*on, "offset", "ts", F.floor(F.col("offset") / F.lit(step)).cast("long").alias("cell"))
    near = edges.join(at, [*on, "cell"]).filter("offset >= start_offset AND offset < end_offset").select("range_id", F.col("ts").alias("oldest"))
    return whole.unionByName(near).groupBy("range_id").agg(F.min("oldest").alias("oldest"))


def retention_by_offsets(snapshots: DataFrame, ranges: DataFrame, messages: DataFrame, now: str, topic_hours: int = 168, snapshot_hours: int = 168) -> DataFrame:
    """One row per snapshot: the oldest message that it was built from, its lag, and whether it is live and can be built again.

    ``snapshots``: ``table, snapshot_id, committed_at``; ``ranges`` carry ``range_id = snapshot_id``.  The lag is the time from that message to the
    commit; ``worst_lag_seconds`` is the greatest of the table.  A live snapshot whose oldest message has left the topic breaks the
    rule; ``safe`` says that the topic is kept for the snapshots' time and the table's worst lag together, so that none ever can.
    A snapshot of no messages has no lag, needs none and breaks nothing.
    """
    now_c = F.lit(now).cast("timestamp_ntz")
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    found = snapshots.join(oldest_consumed(ranges, messages).withColumnRenamed("range_id", "snapshot_id"), "snapshot_id", "left")
    lag = F.expr("timestampdiff(SECOND, oldest, committed_at)")
    worst = found.groupBy("table").agg(F.max(lag).alias("worst_lag_seconds"))
    live = F.col("committed_at") >= now_c - hours(snapshot_hours)
    kept = F.coalesce(F.col("oldest") >= now_c - hours(topic_hours), F.lit(True))
    safe = F.coalesce(F.col("worst_lag_seconds"), F.lit(0)) + F.lit(snapshot_hours * 3600) <= F.lit(topic_hours * 3600)
    return found.join(worst, "table").select("table", "snapshot_id", "oldest", lag.alias("lag_seconds"), "worst_lag_seconds", live.alias("live"), kept.alias("replayable"), (live & ~kept).alias("violation"), safe.alias("safe"))
