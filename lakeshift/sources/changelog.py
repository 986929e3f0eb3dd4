"""Change-log scans and change capture.

A change log has the Kafka source layout ``key BINARY, value BINARY, topic STRING,
partition INT, offset BIGINT``.  It is read from a broker when the Kafka connector is on
the classpath, otherwise from parquet files with the same columns.  Capture from table
versions (snapshot / diff) produces the same layout, so every downstream operator is
agnostic of where the log came from.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_COLUMNS = ["key", "value", "topic", "partition", "offset"]
LOG_DDL = "key binary, value binary, topic string, partition int, offset bigint"

# Merged offset ranges up to this number become a predicate that reaches the scan; more are a semi-join of the same meaning.
MAX_PREDICATE_RANGES = 2048


def read_changelog(
    spark: SparkSession,
    source: str,
    *,
    fmt: str = "parquet",
    topics: Sequence[str] | None = None,
    offsets: DataFrame | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Bounded scan of a change log.

    ``fmt="kafka"`` reads a broker (``source`` = bootstrap servers); ``fmt="parquet"`` reads a drop folder.
    ``topics`` is the include list; ``offsets`` (``topic, partition, start_offset, end_offset``) restricts the
    scan to offset windows per partition (incremental read instead of a full re-read); of a broker, only these
    offsets are fetched.
    """
    if fmt == "kafka":
        opts = {"kafka.bootstrap.servers": source, **kafka_offsets(offsets)}
        if topics:
            opts["subscribe"] = ",".join(topics)
        opts.update(options or {})
        log = spark.read.format("kafka").options(**opts).load().select(*LOG_COLUMNS)
    else:
        log = spark.read.options(**(options or {})).parquet(source).select(*LOG_COLUMNS)
    if topics:
        log = log.filter(F.col("topic").isin(list(topics)))
    if offsets is not None:
        log = restrict_offsets(log, offsets)
    return log


def kafka_offsets(ranges: DataFrame | None) -> dict[str, str]:
    """``startingOffsets`` / ``endingOffsets`` options that span the ranges of each topic partition (one row each).

    An open end is the latest offset (-1); partitions without a range are not named, so subscribe to the topics that have them.
    """
    if ranges is None:
        return {"startingOffsets": "earliest", "endingOffsets": "latest"}
    spans = ranges.groupBy("topic", "partition").agg(
        F.min("start_offset").alias("a"), F.max(F.coalesce("end_offset", F.lit(2**62))).alias("b")
    )
    start: dict[str, dict[str, int]] = {}
    end: dict[str, dict[str, int]] = {}
    for r in spans.collect():
        start.setdefault(r["topic"], {})[str(r["partition"])] = r["a"]
        end.setdefault(r["topic"], {})[str(r["partition"])] = -1 if r["b"] == 2**62 else r["b"]
    return {"startingOffsets": json.dumps(start), "endingOffsets": json.dumps(end)}


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping or touching ``[start_offset, end_offset)`` of a topic partition as one; a NULL end is open."""
    far = F.lit(2**63 - 1)
    r = ranges.select("topic", "partition", "start_offset", F.coalesce("end_offset", far).alias("_end")).filter("start_offset < _end")
    w = Window.partitionBy("topic", "partition").orderBy("start_offset", "_end")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start_offset") > reach), 1).otherwise(0)
    r = r.withColumn("_begins", begins).withColumn("_g", F.sum("_begins").over(w))
    r = r.groupBy("topic", "partition", "_g").agg(F.min("start_offset").alias("start_offset"), F.max("_end").alias("_end"))
    return r.select("topic", "partition", "start_offset", F.when(F.col("_end") != far, F.col("_end")).alias("end_offset"))


RANGE_DDL = "topic string, partition int, start_offset bigint, end_offset bigint"


def _segments(ranges: DataFrame) -> DataFrame:
    """``topic, partition, start_offset, end_offset, depth`` between all ends of the ranges: the sum of the ``w`` of those that
    cover each.  A range is ``[start_offset, end_offset)``, a NULL end open.  Only ends are sorted, per topic partition."""
    far = F.lit(2**63 - 1)
    r = ranges.withColumn("_end", F.coalesce("end_offset", far)).filter("start_offset < _end")
    end = lambda at, step: F.struct(F.col(at).alias("at"), step.alias("step"))
    ends = r.select("topic", "partition", F.inline(F.array(end("start_offset", F.col("w")), end("_end", -F.col("w")))))
    steps = ends.groupBy("topic", "partition", "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("topic", "partition").orderBy("at")
    cut = steps.select("topic", "partition", F.col("at").alias("start_offset"), F.lead("at").over(w).alias("_end"), F.sum("step").over(w).alias("depth"))
    return cut.filter("_end IS NOT NULL").select("topic", "partition", "start_offset", F.when(F.col("_end") != far, F.col("_end")).alias("end_offset"), "depth")


def subtract_ranges(ranges: DataFrame, minus: DataFrame) -> DataFrame:
    """What ``ranges`` cover and ``minus`` do not, as disjoint ranges that do not touch."""
    cols = ["topic", "partition", "start_offset", "end_offset"]
    wide = 1 << 40  # one range to subtract outweighs all others
    both = ranges.select(*cols, F.lit(1).cast("bigint").alias("w")).unionByName(minus.select(*cols, F.lit(wide).alias("w")))
    return merged_ranges(_segments(both).filter((F.col("depth") > 0) & (F.col("depth") < wide)))


def resume_ranges(consumed: DataFrame) -> DataFrame:
    """What is still to be read of the topic partitions in ``consumed``: from offset 0 on, open at the end."""
    every = consumed.select("topic", "partition").distinct()
    return subtract_ranges(every.select("topic", "partition", F.lit(0).cast("bigint").alias("start_offset"), F.lit(None).cast("bigint").alias("end_offset")), consumed)


def offset_gaps(consumed: DataFrame) -> DataFrame:
    """``topic, partition, kind, start_offset, end_offset``: what lies between consumed ranges unread (gap) or was read more than once (overlap)."""
    depth = _segments(consumed.withColumn("w", F.lit(1)))
    gaps = merged_ranges(depth.filter("depth = 0")).withColumn("kind", F.lit("gap"))
    twice = merged_ranges(depth.filter("depth > 1")).withColumn("kind", F.lit("overlap"))
    return gaps.unionByName(twice).select("topic", "partition", "kind", "start_offset", "end_offset")


def _inside(few: list) -> Column:
    cond = F.lit(False)
    for topic, part, start, end in (tuple(r) for r in few):
        c = (F.col("topic") == topic) & (F.col("partition") == part) & (F.col("offset") >= start)
        cond = cond | (c & (F.col("offset") < end) if end is not None else c)
    return cond


def _by_ranges(log: DataFrame, ranges: DataFrame, keep: bool) -> DataFrame:
    merged = merged_ranges(ranges)
    few = merged.limit(MAX_PREDICATE_RANGES + 1).collect()
    if len(few) <= MAX_PREDICATE_RANGES:
        return log.filter(_inside(few) if keep else ~F.coalesce(_inside(few), F.lit(False)))
    r = merged.select(F.col("topic").alias("_t"), F.col("partition").alias("_p"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"))
    inside = (F.col("offset") >= F.col("_a")) & (F.col("_b").isNull() | (F.col("offset") < F.col("_b")))
    return log.join(r, (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p")) & inside, "left_semi" if keep else "left_anti")


def restrict_offsets(log: DataFrame, ranges: DataFrame | list) -> DataFrame:
    """Rows with ``start_offset <= offset < end_offset`` for some range of their (topic, partition), once each, all columns.

    Ranges may overlap; they are merged first.  Few become a predicate on ``offset`` that reaches the parquet scan
    (row-group skipping on min/max), more a semi-join; both keep the same rows.  A NULL ``end_offset`` means "to the end".
    ``ranges`` may also be collected rows (``topic, partition, start_offset, end_offset``); few of these need no job.
    """
    if isinstance(ranges, list):
        if len(ranges) <= MAX_PREDICATE_RANGES:
            return log.filter(_inside(ranges))
        ranges = log.sparkSession.createDataFrame([tuple(r) for r in ranges], RANGE_DDL)
    return _by_ranges(log, ranges, True)


def exclude_offsets(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows in none of the ranges, those of topic partitions without any range included; few ranges are a predicate of the scan."""
    return _by_ranges(log, ranges, False)


def offset_ranges(log: DataFrame) -> DataFrame:
    """Consumed offset range per topic partition: ``[start_offset, end_offset)`` and count."""
    return log.groupBy("topic", "partition").agg(
        F.min("offset").alias("start_offset"),
        (F.max("offset") + 1).alias("end_offset"),
        F.count(F.lit(1)).alias("messages"),
    )


def changelog_counts(flat: DataFrame) -> DataFrame:
    """Messages per topic and envelope op (NULL op = tombstone / undecodable)."""
    return flat.groupBy("topic", "op").agg(F.count(F.lit(1)).alias("messages"))


def key_multiplicity(changes: DataFrame, key: str | Column, min_count: int = 2) -> DataFrame:
    """Keys seen at least ``min_count`` times in the log (why latest-by-key exists)."""
    k = F.col(key) if isinstance(key, str) else key
    return (
        changes.groupBy(k.alias("pk"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .filter(F.col("messages") >= min_count)
    )


def sample_changelog(log: DataFrame, n: int) -> DataFrame:
    """First ``n`` messages from the beginning (console-consumer style): a top-n sort."""
    return log.orderBy("partition", "offset").limit(n)


def _is_integer(df: DataFrame, keys: Sequence[str]) -> bool:
    return len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("byte", "short", "integer", "long")


def key_partition(keys: Sequence[Column], num_partitions: int, integer: bool) -> Column:
    """Partition number for a key: arithmetic for one integer, a hash for any other key.

    Same key -> same partition, so per-key order is the per-partition offset order.
    """
    return F.pmod(keys[0] if integer else F.xxhash64(*keys), F.lit(num_partitions)).cast("int")


#: Slices of the hash range over which the keys of a capture are ranked.
RANK_SLICES = 4096


def _place(changes: DataFrame, keys: Sequence[str], num_partitions: int, log: DataFrame | None, topic: str) -> DataFrame:
    """Add ``partition`` and ``offset`` to change rows ``_seq`` (0 or 1) of each key.

    Offsets go on where ``log`` ends in each partition of the topic, so every capture is newer than what is there.
    Within a capture a key has two neighbouring offsets.  One integer key: its number folded to 0, 1, 2, ... (0, -1, 1,
    -2, ...) is the rank, without a sort.  Any other key: rows are ranked by hash in slices (a count per slice, a running
    sum over the slices, a row number inside), so no task holds a partition.
    """
    integer = _is_integer(changes, keys)
    cols = [F.col(k) for k in keys]
    out = changes.withColumn("partition", key_partition(cols, num_partitions, integer))
    if integer:
        k = cols[0].cast("bigint")
        folded = F.when(k >= 0, k * 2).otherwise(-(k * 2) - 1)
        name = "_folded"
        out = out.withColumn(name, folded).withColumn("_rank", F.expr(f"{name} div {num_partitions}")).drop(name)
    else:
        h = F.xxhash64(*cols)
        out = out.withColumn("_h", h).withColumn("_slice", F.pmod(F.shiftright(h, 40), F.lit(RANK_SLICES)).cast("int"))
        counts = out.groupBy("partition", "_slice").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("partition").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("partition", "_slice", before.alias("_before"))
        inside = Window.partitionBy("partition", "_slice").orderBy("_h", *cols, "_seq")
        out = out.join(counts, ["partition", "_slice"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_slice", "_before")
    offset = F.col("_rank") * 2 + F.col("_seq")
    if log is not None:
        ends = log.filter(F.col("topic") == topic).groupBy("partition").agg((F.max("offset") + 1).alias("_base"))  # one row per partition
        out = out.join(ends, "partition", "left")
        offset = offset + F.coalesce("_base", F.lit(0))
    return out.withColumn("offset", offset.cast("bigint"))


def _log_row(placed: DataFrame, keys: Sequence[str], topic: str) -> DataFrame:
    return placed.select(
        F.to_json(F.struct(*[F.col(k) for k in keys])).cast("binary").alias("key"),
        F.col("_value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
    )


def snapshot_to_changes(df: DataFrame, pk: str | Sequence[str], topic: str, num_partitions: int, source: dict[str, str] | None = None, log: DataFrame | None = None) -> DataFrame:
    """Initial snapshot of a table as read events (``op='r'``), placed after the end of ``log`` if given."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    src = F.struct(*[F.lit(v).alias(k) for k, v in (source or {}).items()], F.lit("true").alias("snapshot"))
    value = F.to_json(F.struct(F.struct(*df.columns).alias("after"), F.lit("r").alias("op"), src.alias("source")))
    rows = df.select(*keys, value.alias("_value"), F.lit(0).alias("_seq"))
    return _log_row(_place(rows, keys, num_partitions, log, topic), keys, topic)


def table_diff_to_changes(old: DataFrame, new: DataFrame, pk: str | Sequence[str], topic: str, num_partitions: int, tombstones: bool = True, log: DataFrame | None = None) -> DataFrame:
    """Compare two versions of a table and emit change envelopes, placed after the end of ``log`` if given.

    ``c`` for new keys, ``u`` for keys whose row differs (NULL-safe), ``d`` for removed keys, followed by a tombstone (NULL
    value) when ``tombstones``.  Unchanged keys emit nothing.  One full-outer join on the primary key; keys are unique
    on both sides so the join has no hot key.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    cols = new.columns
    o = old.select(*keys, F.struct(*cols).alias("_before"))
    n = new.select(*keys, F.struct(*cols).alias("_after"))
    j = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_before.{c}").eqNullSafe(F.col(f"_after.{c}"))
    op = F.when(F.col("_before").isNull(), F.lit("c")).when(F.col("_after").isNull(), F.lit("d")).when(~same, F.lit("u"))
    j = j.withColumn("_op", op).filter(F.col("_op").isNotNull())
    envelope = F.to_json(F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"), F.col("_op").alias("op")))
    messages = [F.struct(envelope.alias("value"), F.lit(0).alias("seq"))]
    if tombstones:
        messages.append(F.when(F.col("_op") == "d", F.struct(F.lit(None).cast("string").alias("value"), F.lit(1).alias("seq"))))
    rows = j.select(*keys, F.explode(F.filter(F.array(*messages), lambda m: m.isNotNull())).alias("_m"))
    rows = rows.select(*keys, F.col("_m.value").alias("_value"), F.col("_m.seq").alias("_seq"))
    return _log_row(_place(rows, keys, num_partitions, log, topic), keys, topic)


def route_topics(changes: DataFrame, prefix: str, num_partitions: int, keys: Sequence[str]) -> DataFrame:
    """Topic per table (``{prefix}.{db}.{table}`` from the columns ``db`` and ``table``) and partition by key."""
    integer = _is_integer(changes, keys)
    topic = F.concat_ws(".", F.lit(prefix), "db", "table")
    return changes.withColumn("topic", topic).withColumn("partition", key_partition([F.col(k) for k in keys], num_partitions, integer))


def write_routed(log: DataFrame, path: str, mode: str = "append") -> None:
    """Sink: one folder per topic (``topic=...``), table-per-topic downstream."""
    log.write.mode(mode).partitionBy("topic").parquet(path)
