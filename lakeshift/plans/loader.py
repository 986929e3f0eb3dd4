"""The composed change-log -> table load: one declarative ``TableSpec`` per table.

scan -> decode (JSON or Avro) -> flatten -> live filter -> latest per key -> projection
-> guard -> merge by offset -> one commit of counts, consumed ranges and markers.  Everything up to the write is one lazy
plan; the only shuffles are the one by primary key (latest-per-key, partial aggregate
first) and the merge join by primary key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.decode import decode_avro, decode_avro_key, decode_json, drop_tombstones, keep_decoded, live_changes, live_condition, split_confluent
from ..operators.transform import ColumnRule, TableSpec, assert_unique_keys, latest_by_key, project
from ..operators import upsert
from ..sources.changelog import exclude_offsets, offset_ranges, restrict_offsets, subtract_ranges
from ..sources.derived import EVENTS_AFTER_DDL, EVENTS_TOPIC, EVENTS_AVRO_TOPIC, CUSTOMER_AFTER_DDL, CUSTOMERS_TOPIC

EVENTS_AVRO_AFTER = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DecimalType(10, 2)),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)

EVENTS_SINK_DDL = (
    "user_id bigint, quantity int, unit_price decimal(10,2), total_price decimal(12,2), "
    "status string, created_at timestamp_ntz, updated_at timestamp_ntz"
)


def events_mapping(fmt: str) -> list[ColumnRule]:
    """Sink columns of the events table.  JSON carries the price as a string; Avro as a
    decimal.  Timestamps are ISO-8601 ``...Z`` strings and land as UTC ``timestamp_ntz``."""
    price = "try_cast(after.unit_price as decimal(10,2))" if fmt == "json" else "after.unit_price"
    return [
        ColumnRule("user_id", "after.user_id", ("user_id",)),
        ColumnRule("quantity", "after.quantity", ("quantity",)),
        ColumnRule("unit_price", price, ("unit_price",), "IDENTITY", "exact", "decimal(10,2)"),
        ColumnRule("total_price", f"{price} * after.quantity", ("quantity", "unit_price"), "TRANSFORMATION", "exact", "decimal(12,2)"),
        ColumnRule("status", "after.status", ("status",)),
        ColumnRule("created_at", "try_cast(after.created_at as timestamp_ntz)", ("created_at",), "IDENTITY", "exact"),
        ColumnRule("updated_at", "try_cast(after.updated_at as timestamp_ntz)", ("updated_at",), "IDENTITY", "exact"),
    ]


def events_spec(fmt: str = "json", deletes: str = "ignore") -> TableSpec:
    return TableSpec(
        table="poc.shop_events_json" if fmt == "json" else "poc.shop_events",
        topic=EVENTS_TOPIC if fmt == "json" else EVENTS_AVRO_TOPIC,
        keys=("user_id",),
        after_ddl=EVENTS_AFTER_DDL,
        mapping=events_mapping(fmt),
        fmt=fmt,
        deletes=deletes,
        avro_after=EVENTS_AVRO_AFTER if fmt == "avro" else None,
    )


CUSTOMER_MAPPING = [
    ColumnRule(c, f"after.{c}", (c,)) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
]


def customers_spec(fmt: str = "json", deletes: str = "ignore") -> TableSpec:
    table = "poc.shop_customers_json" if fmt == "json" else "poc.shop_customers"
    return TableSpec(table, CUSTOMERS_TOPIC, ("c_custkey",), CUSTOMER_AFTER_DDL, CUSTOMER_MAPPING, fmt=fmt, deletes=deletes, avro_keys=fmt == "avro")


def key_ddl(spec: TableSpec) -> str:
    types = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(spec.after_ddl).fields}
    return ", ".join(f"`{k}` {types.get(k, 'string')}" for k in spec.keys)


def decoded_changes(log: DataFrame, spec: TableSpec, registry: DataFrame | None = None, tombstones: bool = True) -> DataFrame:
    """``after, op, _key, topic, partition, offset``: decoded envelope beside the log position.

    ``_key`` is the primary key parsed from the message key, so tombstones (no envelope)
    still carry their key.  ``tombstones=False`` drops NULL values at the scan first.
    """
    if not tombstones:
        log = drop_tombstones(log)
    if spec.fmt == "json":
        parsed = decode_json(log, spec.after_ddl)
    else:
        if registry is None:
            raise ValueError("Avro decoding needs the registry")
        parsed = decode_avro(split_confluent(log), spec.avro_after or T.StructType.fromDDL(spec.after_ddl), registry)
        if spec.avro_keys:
            parsed = decode_avro_key(parsed, T.StructType.fromDDL(key_ddl(spec)), registry)
    return parsed.select(
        F.col("envelope.after").alias("after"),
        F.col("envelope.op").alias("op"),
        F.col("_key") if spec.avro_keys else F.from_json(F.col("key").cast("string"), key_ddl(spec)).alias("_key"),
        "topic",
        "partition",
        "offset",
    )


def stage(log: DataFrame, spec: TableSpec, registry: DataFrame | None = None, keep_offset: bool = False) -> DataFrame:
    """The upsert stage: one row per key, projected to the sink columns.

    ``deletes="ignore"`` (default): deletes and tombstones are dropped *before* ranking,
    so the last live image of a deleted key wins.  ``deletes="apply"``: rank all changes
    by the message key, then drop keys whose latest change is a delete/tombstone.
    """
    flat = decoded_changes(log, spec, registry)
    if spec.deletes == "apply":
        pks = [f"_pk{i}" for i in range(len(spec.keys))]
        slim = flat.select("after", "op", "offset", *[F.col(f"_key.{k}").alias(p) for k, p in zip(spec.keys, pks)])
        latest = live_changes(latest_by_key(slim, pks))
    else:
        # only what the projection reads enters the aggregate buffer (the optimizer cannot
        # prune fields inside max_by's struct): less to sort and to shuffle
        latest = latest_by_key(flat.select("after", "op", "offset"), spec.key_paths, where=live_condition(), keep_keys=True)
        keys = {p: f"_k{i}" for i, p in enumerate(spec.key_paths)}
        return project(latest, spec.mapping, extra=[F.col("offset").alias("_offset")] if keep_offset else (), key_columns=keys)
    return project(latest, spec.mapping, extra=[F.col("offset").alias("_offset")] if keep_offset else ())


def stage_changes(log: DataFrame, spec: TableSpec, registry: DataFrame | None = None) -> DataFrame:
    """The stage of a load into a table: the sink columns, ``_offset`` and ``_deleted``, one row per key.

    ``deletes="ignore"``: the last live image of each key.  ``deletes="apply"``: the last change of each key; where it is a
    delete or a tombstone the row holds only the key (from the message key), its offset and the flag.
    """
    if spec.deletes != "apply":
        return stage(log, spec, registry, keep_offset=True).withColumn("_deleted", F.lit(False))
    pks = {f"after.{k}": f"_pk{i}" for i, k in enumerate(spec.keys)}
    flat = decoded_changes(log, spec, registry)
    slim = flat.select("after", "op", "offset", *[F.col(f"_key.{k}").alias(p) for k, p in zip(spec.keys, pks.values(), strict=True)])
    latest = latest_by_key(slim, list(pks.values())).withColumn("_deleted", ~F.coalesce(live_condition(), F.lit(False)))
    # a delete of no key deletes nothing
    latest = keep_decoded(latest, lambda r: ~(r["_deleted"] & r["_pk0"].isNull()))
    latest = latest.withColumn("after", F.when(~F.col("_deleted"), F.col("after")))
    return project(latest, spec.mapping, extra=[F.col("offset").alias("_offset"), F.col("_deleted")], key_columns=pks)


def register_stage_views(log: DataFrame, spec: TableSpec, prefix: str, registry: DataFrame | None = None) -> list[str]:
    """Expose each step as a temp view for SQL users: ``{prefix}_flat`` (decoded
    envelopes), ``{prefix}_dedup`` (latest live change per key), ``{prefix}_stage``."""
    flat = decoded_changes(log, spec, registry)
    flat.createOrReplaceTempView(f"{prefix}_flat")
    latest_by_key(flat, spec.key_paths, where=live_condition()).createOrReplaceTempView(f"{prefix}_dedup")
    stage(log, spec, registry).createOrReplaceTempView(f"{prefix}_stage")
    return [f"{prefix}_flat", f"{prefix}_dedup", f"{prefix}_stage"]


def source_marker(log: DataFrame, consumed: list[tuple]) -> list[tuple]:
    """The binlog position of the newest consumed change that has one: only the last row of each consumed range is read."""
    if not consumed:
        return []
    last = restrict_offsets(log, [(t, p, end - 1, end) for t, p, _, end in consumed])
    at = F.from_json(F.col("value").cast("string"), "source struct<file string, pos bigint>")["source"]
    row = last.select(at.alias("s")).filter("s.file IS NOT NULL").agg(F.max("s").alias("s")).first()["s"]
    return [("mysql", "binlog", f"{row['file']}:{row['pos']}")] if row else []


def load_markers(log: DataFrame, spec: TableSpec, consumed: list[tuple]) -> list[tuple]:
    """A load's markers but for the snapshot id: the binlog position (JSON envelopes) and the offset range of each topic partition."""
    offsets = [("kafka", "kafka_offset", f"{t}:{p}:{a}-{b}") for t, p, a, b in consumed]
    return (source_marker(log, consumed) if spec.fmt == "json" else []) + offsets


def load_table(
    spark: SparkSession,
    spec: TableSpec,
    log: DataFrame,
    root: str,
    sink_ddl: str,
    registry: DataFrame | None = None,
    app_id: str = "",
    batch_id: int | None = None,
    run_id: str = "",
    resume: bool = False,
) -> int | None:
    """Run one load: offsets -> stage -> guard -> merge by offset -> one commit of counts, consumed ranges and markers.

    The offset ranges are fixed first and the log is restricted to them, so what is recorded is what was read, also of a log that
    grows.  With ``resume`` the offsets that earlier loads of the table consumed are left out of the scan: gaps, new topic
    partitions and everything behind are read.  The stage is materialised once and checked to hold one row per key.  A
    catalog table that supports it gets the same as ``MERGE INTO`` (and returns None); else the snapshot id is returned.
    """
    before = upsert.consumed_ranges(spark, root, spec.table) if resume else None
    ranges = offset_ranges(exclude_offsets(log, before) if resume else log).select("topic", "partition", "start_offset", "end_offset")
    ranges = subtract_ranges(ranges, before) if resume else ranges
    consumed = sorted(tuple(r) for r in ranges.collect())  # one row per topic partition, and per gap that earlier loads left
    log = restrict_offsets(log, consumed)
    staged = upsert.materialised(stage_changes(log, spec, registry))
    keyed = staged.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in spec.keys))
    assert_unique_keys(keyed, spec.keys)
    run = run_id or app_id or spark.sparkContext.applicationId
    markers = load_markers(log, spec, consumed)
    if upsert.supports_merge(spark, spec.table):
        upsert.merge_into_catalog(spark, spec.table, staged, list(spec.keys))
        for hop, kind, value in [*markers, ("topic->table", "catalog_merge", spec.table)]:
            upsert.record_marker(spark, root, run, hop, kind, value)
        return None
    return upsert.merge_into_table(spark, root, spec.table, sink_ddl, staged, list(spec.keys), app_id=app_id, batch_id=batch_id, run_id=run, consumed=consumed, markers=markers)
