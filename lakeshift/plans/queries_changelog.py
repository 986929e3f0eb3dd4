"""Registered queries over change logs, decode, dedup, projection and capture.

Each query takes ``(spark, sf_dir)``, derives its input from the driver tables with Spark
(``sources/derived.py``) and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeprec import gtid_source, gtid_txn, ns_is_derived, precision_class
from ..operators.decode import decode_json, flatten_envelope, keep_decoded, live_changes, live_condition, split_confluent
from ..operators.transform import latest_by_key
from ..sources import changelog as cl
from ..session import scratch_path
from ..sources import derived as d
from . import loader


def _events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.decoded_changes(d.events_log(spark, sf_dir), loader.events_spec("json"))


def _change_cols(df: DataFrame) -> DataFrame:
    return df.select(F.col("after.user_id").alias("user_id"), "offset", "op", F.col("after.status").alias("status"))


def q_live_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones, deletes and NULL ops dropped."""
    return _change_cols(live_changes(_events_flat(spark, sf_dir)))


def q_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest live change per key, ``row_number`` form."""
    return _change_cols(latest_by_key(_events_flat(spark, sf_dir), ["after.user_id"], method="window", where=live_condition()))


def q_latest_by_key_maxby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest live change per key, ``max_by`` (partial aggregate) form."""
    return _change_cols(latest_by_key(_events_flat(spark, sf_dir), ["after.user_id"], method="agg", where=live_condition()))


def q_json_upsert_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: JSON change log -> upsert stage with derived ``total_price``."""
    return loader.stage(d.events_log(spark, sf_dir), loader.events_spec("json"))


def q_avro_upsert_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro change log (two writer schemas) -> the same stage as the JSON path."""
    return loader.stage(d.events_avro_log(spark, sf_dir), loader.events_spec("avro"), d.registry(spark))


def q_avro_frame_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per writer schema id (NULL id = tombstone)."""
    frames = split_confluent(d.events_avro_log(spark, sf_dir))
    return frames.groupBy("schema_id").agg(F.count(F.lit(1)).alias("frames"))


def q_customer_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot log of all customers -> 1:1 passthrough projection."""
    spec = loader.customers_spec()
    return loader.stage(d.customers_log(spark, sf_dir), spec)


def q_source_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-hop marker from the envelope ``source`` block, with the timestamp precision class."""
    parsed = decode_json(d.events_log(spark, sf_dir), d.EVENTS_AFTER_DDL, with_source=True)
    flat = keep_decoded(flatten_envelope(parsed, keep=("source",)), lambda r: r["source"].isNotNull())
    s = "source."
    return flat.select(
        "offset",
        F.col(s + "file").alias("binlog_file"),
        F.col(s + "pos").alias("binlog_pos"),
        gtid_source(F.col(s + "gtid")).alias("gtid_source"),
        gtid_txn(F.col(s + "gtid")).alias("gtid_txn"),
        F.col(s + "ts_ms").alias("ts_ms"),
        F.col(s + "ts_us").alias("ts_us"),
        F.col(s + "ts_ns").alias("ts_ns"),
        precision_class(F.col(s + "ts_us")).alias("precision"),
        ns_is_derived(F.col(s + "ts_ns")).alias("ns_derived"),
    )


def q_changelog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.changelog_counts(_events_flat(spark, sf_dir))


def q_key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen more than once in the log (by message key, tombstones included)."""
    return cl.key_multiplicity(_events_flat(spark, sf_dir), F.col("_key.user_id")).withColumnRenamed("pk", "user_id")


def q_offset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.offset_ranges(d.events_log(spark, sf_dir))


def second_batch_ranges(log: DataFrame) -> DataFrame:
    """Resume point of an incremental run: the first run consumed ``offset < max div 2``
    per partition; the second starts there and reads to the end."""
    r = cl.offset_ranges(log)
    return r.select(
        "topic",
        "partition",
        F.floor((F.col("end_offset") - 1) / 2).cast("bigint").alias("start_offset"),
        F.lit(None).cast("bigint").alias("end_offset"),
    )


def q_incremental_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset-bounded read of the log from the saved resume point (no full re-read)."""
    log = d.events_log(spark, sf_dir)
    batch = cl.restrict_offsets(log, second_batch_ranges(log))
    flat = loader.decoded_changes(batch, loader.events_spec("json"))
    return flat.select("partition", "offset", "op")


def q_sample_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 5 messages from the beginning (top-n is the feature)."""
    return cl.sample_changelog(d.events_log(spark, sf_dir), 5).select("partition", "offset", F.col("value").isNull().alias("tombstone"))


def q_route_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables' changes routed to their topics and partitions, dropped as one folder per topic, and read back
    topic by topic: messages per topic partition."""
    root = scratch_path(spark, "routed")
    for log, prefix, key in ((d.orders_snapshot_log(spark, sf_dir), "mysql", "o_orderkey"), (d.events_log(spark, sf_dir), "mysqljson", "user_id")):
        name = F.split("topic", r"\.")
        keyed = log.withColumn("db", name[1]).withColumn("table", name[2]).withColumn("_k", F.get_json_object(F.col("key").cast("string"), f"$.{key}").cast("bigint"))
        routed = cl.route_topics(keyed.drop("topic", "partition"), prefix, d.LOG_PARTITIONS, ["_k"])
        cl.write_routed(routed.select(*cl.LOG_COLUMNS), root)
    back = cl.read_changelog(spark, root, topics=[d.ORDERS_TOPIC, d.EVENTS_TOPIC])
    return back.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("messages"))


def q_snapshot_to_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial snapshot of ``orders`` as read events."""
    log = d.orders_snapshot_log(spark, sf_dir)
    parsed = decode_json(log, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate date")
    return parsed.select(
        "envelope.after.*",
        "partition",
        "offset",
        F.col("envelope.op").alias("op"),
    )


def q_table_diff_to_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers v1 -> v2 as c/u/d envelopes plus delete tombstones."""
    log = cl.table_diff_to_changes(d.customers_v1(spark, sf_dir), d.customers_v2(spark, sf_dir), "c_custkey", d.CUSTOMERS_TOPIC, d.LOG_PARTITIONS)
    parsed = decode_json(log, d.CUSTOMER_AFTER_DDL, with_before=True)
    return parsed.select(
        F.from_json(F.col("key").cast("string"), "c_custkey bigint").getField("c_custkey").alias("c_custkey"),
        F.col("envelope.op").alias("op"),
        F.col("envelope").isNull().alias("tombstone"),
        F.col("envelope.before.c_acctbal").alias("before_acctbal"),
        F.col("envelope.after.c_acctbal").alias("after_acctbal"),
        "partition",
        "offset",
    )


def q_capture_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot, diff, diff: the latest change of each key over three captures is version 3."""
    return loader.stage(d.customers_capture_log(spark, sf_dir), loader.customers_spec(deletes="apply"))


def q_customers_avro_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same captures as Avro values and keys: equal to the JSON path, deletes found by their Avro keys."""
    log, registry = d.customers_avro_log(spark, sf_dir)
    return loader.stage(log, loader.customers_spec("avro", deletes="apply"), registry)


QUERIES = {
    "live_changes": q_live_changes,
    "latest_by_key": q_latest_by_key,
    "latest_by_key_maxby": q_latest_by_key_maxby,
    "json_upsert_projection": q_json_upsert_projection,
    "avro_upsert_projection": q_avro_upsert_projection,
    "avro_frame_header": q_avro_frame_header,
    "customer_passthrough": q_customer_passthrough,
    "source_position": q_source_position,
    "changelog_counts": q_changelog_counts,
    "key_multiplicity": q_key_multiplicity,
    "offset_ranges": q_offset_ranges,
    "incremental_offsets": q_incremental_offsets,
    "sample_changelog": q_sample_changelog,
    "route_topics": q_route_topics,
    "snapshot_to_changes": q_snapshot_to_changes,
    "capture_chain": q_capture_chain,
    "customers_avro_projection": q_customers_avro_projection,
    "table_diff_to_changes": q_table_diff_to_changes,
}
