"""Registered queries: merge/upsert, snapshots and markers, retention, reconciliation and
the naming/identity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as idn
from ..lineage import audit
from ..lineage.events import runs
from ..operators.decode import keep_decoded
from ..operators.upsert import current_snapshots, merge_actions, merge_upsert, read_current, read_markers, read_snapshots
from ..session import scratch_path, scratch_root
from ..sources import changelog as cl
from ..sources import derived as d
from . import loader

EVAL_TIME = "2024-01-31 00:00:00"  # evaluation time of the retention check (fixed, data spans January 2024)


def _customer_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The v1 -> v2 upsert stage, materialised once (it is size-checked, then merged)."""
    log = cl.table_diff_to_changes(d.customers_v1(spark, sf_dir), d.customers_v2(spark, sf_dir), "c_custkey", d.CUSTOMERS_TOPIC, d.LOG_PARTITIONS)
    scratch_root(spark)
    return loader.stage(log, loader.customers_spec()).checkpoint()


def q_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers v1 as the target, the v1 -> v2 change log as the stage."""
    return merge_upsert(d.customers_v1(spark, sf_dir), _customer_stage(spark, sf_dir), ["c_custkey"])


def q_merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_upsert(d.customers_v1(spark, sf_dir), _customer_stage(spark, sf_dir), ["c_custkey"], with_action=True)
    return merge_actions(merged)


def q_merge_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental loads: the first half of each partition, then the rest merged on top --
    equal to one full load.  (The committed-version form of the same flow is exercised by
    ``stream_upsert`` and the tests.)"""
    log = d.events_log(spark, sf_dir)
    resume = loader_resume(log).collect()  # one row per topic partition
    first = cl.restrict_offsets(log, [(r["topic"], r["partition"], 0, r["start_offset"]) for r in resume])
    second = cl.restrict_offsets(log, [(r["topic"], r["partition"], r["start_offset"], None) for r in resume])
    spec = loader.events_spec("json")
    return merge_upsert(loader.stage(first, spec), loader.stage(second, spec), ["user_id"])


def loader_resume(log: DataFrame) -> DataFrame:
    from .queries_changelog import second_batch_ranges

    return second_batch_ranges(log)


def _two_loads(spark: SparkSession, sf_dir: str, name: str, deletes: str) -> tuple[str, object]:
    """Two loads of the events log into one table: the first half of each partition, then the rest."""
    log = d.events_log(spark, sf_dir)
    resume = loader_resume(log).collect()  # one row per topic partition
    root = scratch_path(spark, name)
    spec = loader.events_spec("json", deletes=deletes)
    halves = [(r["topic"], r["partition"], 0, r["start_offset"]) for r in resume], [(r["topic"], r["partition"], r["start_offset"], None) for r in resume]
    for i, half in enumerate(halves):
        loader.load_table(spark, spec, cl.restrict_offsets(log, half), root, loader.EVENTS_SINK_DDL, run_id=f"load-{i + 1}")
    return root, spec


def q_merge_apply_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deletes="apply"``: the second load's deletes take keys out of the table that the first load wrote."""
    root, spec = _two_loads(spark, sf_dir, "apply_deletes", "apply")
    return read_current(spark, root, spec.table, loader.EVENTS_SINK_DDL)


def q_load_table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot log and version markers of two loads."""
    root, spec = _two_loads(spark, sf_dir, "load_versions", "ignore")
    snaps = read_snapshots(spark, root).filter(F.col("table") == spec.table)
    marks = read_markers(spark, root).filter("marker_kind = 'snapshot_id'").select(F.col("marker_value").cast("bigint").alias("snapshot_id"), "run_id", "hop")
    return snaps.drop("run_id").join(marks, "snapshot_id", "left").select("version", "operation", "inserted", "updated", "deleted", "run_id", "hop")


def q_current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_snapshots(d.snapshots(spark, sf_dir))


def q_snapshot_for_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot a run committed (joined by app id) vs the table's current snapshot."""
    snaps = d.snapshots(spark, sf_dir)
    by_app = snaps.groupBy("app_id", "table").agg(F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id")).alias("run_snapshot_id"))
    r = runs(d.run_events(spark, sf_dir)).select("run_id", "app_id")
    # one row per table: few keys, each with many runs.  The side comes out of a shuffle
    # stage, so adaptive execution sizes it at runtime and broadcasts it (skew-join
    # splitting otherwise) -- no extra counting pass over the events.
    cur = current_snapshots(snaps).select("table", F.col("snapshot_id").alias("current_snapshot_id"))
    return (
        r.join(by_app, "app_id")
        .join(cur, "table")
        .select("run_id", "table", "run_snapshot_id", "current_snapshot_id", (F.col("run_snapshot_id") == F.col("current_snapshot_id")).alias("is_current"))
    )


def q_check_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = d.run_events(spark, sf_dir)
    ranges = ev.groupBy("run_id").agg(F.min("event_time").alias("first_ts"), F.min("seq").alias("start_offset"))
    return audit.check_retention(d.snapshots(spark, sf_dir), ranges, EVAL_TIME)


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro-path result vs JSON-path result with the JSON side perturbed: users with
    ``user_id % 17 = 0`` missing, ``quantity + 1`` for ``user_id % 19 = 0``."""
    avro = loader.stage(d.events_avro_log(spark, sf_dir), loader.events_spec("avro"), d.registry(spark))
    js = loader.stage(d.events_log(spark, sf_dir), loader.events_spec("json"))
    # a predicate on the key would be pushed through the dedup and the decode into the
    # scan; the generator barrier keeps it on the (small) result
    js = keep_decoded(js, lambda r: r["user_id"] % 17 != 0).withColumn(
        "quantity", F.when(F.col("user_id") % 19 == 0, F.col("quantity") + 1).otherwise(F.col("quantity"))
    )
    return audit.reconcile(avro, js, ["user_id"], "avro", "json")


# ----------------------------------------------------------------- identity ----------


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = d.events_log(spark, sf_dir).select("topic").unionByName(d.orders_snapshot_log(spark, sf_dir).select("topic")).unionByName(
        d.customers_log(spark, sf_dir).select("topic")
    )
    return logs.distinct()


def q_identity_from_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic -> prefix/db/table, MySQL dataset (the MySQL <-> Kafka join key), registry
    subject and back, and the logical sink name."""
    t = F.col("topic")
    subject = idn.topic_to_subject(t)
    return _topics(spark, sf_dir).select(
        "topic",
        idn.topic_prefix(t).alias("prefix"),
        idn.topic_db(t).alias("db"),
        idn.topic_table(t).alias("tbl"),
        idn.mysql_dataset_name(t).alias("mysql_dataset"),
        subject.alias("subject"),
        (idn.subject_to_topic(subject) == t).alias("subject_round_trip"),
        idn.sink_logical_name(F.lit("poc"), t).alias("sink_logical"),
    )


def q_identity_physical_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run jobs and outputs: logical job key, asset URI split into namespace + name, and
    the physical sink table behind the storage name."""
    ev = d.run_events(spark, sf_dir).filter(F.size("outputs") > 0)
    outs = ev.select("job_ns", "job_name", F.explode("outputs").alias("o")).distinct()
    uri = F.concat(F.col("o.ns"), F.lit("/"), F.col("o.name"))
    return outs.select(
        "job_ns",
        "job_name",
        idn.emitter_key(F.col("job_ns"), F.col("job_name")).alias("job_logical"),
        uri.alias("output_uri"),
        idn.uri_namespace(uri).alias("uri_namespace"),
        idn.uri_name(uri).alias("uri_name"),
        F.lit(idn.sink_physical_namespace()).alias("physical_namespace"),
        F.regexp_replace(F.col("o.name"), "^poc/", "").alias("physical_table"),
    )


def q_storage_name_to_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage names with and without a ``_<uuid>`` suffix -> logical table name."""
    c = d.table(spark, sf_dir, "customer")
    h = F.md5(F.col("c_custkey").cast("string"))
    uid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    base = F.concat(F.lit("poc/shop_c"), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(base, F.lit("_"), uid)).otherwise(base)
    return c.select("c_custkey", name.alias("storage_name")).withColumn("logical_name", idn.storage_to_logical(F.col("storage_name")))


def q_job_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k=v,k=v`` ownership/tag strings -> one row per tag."""
    c = d.table(spark, sf_dir, "customer")
    tags = F.concat(
        F.lit("segment="), F.col("c_mktsegment"), F.lit(",nation="), F.col("c_nationkey").cast("string"), F.lit(",owner=team"), (F.col("c_custkey") % 5).cast("string")
    )
    return c.select(F.col("c_name").alias("job"), F.explode(idn.tags_to_map(tags)).alias("tag_key", "tag_value"))


QUERIES = {
    "merge_upsert": q_merge_upsert,
    "merge_actions": q_merge_actions,
    "merge_two_batches": q_merge_two_batches,
    "merge_apply_deletes": q_merge_apply_deletes,
    "load_table_versions": q_load_table_versions,
    "current_snapshot": q_current_snapshot,
    "snapshot_for_run": q_snapshot_for_run,
    "check_retention": q_check_retention,
    "reconcile": q_reconcile,
    "identity_from_topic": q_identity_from_topic,
    "identity_physical_logical": q_identity_physical_logical,
    "storage_name_to_logical": q_storage_name_to_logical,
    "job_tags": q_job_tags,
}
