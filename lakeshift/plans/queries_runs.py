"""Registered queries: resume from consumed offsets, the lineage store folded from event documents, run chains, facets of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage.audit import REQUIRED_MARKERS
from ..lineage.chains import complete_runs, run_chains
from ..lineage.events import parse_events
from ..lineage.facets import facet_column_edges, facet_problems
from ..lineage.graph import current_edges
from ..lineage.store import store_from_events
from ..operators.upsert import consumed_ranges, read_current
from ..session import scratch_path
from ..sources import changelog as cl
from ..sources import derived as d
from . import loader

#: Offsets of a connector run and of a consuming run; no multiple of each other, so some runs cross a restart.
CONNECTOR_OFFSETS, RUN_OFFSETS = 1700, 500


# ------------------------------------------------------------------ resume -----------


def three_loads(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Of each topic partition with greatest offset ``m``: offsets below ``m div 4``, those from ``m div 2`` to below
    ``3 m div 4``, and once more those from ``m div 8`` to below ``m div 4``."""
    log = d.events_log(spark, sf_dir)
    ends = [(r["topic"], r["partition"], r["end_offset"] - 1) for r in cl.offset_ranges(log).collect()]  # one row per topic partition
    root, spec = scratch_path(spark, "resume"), loader.events_spec("json")
    for i, (lo, hi) in enumerate([(lambda m: 0, lambda m: m // 4), (lambda m: m // 2, lambda m: 3 * m // 4), (lambda m: m // 8, lambda m: m // 4)]):
        part = cl.restrict_offsets(log, [(t, p, lo(m), hi(m)) for t, p, m in ends])
        loader.load_table(spark, spec, part, root, loader.EVENTS_SINK_DDL, run_id=f"load-{i + 1}")
    return root, log


def q_resume_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three loads left to be read."""
    root, _ = three_loads(spark, sf_dir)
    return cl.resume_ranges(consumed_ranges(spark, root, loader.events_spec("json").table))


def q_offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = three_loads(spark, sf_dir)
    return cl.offset_gaps(consumed_ranges(spark, root, loader.events_spec("json").table))


def q_resumed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a fourth load that reads what the three left: equal to one load of everything."""
    root, log = three_loads(spark, sf_dir)
    spec = loader.events_spec("json")
    loader.load_table(spark, spec, log, root, loader.EVENTS_SINK_DDL, run_id="load-4", resume=True)
    return read_current(spark, root, spec.table, loader.EVENTS_SINK_DDL)


# ------------------------------------------------------- store from documents --------


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events as JSON documents: outputs are named by the event that completes a run only, and runs of users
    divisible by 6 read a second topic."""
    dataset = lambda ns, name: F.struct(F.lit(ns).alias("namespace"), name.alias("name"))
    u = F.col("user_id")
    topic = lambda k: dataset("kafka://broker:9092", F.concat(F.lit("mysqljson.shop.t"), k.cast("string")))
    none = F.array().cast("array<struct<namespace:string,name:string>>")
    inputs = F.when(u % 10 == 0, none).when(u % 6 == 0, F.array(topic(u % 4), topic((u + 1) % 4))).otherwise(F.array(topic(u % 4)))
    out = F.array(dataset("s3://warehouse", F.concat(F.lit("poc/shop_t"), (u % 4).cast("string"))))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'RUNNING' END")
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("eventTime"),
        kind.alias("eventType"),
        F.struct(F.concat(F.lit("run-"), u.cast("string")).alias("runId")).alias("run"),
        F.struct(F.when(u % 10 == 0, F.lit("airflow")).otherwise(F.lit("spark")).alias("namespace"), F.concat(F.lit("load_t"), (u % 4).cast("string")).alias("name")).alias("job"),
        inputs.alias("inputs"),
        F.when((kind == "COMPLETE") & (u % 10 != 0), out).otherwise(none).alias("outputs"),
    )
    return d.table(spark, sf_dir, "events", spread=True).select(F.to_json(doc).alias("value"))


def q_store_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables of the store as rows of one."""
    store = store_from_events(parse_events(event_documents(spark, sf_dir)))
    null = lambda t: F.lit(None).cast(t)
    named = lambda name, kind: store[name].select(F.lit(kind).alias("kind"), "uuid", F.col("namespace_name").alias("a"), F.col("name").alias("b"), null("boolean").alias("is_current"))
    versions = store["job_versions"].select(F.lit("job_version"), "uuid", "job_uuid", null("string"), null("boolean"))
    io = store["io_mapping"].select(F.lit("io"), "job_version_uuid", "dataset_uuid", "io_type", "is_current_job_version")
    return named("datasets", "dataset").union(named("jobs", "job")).union(versions).union(io)


def q_edges_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current edges of the store that was folded from the documents."""
    store = store_from_events(parse_events(event_documents(spark, sf_dir)))
    return current_edges(store["datasets"], store["jobs"], store["job_versions"], store["io_mapping"], order=False)


# ------------------------------------------------------------------ chains -----------


def chain_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Consumed ranges, produced ranges, snapshots and markers.

    A run is a user's events in one block of ``RUN_OFFSETS`` offsets; in each deployment it consumed from its first to its last
    offset.  A connector run produced ``CONNECTOR_OFFSETS`` offsets of a table's topic in every instance, in epoch 2 only
    where its number is odd.  Purchases commit snapshots.  Runs of users ``u % 7 = 2`` have no offset marker.
    """
    u, at = F.col("user_id"), F.col("event_id")
    ev = d.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run-"), u.cast("string"), F.lit("-"), F.floor(at / RUN_OFFSETS).cast("string")).alias("run_id"),
        F.concat(F.lit("inst-"), (u % 2).cast("string")).alias("instance_id"),
        F.when((u % 13 == 0) & (at % 2 == 0), 2).otherwise(1).alias("stack_epoch"),
        F.concat(F.lit("mysqljson.shop.t"), (u % 4).cast("string")).alias("topic"),
        F.concat(F.lit("shop.t"), (u % 4).cast("string")).alias("source"),
        (u % d.LOG_PARTITIONS).cast("int").alias("partition"),
        at.alias("offset"), (u % 7 != 2).alias("has_offset"), "event_type",
        F.floor(at / CONNECTOR_OFFSETS).alias("c"),
    )
    on = ["instance_id", "stack_epoch", "topic", "partition"]
    consumed = ev.groupBy("run_id", *on).agg(F.min("offset").alias("start_offset"), (F.max("offset") + 1).alias("end_offset"))
    runs = ev.select("instance_id", "topic", "source", "partition", "c").distinct().withColumn("stack_epoch", F.explode(F.when(F.col("c") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    produced = runs.select(*on, "source", F.concat_ws("-", F.lit("conn"), "topic", F.col("c").cast("string")).alias("connector_run_id"), (F.col("c") * CONNECTOR_OFFSETS).alias("start_offset"), ((F.col("c") + 1) * CONNECTOR_OFFSETS).alias("end_offset"))
    snaps = ev.filter("event_type = 'purchase'").select("run_id", "instance_id", "stack_epoch", (F.col("offset") * 1000003 + 17).alias("snapshot_id"))
    kinds = F.array(F.lit("binlog"), F.when(F.col("has_offset"), F.lit("kafka_offset")), F.when(F.col("event_type") == "purchase", F.lit("snapshot_id")))
    markers = ev.select("run_id", F.explode(kinds).alias("marker_kind")).filter("marker_kind IS NOT NULL").distinct()
    return consumed, produced, snaps, markers


def q_run_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    consumed, produced, snaps, _ = chain_inputs(spark, sf_dir)
    return run_chains(consumed, produced, snaps)


def q_complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose whole chain lies in one deployment and that have every marker."""
    consumed, produced, snaps, markers = chain_inputs(spark, sf_dir)
    return complete_runs(run_chains(consumed, produced, snaps), markers, list(REQUIRED_MARKERS))


def facet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event document per event with a schema facet of ``id, total, c0`` and a column facet of ``id``, ``total`` and ``c{event_id % 5}``.

    ``total`` is computed from two columns, for every third event indirectly; ``c...`` has an input for even events only.  Events divisible
    by 7 have no column facet, those by 11 one of another shape, and documents of those by 13 are cut off.
    """
    e, k = F.col("event_id"), (F.col("user_id") % 4).cast("string")
    def field(name: str, direct: Column) -> Column:
        kind = F.when(direct, F.lit("DIRECT")).otherwise(F.lit("INDIRECT"))
        return F.struct(F.lit("kafka://broker:9092").alias("namespace"), F.concat(F.lit("mysqljson.shop.t"), k).alias("name"), F.lit(name).alias("field"), F.array(F.struct(kind.alias("type"))).alias("transformations"))
    raw = F.array(field("raw", F.lit(False)))
    spec = lambda fields: F.struct(fields.alias("inputFields"))
    total = F.array(field("quantity", e % 3 != 0), field("price", e % 3 != 0))
    fields = F.create_map(F.lit("id"), spec(F.array(field("id", F.lit(True)))), F.lit("total"), spec(total), F.concat(F.lit("c"), (e % 5).cast("string")), spec(F.when(e % 2 == 0, raw).otherwise(F.slice(raw, 1, 0))))
    claim = F.when(e % 11 == 0, F.lit('"columnLineage":{"fields":"none"},')).when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"columnLineage":{"fields":'), F.to_json(fields), F.lit("},")))
    head = F.concat(F.lit('{"job":{"namespace":"spark","name":"load_t'), k, F.lit('"},"outputs":[{"namespace":"s3://warehouse","name":"poc/shop_t'), k)
    text = F.concat(head, F.lit('","facets":{'), claim, F.lit('"schema":{"fields":[{"name":"id"},{"name":"total"},{"name":"c0"}]}}}]}'))
    return d.table(spark, sf_dir, "events", spread=True).select(F.when(e % 13 == 0, F.substring(text, 1, 100)).otherwise(text).alias("value"))


def q_facet_column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_column_edges(facet_documents(spark, sf_dir))


def q_facet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_problems(facet_documents(spark, sf_dir))


QUERIES = {
    "facet_column_edges": q_facet_column_edges,
    "facet_problems": q_facet_problems,
    "resume_ranges": q_resume_ranges,
    "offset_gaps": q_offset_gaps,
    "resumed_load": q_resumed_load,
    "store_from_events": q_store_from_events,
    "edges_from_events": q_edges_from_events,
    "run_chains": q_run_chains,
    "complete_runs": q_complete_runs,
}
