"""Queries on identities as of a snapshot, retention by consumed offsets, precision along column paths, cycles of jobs, and outages of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as idn
from ..lineage import audit
from ..lineage.graph import strong_components
from ..lineage.identity_map import sink_identity_as_of
from ..lineage.outages import run_outages
from ..lineage.retention import retention_by_offsets
from ..sources import derived as d
from .queries_versioning import EVAL_TIME

IDENTITY_EVENTS = 50  # the tables get new storage at every such event


def _storage(table: str, creation: Column) -> Column:
    """``poc/shop_t{k}_json_<uuid>``, the uuid from the event that created the storage."""
    h = F.md5(F.concat_ws("-", creation.cast("string"), F.col(table).cast("string")))
    parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("poc/shop_t"), F.col(table).cast("string"), F.lit("_json_"), F.concat_ws("-", *parts))


def identity_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What runs wrote to, and the identities of the four sink tables.

    Every ``IDENTITY_EVENTS``-th event gives each table new storage.  Each event of a Spark run writes to table ``user_id % 4``: it names the storage
    made by the event before it that is divisible by ``IDENTITY_EVENTS``, for ``event_id % 3 = 0`` the one before that, for ``user_id % 5 = 1``
    that without a suffix, for ``user_id % 5 = 2`` another table's.
    """
    ev = d.table(spark, sf_dir, "events")
    name = lambda k: F.concat(F.lit("poc.shop_t"), F.col(k).cast("string"), F.lit("_json"))
    made = ev.filter(F.col("event_id") % IDENTITY_EVENTS == 0).withColumn("k", F.expr("explode(sequence(0L, 3L))"))
    identities = made.select(
        name("k").alias("table"), F.col("ts").alias("observed_at"), (F.col("event_id") * 1000003 + 17).alias("snapshot_id"),
        F.concat(F.lit(idn.sink_physical_namespace() + ".shop_t"), F.col("k").cast("string"), F.lit("_json")).alias("physical_table"),
        _storage("k", F.col("event_id")).alias("storage_in_force"),
    )
    u, at = F.col("user_id"), F.col("event_id")
    last = at - at % IDENTITY_EVENTS
    runs = ev.filter(u % 10 != 0).withColumn("k", u % 4).withColumn("other", (u + 1) % 4)
    storage = _storage("k", F.when(at % 3 == 0, last - IDENTITY_EVENTS).otherwise(last))
    storage = F.when(u % 5 == 1, idn.storage_to_logical(storage)).when(u % 5 == 2, _storage("other", last)).otherwise(storage)
    outputs = runs.select(F.concat(F.lit("run-"), u.cast("string")).alias("run_id"), "event_id", name("k").alias("table"), F.col("ts").alias("observed_at"), storage.alias("storage_name"))
    return outputs, identities


def q_sink_identity_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, identities = identity_inputs(spark, sf_dir)
    return sink_identity_as_of(outputs, identities)


def q_retention_by_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase commits a snapshot of the ``300 + 700 * (user_id % 7)`` offsets up to its own, of its topic partition."""
    ev = d.table(spark, sf_dir, "events")
    topic, partition = F.lit(d.EVENTS_TOPIC), (F.col("user_id") % d.LOG_PARTITIONS).cast("int").alias("partition")
    messages = ev.select(topic.alias("topic"), partition, F.col("event_id").alias("offset"), "ts")
    commits = ev.filter("event_type = 'purchase'").withColumn("snapshot_id", F.col("event_id") * 1000003 + 17)
    start = F.greatest(F.lit(0), F.col("event_id") - 300 - 700 * (F.col("user_id") % 7))
    ranges = commits.select(F.col("snapshot_id").alias("range_id"), topic.alias("topic"), partition, start.alias("start_offset"), (F.col("event_id") + 1).alias("end_offset"))
    snaps = commits.select(F.concat(F.lit("poc.shop_t"), (F.col("user_id") % 4).cast("string")).alias("table"), "snapshot_id", F.col("ts").alias("committed_at"))
    return retention_by_offsets(snaps, ranges, messages, EVAL_TIME, topic_hours=336)


#: Kinds of columns; the last two bits of a column's number.
KINDS = ("brand", "part", "order", "customer")


def column_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Column edges brand -> part -> order -> customer, line items with number 7 also part -> customer, the customers as sinks, and the brands.

    Hops carry ``exact``, ``inferred`` or ``lost`` by the remainder of a key; every seventh part has no facet.  Columns are numbers:
    the key, for a brand its ``brand_id``, times four plus the place of its kind.
    """
    claim = lambda n: F.element_at(F.array(F.lit("exact"), F.lit("inferred"), F.lit("lost")), (n % 3 + 1).cast("int"))
    node = lambda kind, c: F.col(c).cast("long") * 4 + KINDS.index(kind)
    parts = d.table(spark, sf_dir, "part")
    brands = parts.select("p_brand").distinct().filter("p_brand is not null").withColumn("brand_id", F.monotonically_increasing_id()).checkpoint()
    part = parts.join(brands, "p_brand", "left").select(node("brand", "brand_id").alias("src"), node("part", "p_partkey").alias("dst"), F.when(F.col("p_partkey") % 7 != 0, claim(F.col("p_partkey"))).alias("precision"))
    lines = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    used = lines.select(node("part", "l_partkey").alias("src"), node("order", "l_orderkey").alias("dst"), claim(F.col("l_linenumber")).alias("precision"))
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    summed = orders.select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst"), claim(F.col("o_orderkey") % 2).alias("precision"))
    direct = lines.filter("l_linenumber = 7").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    direct = direct.select(node("part", "l_partkey").alias("src"), node("customer", "o_custkey").alias("dst"), F.lit("exact").alias("precision"))
    sinks = d.table(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("out_col"))
    return part.unionByName(used).unionByName(summed).unionByName(direct), sinks, brands


def q_column_path_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sinks, brands = column_graph(spark, sf_dir)
    found = audit.column_path_precision(edges, sinks)
    kind, key = F.col("in_col").bitwiseAND(3), F.shiftright("in_col", 2)
    names = found.join(brands.select((F.col("brand_id") * 4).alias("in_col"), "p_brand"), "in_col", "left")
    in_col = F.concat(F.element_at(F.array(*[F.lit(f"{k}|") for k in KINDS]), (kind + 1).cast("int")), F.when(kind == 0, F.col("p_brand")).otherwise(key.cast("string")))
    return names.select(F.concat(F.lit("customer|"), F.shiftright("out_col", 2).cast("string")).alias("out_col"), in_col.alias("in_col"), "precision")


def job_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges ``data -> job -> data``, a job per customer: job ``c`` reads dataset ``c`` and writes dataset ``(5 c + nation) % 6`` of its six,
    for nations divisible by 3 also dataset ``(c + 7) % 6`` of them."""
    c = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")).withColumn("base", F.expr("c - c % 6"))
    node = lambda kind, key: F.concat(F.lit(f"{kind}|"), key.cast("string"))
    out = lambda rows, key: rows.select(node("job", F.col("c")).alias("src"), node("data", F.expr(key)).alias("dst"))
    reads = c.select(node("data", F.col("c")).alias("src"), node("job", F.col("c")).alias("dst"))
    return reads.unionByName(out(c, "base + (5 * c + n) % 6")).unionByName(out(c.filter("n % 3 = 0"), "base + (c + 7) % 6"))


def q_lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of a cycle, its component and how many jobs that has."""
    cycles = strong_components(job_graph(spark, sf_dir))
    jobs = cycles.groupBy("component").agg(F.count_if(F.col("node").startswith("job|")).alias("n_jobs"))
    return cycles.join(jobs, "component").select("component", "node", "n_jobs")


def q_run_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven connector runs, every event a heartbeat of one: run 0 holds the events of a third of all users.  An error ends a run."""
    u = F.col("user_id")
    run = F.concat(F.lit("connector-"), F.when(u % 3 == 0, 0).otherwise(u % 7).cast("string"))
    beats = d.table(spark, sf_dir, "events").select(run.alias("run_id"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("ended"))
    return run_outages(beats, EVAL_TIME)


QUERIES = {
    "run_outages": q_run_outages,
    "lineage_cycles": q_lineage_cycles,
    "sink_identity_as_of": q_sink_identity_as_of,
    "retention_by_offsets": q_retention_by_offsets,
    "column_path_precision": q_column_path_precision,
}
