"""Registered queries over the lineage tables: run events, the lineage-store graph,
reachability and the audits of the lineage model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as idn
from ..lineage import audit, events as lev, graph
from ..operators.decode import split_confluent
from ..operators.transform import mapping_frame, mapping_to_edges
from ..plans.sizing import bounded_broadcast
from ..session import scratch_path, scratch_root
from ..sources import derived as d, lineage_store
from . import loader

EVAL_TIME = "2024-01-31 00:00:00"
SINK_NS = "s3://poc-warehouse"
TOPIC_NS = "kafka://kafka:9092"
# Mapping registry bound: tables x columns; broadcast only under this row count.
MAX_MAPPING_ROWS = 100_000


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return d.lineage_store(spark, sf_dir)


# ------------------------------------------------------------------ graph ------------


def q_current_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return graph.current_edges(s["datasets"], s["jobs"], s["job_versions"], s["io_mapping"])


def q_datasets_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_by_namespace(_store(spark, sf_dir)["datasets"], "datasets")


def q_dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store, written and read back as its tables: every dataset by ``(namespace, name)``."""
    root = scratch_path(spark, "lineage_store")
    for name, rows in zip(lineage_store.TABLES, (_store(spark, sf_dir)[t] for t in ("datasets", "jobs", "job_versions", "io_mapping")), strict=True):
        rows.write.parquet(f"{root}/{name}")
    t = lineage_store.read_tables(spark, root)
    return t["datasets"].select("namespace_name", "name").distinct().orderBy("namespace_name", "name")


def q_connector_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors (one per customer segment and nation) and their load jobs: physical namespaces and logical keys."""
    c = d.table(spark, sf_dir, "customer")
    connector = F.concat_ws("-", F.lit("shop"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return c.select(connector.alias("connector")).distinct().select(
        "connector",
        idn.connector_physical_namespace(F.col("connector")).alias("physical_namespace"),
        idn.connector_logical(F.col("connector")).alias("connector_logical"),
        idn.spark_job_logical(F.concat(F.lit("load_"), F.col("connector"))).alias("job_logical"),
    )


def q_jobs_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_by_namespace(_store(spark, sf_dir)["jobs"], "jobs")


def q_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    edges = graph.current_edge_ids(s["io_mapping"], s["job_versions"])
    return graph.graph_summary(s["datasets"], s["jobs"], edges)


def q_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    edges = graph.current_edges(s["datasets"], s["jobs"], s["job_versions"], s["io_mapping"], order=False, named=graph.diagram_node)
    return graph.export_edges(s["datasets"], s["jobs"], edges, identified=True)


def q_trace_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable from each region node."""
    e = d.tree_edges(spark, sf_dir)
    seeds = e.filter(F.col("src").startswith("region:")).select(F.col("src").alias("root")).distinct()
    return graph.reachable(e, seeds, "down")


def q_trace_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor of each order node."""
    e = d.tree_edges(spark, sf_dir)
    seeds = e.filter(F.col("dst").startswith("order:")).select(F.col("dst").alias("root"))
    return graph.reachable(e, seeds, "up")


def q_end_to_end_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.end_to_end_paths(d.tree_edges(spark, sf_dir), ["region", "nation", "customer", "order"])


def perturbed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed edges: order edges with ``o_orderkey % 10 = 0`` missing, and for
    ``o_orderkey % 20 = 0`` attributed to customer ``o_custkey + 1`` instead."""
    e = d.tree_edges(spark, sf_dir)
    o = d.table(spark, sf_dir, "orders")
    okey = F.regexp_extract(F.col("dst"), r"^order:(\d+)$", 1)
    kept = e.filter(~(F.col("dst").startswith("order:") & (okey.cast("bigint") % 10 == 0)))
    moved = o.filter(F.col("o_orderkey") % 20 == 0).select(
        F.concat(F.lit("customer:"), (F.col("o_custkey") + 1).cast("string")).alias("src"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst")
    )
    return kept.unionByName(moved)


def q_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.diff_edges(d.tree_edges(spark, sf_dir), perturbed_edges(spark, sf_dir))


# ------------------------------------------------------------------ runs -------------


def q_flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.flatten_events(d.run_events(spark, sf_dir))


def q_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.recent_events(d.run_events(spark, sf_dir), 5).select("seq", "run_id", "event_type", "event_time")


def q_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.run_state(d.run_events(spark, sf_dir), EVAL_TIME)


def q_parent_child_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.parent_child_runs(lev.runs(d.run_events(spark, sf_dir)))


def q_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.latest_attempt(lev.runs(d.run_events(spark, sf_dir)))


def q_run_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lev.run_of_record(lev.runs(d.run_events(spark, sf_dir)))


# ------------------------------------------------------------ column lineage ---------


def spark_runs(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Spark runs with their sink table / source topic (one row per run).

    ``materialize`` writes it once (reliable checkpoint) for queries that read it several
    times -- one aggregation over the events instead of one per reference.
    """
    ev = d.run_events(spark, sf_dir).filter(F.col("job_ns") == "spark")
    r = ev.groupBy("run_id").agg(F.max(F.col("outputs")[0]["name"]).alias("out_name"), F.max(F.col("inputs")[0]["name"]).alias("in_name"))
    r = r.withColumn("user_id", F.regexp_extract("run_id", r"^run-(\d+)$", 1).cast("bigint"))
    if materialize:
        scratch_root(spark)
        r = r.checkpoint()
    return r


def sink_tables(spark: SparkSession) -> list[str]:
    return [f"poc/shop_t{k}_json" for k in range(4)]


def mapping_registry(spark: SparkSession) -> DataFrame:
    """Mapping edges of every sink table (the declared projections), keyed by table."""
    mapping = loader.events_mapping("json")
    frames = [mapping_frame(spark, t, mapping) for t in sink_tables(spark)]
    return mapping_to_edges(reduce(DataFrame.unionByName, frames))


def table_columns(spark: SparkSession) -> DataFrame:
    cols = [r.out_col for r in loader.events_mapping("json")]
    rows = [(t, c) for t in sink_tables(spark) for c in cols]
    return spark.createDataFrame(rows, "out_table string, out_col string")


def observed_column_edges(spark: SparkSession, r: DataFrame) -> DataFrame:
    """Column edges as a listener reports them: mapping edges (the facet of runs with
    ``user_id % 6 = 4`` lacks ``status``) plus MERGE self-edges sink -> sink."""
    m = bounded_broadcast(mapping_registry(spark), MAX_MAPPING_ROWS)
    mapped = r.join(m, r["out_name"] == m["out_table"]).filter(~((F.col("user_id") % 6 == 4) & (F.col("out_col") == "status")))
    mapped = mapped.select(
        "run_id", F.lit(SINK_NS).alias("out_ns"), "out_name", "out_col", F.lit(TOPIC_NS).alias("in_ns"), "in_name", "in_col", "transformation", "precision"
    )
    cols = bounded_broadcast(table_columns(spark), MAX_MAPPING_ROWS)
    selfe = r.join(cols, r["out_name"] == cols["out_table"]).select(
        "run_id", F.lit(SINK_NS).alias("out_ns"), "out_name", "out_col", F.lit(SINK_NS).alias("in_ns"), F.col("out_name").alias("in_name"),
        F.col("out_col").alias("in_col"), F.lit("IDENTITY").alias("transformation"), F.lit("exact").alias("precision")
    )
    return mapped.unionByName(selfe)


def column_edges(spark: SparkSession, r: DataFrame) -> DataFrame:
    return audit.resolve_merge_edges(observed_column_edges(spark, r))


def q_column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_edges(spark, spark_runs(spark, sf_dir, materialize=True))


MYSQL_NS = "mysql://mysql:3306"


def _column_graph(ce: DataFrame) -> DataFrame:
    """Column nodes ``namespace|dataset|column``: the Spark hop of all runs (deduplicated) and the connector hop, which
    maps each topic column to the same column of the source table that the topic names.  Small after dedup; read every round."""
    spark_hop = ce.select(
        F.concat_ws("|", "in_ns", "in_name", "in_col").alias("src"), F.concat_ws("|", "out_ns", "out_name", "out_col").alias("dst")
    ).distinct()
    topic_cols = ce.select("in_ns", "in_name", "in_col").distinct()
    connector_hop = topic_cols.select(
        F.concat_ws("|", F.lit(MYSQL_NS), idn.mysql_dataset_name(F.col("in_name")), "in_col").alias("src"),
        F.concat_ws("|", "in_ns", "in_name", "in_col").alias("dst"),
    )
    scratch_root(ce.sparkSession)
    return spark_hop.unionByName(connector_hop).checkpoint()


def q_trace_columns_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace every sink column back through the topic to the source table column."""
    edges = _column_graph(column_edges(spark, spark_runs(spark, sf_dir, materialize=True)))
    seeds = edges.filter(F.col("dst").startswith(SINK_NS + "|")).select(F.col("dst").alias("root")).distinct()
    return graph.reachable(edges, seeds, "up")


def _reaching_columns(ce: DataFrame) -> DataFrame:
    """The columns that runs read and that go back to a source table column over any number of hops."""
    nodes = ce.select("in_ns", "in_name", "in_col", F.concat_ws("|", "in_ns", "in_name", "in_col").alias("root")).distinct()
    up = graph.reachable(_column_graph(ce), nodes.select("root"), "up")
    return nodes.join(up.filter(F.col("node").startswith(MYSQL_NS + "|")).select("root").distinct(), "root").drop("root")


def _schema_cols(spark: SparkSession, r: DataFrame) -> DataFrame:
    cols = bounded_broadcast(table_columns(spark), MAX_MAPPING_ROWS)
    return r.join(cols, r["out_name"] == cols["out_table"]).select("run_id", "out_col")


def q_untraced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark_runs(spark, sf_dir, materialize=True)
    ce = column_edges(spark, r)
    return audit.untraced_columns(_schema_cols(spark, r), ce, _reaching_columns(ce))


def _opaque(u):
    """Runs that decode their topic in an opaque function: ``user_id % 7 = 3``."""
    return u % 7 == 3


def hop_facets(r: DataFrame) -> DataFrame:
    """Precision facets reported per hop: the connector hop only for ``user_id % 4 = 0``;
    the sink hop is missing for ``user_id % 9 = 8`` and ``lost`` where a column is untraced.  Opaque runs claim ``exact`` too."""
    u = F.col("user_id")
    hop = lambda name, precision: F.struct(F.lit(name).alias("hop"), precision.alias("precision"))
    exact = F.lit("exact")
    rows = F.array(
        F.when(u % 4 == 0, hop(audit.HOPS[0], exact)),
        F.when(_opaque(u), hop(audit.HOPS[2], exact)).otherwise(hop(audit.HOPS[1], exact)),
        F.when(u % 9 != 8, hop(audit.HOPS[3], F.when(u % 6 == 4, F.lit("lost")).otherwise(exact))),
    )
    return r.select("run_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f")).select("run_id", "f.hop", "f.precision")


def _hops(r: DataFrame) -> DataFrame:
    """The hops of a run: from the source, into the job (declared or opaque), to the sink, and from its orchestrator."""
    source, declared, opaque, sink, orchestrator = map(F.lit, audit.HOPS)
    return r.select("run_id", F.explode(F.array(source, F.when(_opaque(F.col("user_id")), opaque).otherwise(declared), sink, orchestrator)).alias("hop"))


def q_hop_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark_runs(spark, sf_dir, materialize=True)
    return audit.hop_precision(_hops(r), hop_facets(r))


def q_path_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.path_precision(q_hop_precision(spark, sf_dir))


def q_overclaimed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs claiming ``exact`` (``user_id`` even) whose facet misses table columns."""
    r = spark_runs(spark, sf_dir, materialize=True)
    claims = r.select("run_id", F.when(F.col("user_id") % 2 == 0, F.lit("exact")).otherwise(F.lit("inferred")).alias("claimed_precision"))
    ce = column_edges(spark, r)
    return audit.overclaimed_runs(claims, _schema_cols(spark, r), ce, _reaching_columns(ce))


# ------------------------------------------------------------------ markers ----------


def q_missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_markers(spark_runs(spark, sf_dir), d.markers(spark, sf_dir))


def q_complete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.complete_paths(spark_runs(spark, sf_dir, materialize=True), d.markers(spark, sf_dir), d.run_events(spark, sf_dir))


# --------------------------------------------------------------- identities ----------


def q_ambiguous_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ambiguous_identities(_store(spark, sf_dir)["datasets"])


def q_misattributed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    edges = graph.current_edge_ids(s["io_mapping"], s["job_versions"])
    return audit.misattributed_edges(edges, s["jobs"], s["datasets"], d.job_outlets(spark, sf_dir))


def q_jobs_without_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return audit.jobs_without_io(s["jobs"], graph.current_edge_ids(s["io_mapping"], s["job_versions"]))


def q_identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors (one per customer segment) emitting under ``mysql:{nation}``."""
    c = d.table(spark, sf_dir, "customer")
    conn = c.select(
        F.format_string("%s:%s", F.lit("mysql"), F.col("c_nationkey").cast("string")).alias("emitter_key"),
        F.concat(F.lit("shop-"), F.lower("c_mktsegment")).alias("connector"),
    )
    return audit.identity_collisions(conn)


def q_declared_vs_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared inlet/outlet URIs of each Spark job vs the datasets its runs reported."""
    obs = lev.flatten_events(d.run_events(spark, sf_dir)).select("job_name", "io_type", "namespace", "name")
    jobs = obs.select("job_name").distinct()
    k = F.regexp_extract("job_name", r"^load_t(\d+)$", 1)
    declared = jobs.select(
        "job_name",
        F.explode(
            F.array(
                F.struct(F.lit("INPUT").alias("io_type"), F.concat(F.lit(TOPIC_NS + "/mysqljson.shop.t"), k).alias("uri")),
                F.struct(F.lit("OUTPUT").alias("io_type"), F.concat(F.lit(SINK_NS + "/poc/shop_t"), k, F.lit("_json")).alias("uri")),
            )
        ).alias("x"),
    ).select("job_name", "x.io_type", "x.uri")
    return audit.declared_vs_observed(declared, obs)


# --------------------------------------------------------- schema evolution ----------


def _used_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of the schema ids that occur in the log.

    The result has at most one row per schema version but is read several times by the
    field-level audits, so it is materialised once (reliable checkpoint) instead of
    re-scanning the log per reference.
    """
    scratch_root(spark)
    ids = split_confluent(d.events_avro_log(spark, sf_dir)).select("schema_id").where(F.col("schema_id").isNotNull()).distinct()
    return d.registry(spark).join(ids, "schema_id").checkpoint()


def q_after_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.after_fields(_used_schemas(spark, sf_dir)).drop("field_type")


def q_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.schema_changes(audit.after_fields(_used_schemas(spark, sf_dir))).withColumnRenamed("change", "change_kind")


def q_ts_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = d.events_log(spark, sf_dir)
    from ..operators.decode import decode_json, flatten_envelope, keep_decoded
    from ..functions.timeprec import precision_class

    flat = keep_decoded(flatten_envelope(decode_json(parsed, d.EVENTS_AFTER_DDL, with_source=True), keep=("source",)), lambda r: r["source"].isNotNull())
    return audit.ts_precision(flat.select("op", precision_class(F.col("source.ts_us")).alias("precision")))


def q_commits_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = d.run_events(spark, sf_dir)
    windows = ev.filter(F.col("event_type") == "RUNNING").groupBy("run_id").agg(F.min("event_time").alias("w0"), F.max("event_time").alias("w1"))
    return audit.commits_in_window(d.snapshots(spark, sf_dir), windows)


def q_dataset_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MySQL table -> Kafka topic -> Spark run -> sink table, composed from identity joins:
    MySQL <-> Kafka on the ``{db}.{table}`` embedded in the topic, Kafka <-> Spark on the
    input dataset identity, Spark <-> sink through the storage -> physical -> logical map."""
    ev = d.table(spark, sf_dir, "events")
    mysql = ev.groupBy((F.col("user_id") % 4).alias("k")).agg(F.count(F.lit(1)).alias("source_rows")).select(
        F.concat(F.lit("shop.t"), F.col("k").cast("string")).alias("mysql_name"), "source_rows"
    )
    io = lev.flatten_events(d.run_events(spark, sf_dir)).select("run_id", "job_name", "io_type", "namespace", "name").distinct()
    inputs = io.filter(F.col("io_type") == "INPUT").select("run_id", "job_name", F.col("namespace").alias("topic_ns"), F.col("name").alias("topic"))
    outputs = io.filter(F.col("io_type") == "OUTPUT").select("run_id", F.col("namespace").alias("sink_ns"), F.col("name").alias("sink_storage"))
    topics = inputs.select("topic_ns", "topic").distinct().withColumn("mysql_name", idn.mysql_dataset_name(F.col("topic")))
    # topics are few and each carries many runs: the topic side is sized at runtime by
    # adaptive execution (broadcast when small, skew-join splitting otherwise)
    src = mysql.join(topics, "mysql_name")
    chain = inputs.join(src, ["topic_ns", "topic"]).join(outputs, "run_id")
    physical = F.regexp_replace(F.col("sink_storage"), "^poc/", "")
    return chain.select(
        "run_id", "job_name", "mysql_name", "source_rows", "topic", "sink_storage",
        F.concat(F.lit(idn.sink_physical_namespace() + "."), physical).alias("sink_physical"), F.concat(F.lit("poc."), physical).alias("sink_logical"),
    )


QUERIES = {
    "dataset_chain": q_dataset_chain,
    "current_edges": q_current_edges,
    "datasets_by_namespace": q_datasets_by_namespace,
    "jobs_by_namespace": q_jobs_by_namespace,
    "graph_summary": q_graph_summary,
    "export_edges": q_export_edges,
    "trace_downstream": q_trace_downstream,
    "trace_upstream": q_trace_upstream,
    "trace_columns_upstream": q_trace_columns_upstream,
    "end_to_end_paths": q_end_to_end_paths,
    "diff_edges": q_diff_edges,
    "flatten_events": q_flatten_events,
    "recent_events": q_recent_events,
    "run_state": q_run_state,
    "parent_child_runs": q_parent_child_runs,
    "latest_attempt": q_latest_attempt,
    "run_of_record": q_run_of_record,
    "column_edges": q_column_edges,
    "untraced_columns": q_untraced_columns,
    "dataset_listing": q_dataset_listing,
    "connector_identity": q_connector_identity,
    "hop_precision": q_hop_precision,
    "path_precision": q_path_precision,
    "overclaimed_runs": q_overclaimed_runs,
    "missing_markers": q_missing_markers,
    "complete_paths": q_complete_paths,
    "ambiguous_identities": q_ambiguous_identities,
    "misattributed_edges": q_misattributed_edges,
    "jobs_without_io": q_jobs_without_io,
    "identity_collisions": q_identity_collisions,
    "declared_vs_observed": q_declared_vs_observed,
    "after_fields": q_after_fields,
    "schema_changes": q_schema_changes,
    "ts_precision": q_ts_precision,
    "commits_in_window": q_commits_in_window,
}
