"""Lineage graph, audits and identity rules."""

import json

from pyspark.sql import functions as F

from lakeshift.functions import identity as idn
from lakeshift.lineage import audit, events as lev, graph


def test_reachable_equals_recursive_cte_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",)], "root string")
    got = {(r["root"], r["node"]) for r in graph.reachable(edges, seeds).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "a"), ("a", "d"), ("x", "y")}
    up = {(r["root"], r["node"]) for r in graph.reachable(edges, spark.createDataFrame([("d",)], "root string"), "up").collect()}
    assert up == {("d", "c"), ("d", "b"), ("d", "a")}


def test_reachable_equals_recursive_cte_on_dag(spark):
    # Spark's recursive CTE accepts UNION ALL only, so the comparison uses an acyclic graph
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",)], "root string")
    got = {(r["root"], r["node"]) for r in graph.reachable(edges, seeds).collect()}
    edges.createOrReplaceTempView("g_edges")
    cte = spark.sql(
        "WITH RECURSIVE r(root, node) AS (SELECT src, dst FROM g_edges WHERE src IN ('a', 'x') "
        "UNION ALL SELECT r.root, e.dst FROM r JOIN g_edges e ON e.src = r.node) SELECT DISTINCT * FROM r"
    )
    assert {(r[0], r[1]) for r in cte.collect()} == got


def test_export_sanitises_and_escapes(spark):
    ds = spark.createDataFrame([("d1", "kafka://k:9092", "a|b[c]")], "uuid string, namespace_name string, name string")
    jobs = spark.createDataFrame([("j1", "spark", "load.x")], "uuid string, namespace_name string, name string")
    edges = spark.createDataFrame([("spark:load.x", "kafka://k:9092:a|b[c]", "INPUT")], "job string, dataset string, io_type string")
    lines = {r["line"] for r in graph.export_edges(ds, jobs, edges).collect()}
    assert 'D_kafka___k_9092_a_b_c_["a\\|b\\[c\\]"]' in lines
    assert "subgraph DS_kafka___k_9092[\"kafka://k:9092\"]" in lines
    assert "D_kafka___k_9092_a_b_c_ -->|INPUT| J_spark_load_x" in lines


def test_weakest_precision(spark):
    hops = spark.createDataFrame([("r1", "h1"), ("r1", "h2"), ("r2", "h1")], "run_id string, hop string")
    facets = spark.createDataFrame([("r1", "h1", "exact"), ("r1", "h2", "lost"), ("r2", "h1", "exact")], "run_id string, hop string, precision string")
    p = {r["run_id"]: r["precision"] for r in audit.path_precision(audit.hop_precision(hops, facets)).collect()}
    assert p == {"r1": "lost", "r2": "exact"}
    only = spark.createDataFrame([("r3", "h1")], "run_id string, hop string")
    assert audit.hop_precision(only, facets).first()["precision"] == "inferred"


def test_schema_changes_breaking(spark):
    def schema(fields):
        return json.dumps({"type": "record", "name": "Envelope", "fields": [
            {"name": "before", "type": ["null", {"type": "record", "name": "Value", "fields": fields}]},
            {"name": "after", "type": ["null", "Value"]}, {"name": "op", "type": "string"}]})
    v1 = [{"name": "id", "type": "int"}, {"name": "a", "type": "string"}, {"name": "b", "type": "int"}]
    v2 = [{"name": "id", "type": "long"}, {"name": "a", "type": "string"}, {"name": "c", "type": ["null", "string"]}]
    reg = spark.createDataFrame([(1, "s-value", 1, schema(v1)), (2, "s-value", 2, schema(v2))], "schema_id int, subject string, version int, schema string")
    fields = audit.after_fields(reg)
    assert fields.filter("schema_id = 2 AND field_name = 'c'").first()["nullable"]
    ch = {(r["field_name"], r["change"], r["breaking"]) for r in audit.schema_changes(fields).collect()}
    assert ch == {("id", "type_changed", True), ("b", "removed", True), ("c", "added", False)}


def test_run_state_and_attempts(spark):
    ev = spark.createDataFrame(
        [
            ("2024-01-01 00:00:00", 1, "START", "p1", None, "airflow", "dag", {"run_type": "scheduled"}),
            ("2024-01-01 00:00:01", 2, "START", "c1", "p1", "spark", "load", {"run_type": "scheduled"}),
            ("2024-01-01 00:00:02", 3, "FAIL", "c1", "p1", "spark", "load", {"run_type": "scheduled"}),
            ("2024-01-01 00:00:03", 4, "START", "c2", "p1", "spark", "load", {"run_type": "scheduled"}),
            ("2024-01-01 00:00:04", 5, "RUNNING", "c2", "p1", "spark", "load", {"run_type": "scheduled"}),
        ],
        "event_time string, seq bigint, event_type string, run_id string, parent_run_id string, job_ns string, job_name string, facets map<string,string>",
    ).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    st = {r["run_id"]: (r["state"], r["stale"]) for r in lev.run_state(ev, "2024-01-03 00:00:00").collect()}
    assert st == {"p1": ("START", True), "c1": ("FAIL", False), "c2": ("RUNNING", True)}
    la = lev.latest_attempt(lev.runs(ev)).first()
    assert (la["latest_run_id"], la["attempts"]) == ("c2", 2)


def test_identity_rules(spark):
    df = spark.createDataFrame([("mysqljson.shop.orders", "kafka://kafka:9092/mysql.shop.orders", "poc/shop_orders_26e0e822-3a32-4bb5-b962-9e263a3b0770", "a=1,b=2")], "t string, u string, s string, tags string")
    r = df.select(
        idn.mysql_dataset_name("t").alias("ds"), idn.sink_logical_name(F.lit("poc"), "t").alias("sink"), idn.subject_to_topic(idn.topic_to_subject("t")).alias("rt"),
        idn.uri_namespace("u").alias("ns"), idn.uri_name("u").alias("nm"), idn.storage_to_logical("s").alias("lg"), idn.tags_to_map("tags").alias("m"),
    ).first()
    assert (r["ds"], r["sink"], r["rt"]) == ("shop.orders", "poc.shop_orders_json", "mysqljson.shop.orders")
    assert (r["ns"], r["nm"], r["lg"]) == ("kafka://kafka:9092", "mysql.shop.orders", "poc/shop_orders")
    assert r["m"] == {"a": "1", "b": "2"}


def test_tab_export_and_diagram_text(spark, scratch):
    from lakeshift.sources.lineage_store import read_tab_export

    path = f"{scratch}/export"
    spark.createDataFrame([("spark:load\tkafka://k:mysql.shop.t\tINPUT",), ("a:b\tc:d\tOUT\tPUT",)], "value string").coalesce(1).write.text(path)
    rows = read_tab_export(spark, path, ["job", "dataset", "io_type"]).collect()
    assert sorted(r["io_type"] for r in rows) == ["INPUT", "OUT\tPUT"]  # limit keeps the tail
    ds = spark.createDataFrame([("d1", "ns", "x")], "uuid string, namespace_name string, name string")
    jb = spark.createDataFrame([("j1", "spark", "y")], "uuid string, namespace_name string, name string")
    ed = spark.createDataFrame([("spark:y", "ns:x", "OUTPUT")], "job string, dataset string, io_type string")
    graph.write_diagram(graph.export_edges(ds, jb, ed), f"{scratch}/diagram")
    import glob

    text = [ln.rstrip("\n") for f in sorted(glob.glob(f"{scratch}/diagram/part-*")) for ln in open(f)]
    assert text == ["graph LR", 'subgraph DS_ns["ns"]', 'D_ns_x["x"]', "end", 'subgraph JB_spark["jobs: spark"]', 'J_spark_y["y"]', "end", "J_spark_y -->|OUTPUT| D_ns_x"]


def test_emit_events_appends(spark, scratch):
    from lakeshift.sources import derived as d

    ev = d.run_events(spark, "/root/testdata/sf0.001")
    lev.emit_events(ev, f"{scratch}/events")
    lev.emit_events(ev, f"{scratch}/events")
    back = spark.read.parquet(f"{scratch}/events")
    assert back.count() == 2 * ev.count() and "event_date" in back.columns


def test_closure_has_no_round_limit_and_versions_may_skip(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(25)], "src string, dst string")
    assert graph.reachable(chain, spark.createDataFrame([("n00",)], "root string")).count() == 25
    fields = spark.createDataFrame([("s", 1, "a", "int"), ("s", 3, "a", "long"), ("s", 7, "a", "long"), ("s", 7, "b", "int")], "subject string, version int, field_name string, field_type string")
    got = sorted(tuple(r) for r in audit.schema_changes(fields).collect())
    assert got == [("s", 1, 3, "a", "type_changed", True), ("s", 3, 7, "b", "added", False)]


def test_event_documents(spark):
    docs = [
        '{"eventTime":"2024-01-01T00:00:00","eventType":"COMPLETE","run":{"runId":"r1","facets":{"parent":{"run":{"runId":"p"}}}},"job":{"namespace":"s","name":"j"},"inputs":[{"namespace":"k","name":"t"}],"outputs":[{"namespace":"w","name":"x"}]}',
        '{"eventType":"START","run":{"runId":"r2"},"job":{"namespace":"s","name":"j"}}',
    ]
    ev = lev.parse_events(spark.createDataFrame([(x,) for x in docs], "value string"))
    assert {tuple(r) for r in lev.flatten_events(ev).collect()} == {("r1", "s", "j", "INPUT", "k", "t"), ("r1", "s", "j", "OUTPUT", "w", "x")}
    assert lev.event_jobs(ev).count() == 1 and lev.event_datasets(ev).count() == 2
    plan = lev.flatten_events(ev)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan


def test_untraced_by_reach(spark):
    cols = spark.createDataFrame([("r", c) for c in "abc"], "run_id string, out_col string")
    edges = spark.createDataFrame([("r", "a", "n", "t", "x"), ("r", "b", "n", "t", "y")], "run_id string, out_col string, in_ns string, in_name string, in_col string")
    reaching = spark.createDataFrame([("n", "t", "x")], "in_ns string, in_name string, in_col string")
    got = {tuple(r) for r in audit.untraced_columns(cols, edges, reaching).collect()}
    assert got == {("r", "b", "inferred"), ("r", "c", "lost")}


def test_a_complete_path_needs_its_chain_in_one_deployment(spark):
    io = "array<struct<ns:string,name:string>>"
    topic, plain, sink = [("k", "p.db.t")], [("k", "t")], [("s", "x")]
    rows = [
        ("ok", "i", 1, topic, []), ("ok", "i", 1, [], sink), ("two", "i", 1, topic, sink), ("two", "i", 2, topic, sink),
        ("no sink", "i", 1, topic, []), ("no topic", "i", 1, plain, sink), ("null", "i", 1, None, None),
    ]
    ev = spark.createDataFrame(rows, f"run_id string, instance_id string, stack_epoch int, inputs {io}, outputs {io}")
    ids = ev.select("run_id").distinct()
    marks = ids.crossJoin(spark.createDataFrame([(k,) for k in audit.REQUIRED_MARKERS], "marker_kind string"))
    assert [r["run_id"] for r in audit.complete_paths(ids, marks, ev).collect()] == ["ok"]


def test_diagram_identifiers_are_made_once_per_node(spark):
    ds = spark.createDataFrame([("d1", "s3://a-b", "x/y"), ("d2", "s3://a-b", "z|"), ("d2", "n", None)], "uuid string, namespace_name string, name string")
    jobs = spark.createDataFrame([("j1", "spark.a", "load-1"), ("j2", "spark.b", "load 2")], "uuid string, namespace_name string, name string")
    versions = spark.createDataFrame([("v1", "j1"), ("v2", "j2"), ("v2", "j2"), (None, "j1")], "uuid string, job_uuid string")
    io = spark.createDataFrame([("v1", "d1", "INPUT", True), ("v2", "d2", "OUTPUT", True), ("v1", "d2", "INPUT", False), (None, "d1", "INPUT", True)], "job_version_uuid string, dataset_uuid string, io_type string, is_current_job_version boolean")
    plain = graph.export_edges(ds, jobs, graph.current_edges(ds, jobs, versions, io, order=False))
    once = graph.export_edges(ds, jobs, graph.current_edges(ds, jobs, versions, io, order=False, named=graph.diagram_node), identified=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect())) and once.filter("section = 'edge'").count() == 5
