"""DuckDB oracle SQL for the lineage queries (derivation rules of sources/derived.py in SQL)."""

from __future__ import annotations


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


STORE = f"""
ds AS (
  SELECT 'part-' || {_s('p_partkey')} AS uuid, 'kafka://broker-' || {_s('p_size % 3')} AS namespace_name, p_name AS name FROM part
  UNION ALL
  SELECT 'part-dup-' || {_s('p_partkey')}, 'kafka://broker-' || {_s('p_size % 3')}, p_name FROM part WHERE p_partkey % 97 = 0
  UNION ALL
  SELECT 'supp-' || {_s('s_suppkey')}, 's3://warehouse-' || {_s('s_nationkey % 4')}, 'poc/' || s_name FROM supplier),
jb AS (SELECT 'job-' || {_s('c_custkey')} AS uuid, 'spark.' || lower(c_mktsegment) AS namespace_name, c_name AS name FROM customer),
jv AS (SELECT 'jv-' || {_s('o_orderkey')} AS uuid, 'job-' || {_s('o_custkey')} AS job_uuid FROM orders),
io AS (
  SELECT 'jv-' || {_s('l_orderkey')} AS job_version_uuid,
         CASE WHEN l_linenumber % 2 = 1 THEN 'part-' || {_s('l_partkey')} ELSE 'supp-' || {_s('l_suppkey')} END AS dataset_uuid,
         CASE WHEN l_linenumber % 2 = 1 THEN 'INPUT' ELSE 'OUTPUT' END AS io_type,
         l_linestatus = 'O' AS is_current_job_version
  FROM lineitem),
e AS (SELECT jv.job_uuid, io.dataset_uuid, io.io_type FROM io JOIN jv ON io.job_version_uuid = jv.uuid WHERE io.is_current_job_version)"""

EDGES = f"""
tree AS (
  SELECT 'region:' || {_s('n_regionkey')} AS src, 'nation:' || {_s('n_nationkey')} AS dst FROM nation
  UNION ALL SELECT 'nation:' || {_s('c_nationkey')}, 'customer:' || {_s('c_custkey')} FROM customer
  UNION ALL SELECT 'customer:' || {_s('o_custkey')}, 'order:' || {_s('o_orderkey')} FROM orders)"""

RUNEV = f"""
rev AS (
  SELECT ts AS event_time, event_id AS seq, user_id,
         CASE event_type WHEN 'signup' THEN 'START' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING'
                         WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' END AS event_type,
         'run-' || {_s('user_id')} AS run_id,
         CASE WHEN user_id % 10 <> 0 THEN 'run-' || {_s('user_id - user_id % 10')} END AS parent_run_id,
         CASE WHEN user_id % 10 = 0 THEN 'airflow' ELSE 'spark' END AS job_ns,
         CASE WHEN user_id % 10 = 0 THEN 'dag_t' ELSE 'load_t' END || {_s('user_id % 4')} AS job_name,
         CASE user_id % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'manual' ELSE 'backfill' END AS run_type,
         'inst-' || {_s('user_id % 2')} AS instance_id,
         CASE WHEN user_id % 13 = 0 AND event_id % 2 = 0 THEN 2 ELSE 1 END AS stack_epoch
  FROM events),
runs AS (
  SELECT run_id, MAX(parent_run_id) AS parent_run_id, MAX(job_ns) AS job_ns, MAX(job_name) AS job_name,
         MAX(run_type) AS run_type, MIN(event_time) AS started_at
  FROM rev GROUP BY run_id)"""

SRUNS = f"""
sr AS (SELECT DISTINCT user_id, 'run-' || {_s('user_id')} AS run_id, {_s('user_id % 4')} AS k FROM events WHERE user_id % 10 <> 0)"""

MAPPING = """
m(out_col, in_col, transformation) AS (VALUES
  ('user_id', 'user_id', 'IDENTITY'), ('quantity', 'quantity', 'IDENTITY'), ('unit_price', 'unit_price', 'IDENTITY'),
  ('total_price', 'quantity', 'TRANSFORMATION'), ('total_price', 'unit_price', 'TRANSFORMATION'),
  ('status', 'status', 'IDENTITY'), ('created_at', 'created_at', 'IDENTITY'), ('updated_at', 'updated_at', 'IDENTITY'))"""

HOPF = SRUNS + """,
hp AS (
  SELECT run_id, 'source->topic' AS hop, CASE WHEN user_id % 4 = 0 THEN 'exact' ELSE 'inferred' END AS precision FROM sr
  UNION ALL SELECT run_id, CASE WHEN user_id % 7 = 3 THEN 'topic->job (opaque)' ELSE 'topic->job' END, CASE WHEN user_id % 7 = 3 THEN 'inferred' ELSE 'exact' END FROM sr
  UNION ALL SELECT run_id, 'job->sink', CASE WHEN user_id % 9 = 8 THEN 'inferred' WHEN user_id % 6 = 4 THEN 'lost' ELSE 'exact' END FROM sr
  UNION ALL SELECT run_id, 'orchestrator->job', 'n/a' FROM sr)"""

MARKERS = SRUNS + """,
per AS (SELECT user_id, MAX(CASE WHEN event_type = 'purchase' THEN 1 END) AS has_p FROM events WHERE user_id % 10 <> 0 GROUP BY user_id),
mm AS (
  SELECT run_id, 'binlog' AS marker_kind FROM sr WHERE user_id % 5 = 1
  UNION ALL SELECT run_id, 'kafka_offset' FROM sr WHERE user_id % 7 = 2
  UNION ALL SELECT 'run-' || CAST(user_id AS VARCHAR), 'snapshot_id' FROM per WHERE has_p IS NULL)"""

SQL = {
    "dataset_chain": f"""
WITH m AS (SELECT 'shop.t' || {_s('user_id % 4')} AS mysql_name, COUNT(*) AS source_rows FROM events GROUP BY user_id % 4),
r AS (SELECT DISTINCT 'run-' || {_s('user_id')} AS run_id, 'load_t' || {_s('user_id % 4')} AS job_name, {_s('user_id % 4')} AS k
      FROM events WHERE user_id % 10 <> 0)
SELECT r.run_id, r.job_name, m.mysql_name, m.source_rows, 'mysqljson.shop.t' || r.k AS topic,
       'poc/shop_t' || r.k || '_json' AS sink_storage, 'nessie.poc.shop_t' || r.k || '_json' AS sink_physical,
       'poc.shop_t' || r.k || '_json' AS sink_logical
FROM r JOIN m ON m.mysql_name = 'shop.t' || r.k""",
    "current_edges": "WITH " + STORE + """
SELECT jb.namespace_name || ':' || jb.name AS job, ds.namespace_name || ':' || ds.name AS dataset, e.io_type
FROM e JOIN jb ON e.job_uuid = jb.uuid JOIN ds ON e.dataset_uuid = ds.uuid""",
    "datasets_by_namespace": "WITH " + STORE + "\nSELECT namespace_name AS namespace, COUNT(*) AS datasets FROM ds GROUP BY 1",
    "jobs_by_namespace": "WITH " + STORE + "\nSELECT namespace_name AS namespace, COUNT(*) AS jobs FROM jb GROUP BY 1",
    "graph_summary": "WITH " + STORE + """
SELECT 'datasets' AS kind, COUNT(*) AS total FROM ds
UNION ALL SELECT 'jobs', COUNT(*) FROM jb
UNION ALL SELECT 'current_edges', COUNT(*) FROM e""",
    "export_edges": "WITH " + STORE + """,
x AS (
  SELECT jb.namespace_name || ':' || jb.name AS job, ds.namespace_name || ':' || ds.name AS dataset, e.io_type
  FROM e JOIN jb ON e.job_uuid = jb.uuid JOIN ds ON e.dataset_uuid = ds.uuid)
SELECT 'header' AS section, '' AS grp, 'graph LR' AS line
UNION ALL
SELECT 'group', 'DS_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'subgraph ' || 'DS_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(replace(replace(replace(namespace_name, '"', ''), '|', '\\|'), '[', '\\['), ']', '\\]') || '"]' FROM (SELECT DISTINCT namespace_name FROM ds)
UNION ALL
SELECT 'dataset', 'DS_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'D_' || regexp_replace(namespace_name || '/' || name, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(replace(replace(replace(name, '"', ''), '|', '\\|'), '[', '\\['), ']', '\\]') || '"]' FROM ds
UNION ALL
SELECT 'end', 'DS_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'end' FROM (SELECT DISTINCT namespace_name FROM ds)
UNION ALL
SELECT 'group', 'JB_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'subgraph ' || 'JB_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g') || '["jobs: ' || replace(replace(replace(replace(namespace_name, '"', ''), '|', '\\|'), '[', '\\['), ']', '\\]') || '"]' FROM (SELECT DISTINCT namespace_name FROM jb)
UNION ALL
SELECT 'job', 'JB_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'J_' || regexp_replace(namespace_name || '/' || name, '[^A-Za-z0-9_]', '_', 'g') || '["' || replace(replace(replace(replace(name, '"', ''), '|', '\\|'), '[', '\\['), ']', '\\]') || '"]' FROM jb
UNION ALL
SELECT 'end', 'JB_' || regexp_replace(namespace_name, '[^A-Za-z0-9_]', '_', 'g'), 'end' FROM (SELECT DISTINCT namespace_name FROM jb)
UNION ALL
SELECT 'edge', '', CASE WHEN io_type = 'INPUT'
         THEN 'D_' || regexp_replace(dataset, '[^A-Za-z0-9_]', '_', 'g') || ' -->|INPUT| J_' || regexp_replace(job, '[^A-Za-z0-9_]', '_', 'g')
         ELSE 'J_' || regexp_replace(job, '[^A-Za-z0-9_]', '_', 'g') || ' -->|OUTPUT| D_' || regexp_replace(dataset, '[^A-Za-z0-9_]', '_', 'g') END
FROM x""",
    "trace_downstream": "WITH RECURSIVE " + EDGES + """,
r(root, node, depth) AS (
  SELECT src, dst, 1 FROM tree WHERE src LIKE 'region:%'
  UNION ALL
  SELECT r.root, tree.dst, r.depth + 1 FROM r JOIN tree ON tree.src = r.node)
SELECT DISTINCT root, node, depth FROM r""",
    "trace_upstream": "WITH RECURSIVE " + EDGES + """,
r(root, node, depth) AS (
  SELECT dst, src, 1 FROM tree WHERE dst LIKE 'order:%'
  UNION ALL
  SELECT r.root, tree.src, r.depth + 1 FROM r JOIN tree ON tree.dst = r.node)
SELECT root, node, depth FROM r""",
    "end_to_end_paths": "WITH " + EDGES + """
SELECT a.src AS region, a.dst AS nation, b.dst AS customer, c.dst AS "order",
       a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst AS path
FROM tree a JOIN tree b ON b.src = a.dst JOIN tree c ON c.src = b.dst
WHERE a.src LIKE 'region:%' AND b.dst LIKE 'customer:%' AND c.dst LIKE 'order:%'""",
    "diff_edges": f"""
SELECT 'customer:' || {_s('o_custkey')} AS src, 'order:' || {_s('o_orderkey')} AS dst, 'expected_only' AS status
FROM orders WHERE o_orderkey % 10 = 0
UNION ALL
SELECT 'customer:' || {_s('o_custkey + 1')}, 'order:' || {_s('o_orderkey')}, 'actual_only' FROM orders WHERE o_orderkey % 20 = 0""",
    "flatten_events": "WITH " + RUNEV + """
SELECT run_id, seq, job_ns, job_name, 'INPUT' AS io_type, 'kafka://kafka:9092' AS namespace,
       'mysqljson.shop.t' || CAST(user_id % 4 AS VARCHAR) AS name FROM rev WHERE user_id % 10 <> 0
UNION ALL
SELECT run_id, seq, job_ns, job_name, 'OUTPUT', 's3://poc-warehouse', 'poc/shop_t' || CAST(user_id % 4 AS VARCHAR) || '_json'
FROM rev WHERE user_id % 10 <> 0""",
    "recent_events": "WITH " + RUNEV + """
SELECT seq, run_id, event_type, event_time FROM rev ORDER BY event_time DESC, seq DESC LIMIT 5""",
    "run_state": "WITH " + RUNEV + """,
a AS (
  SELECT run_id, arg_max(event_type, seq) AS state,
         MIN(CASE WHEN event_type = 'START' THEN event_time END) AS started_at,
         MAX(CASE WHEN event_type IN ('COMPLETE', 'FAIL') THEN event_time END) AS ended_at,
         MAX(event_time) AS last_event_at
  FROM rev GROUP BY run_id)
SELECT *, state IN ('START', 'RUNNING') AND last_event_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY AS stale FROM a""",
    "stream_run_state": "WITH " + RUNEV + """,
a AS (
  SELECT run_id, arg_max(event_type, struct_pack(t := event_time, s := seq)) AS state,
         MIN(CASE WHEN event_type = 'START' THEN event_time END) AS started_at,
         MAX(CASE WHEN event_type IN ('COMPLETE', 'FAIL') THEN event_time END) AS ended_at,
         MAX(event_time) AS last_event_at
  FROM rev GROUP BY run_id)
SELECT *, state IN ('START', 'RUNNING') AND last_event_at < (SELECT MAX(event_time) FROM rev) - INTERVAL 1 DAY AS stale FROM a""",
    "parent_child_runs": "WITH " + RUNEV + """
SELECT c.run_id, c.job_name, c.parent_run_id, p.job_name AS parent_job_name, p.job_ns AS parent_job_ns
FROM runs c LEFT JOIN runs p ON c.parent_run_id = p.run_id WHERE c.parent_run_id IS NOT NULL""",
    "latest_attempt": "WITH " + RUNEV + """
SELECT parent_run_id, job_ns, job_name, latest_run_id, attempts FROM (
  SELECT parent_run_id, job_ns, job_name, run_id AS latest_run_id, COUNT(*) OVER (PARTITION BY parent_run_id, job_ns, job_name) AS attempts,
         row_number() OVER (PARTITION BY parent_run_id, job_ns, job_name ORDER BY started_at DESC, run_id DESC) AS rn
  FROM runs WHERE parent_run_id IS NOT NULL) WHERE rn = 1""",
    "run_of_record": "WITH " + RUNEV + """,
rr AS (
  SELECT run_id, job_name, CASE run_type WHEN 'backfill' THEN DATE '2024-01-01' + CAST(CAST(substr(run_id, 5) AS BIGINT) % 20 AS INTEGER) ELSE CAST(started_at AS DATE) END AS logical_date, run_type, started_at,
         CASE run_type WHEN 'scheduled' THEN 0 WHEN 'manual' THEN 1 WHEN 'backfill' THEN 2 ELSE 99 END AS rk
  FROM runs)
SELECT run_id, job_name, logical_date, run_type,
       row_number() OVER (PARTITION BY job_name, logical_date ORDER BY rk ASC, started_at DESC, run_id DESC) = 1 AS is_run_of_record
FROM rr""",
    "column_edges": "WITH " + SRUNS + ", " + MAPPING + """
SELECT run_id, 's3://poc-warehouse' AS out_ns, 'poc/shop_t' || k || '_json' AS out_name, out_col,
       'kafka://kafka:9092' AS in_ns, 'mysqljson.shop.t' || k AS in_name, in_col, transformation, 'exact' AS precision
FROM sr CROSS JOIN m WHERE NOT (user_id % 6 = 4 AND out_col = 'status')""",
    "trace_columns_upstream": "WITH RECURSIVE " + SRUNS + ", " + MAPPING + """,
ce AS (
  SELECT DISTINCT 'kafka://kafka:9092|mysqljson.shop.t' || k || '|' || in_col AS src,
         's3://poc-warehouse|poc/shop_t' || k || '_json|' || out_col AS dst, k, in_col
  FROM sr CROSS JOIN m WHERE NOT (user_id % 6 = 4 AND out_col = 'status')),
e AS (
  SELECT src, dst FROM ce
  UNION
  SELECT 'mysql://mysql:3306|shop.t' || k || '|' || in_col, 'kafka://kafka:9092|mysqljson.shop.t' || k || '|' || in_col FROM ce),
r(root, node, depth) AS (
  SELECT dst, src, 1 FROM e WHERE dst LIKE 's3://%'
  UNION ALL
  SELECT r.root, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node)
SELECT DISTINCT root, node, depth FROM r""",
    "untraced_columns": "WITH " + SRUNS + "\nSELECT run_id, 'status' AS out_col, 'lost' AS mark FROM sr WHERE user_id % 6 = 4",
    "dataset_listing": "WITH " + STORE + "\nSELECT DISTINCT namespace_name, name FROM ds",
    "connector_identity": """
SELECT connector, 'debezium.' || connector AS physical_namespace, 'debezium:' || connector AS connector_logical, 'spark:load_' || connector AS job_logical
FROM (SELECT DISTINCT 'shop-' || lower(c_mktsegment) || '-' || CAST(c_nationkey AS VARCHAR) AS connector FROM customer)""",
    "hop_precision": "WITH " + HOPF + "\nSELECT run_id, hop, precision FROM hp",
    "path_precision": "WITH " + HOPF + """
SELECT run_id, CASE MAX(CASE precision WHEN 'exact' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END)
                 WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'lost' END AS precision
FROM hp WHERE precision <> 'n/a' GROUP BY run_id""",
    "overclaimed_runs": "WITH " + SRUNS + "\nSELECT run_id, CAST(1 AS BIGINT) AS missing_columns FROM sr WHERE user_id % 6 = 4 AND user_id % 2 = 0",
    "missing_markers": "WITH " + MARKERS + "\nSELECT run_id, marker_kind FROM mm",
    "complete_paths": "WITH " + MARKERS + ", " + RUNEV + """,
dep AS (SELECT run_id FROM rev GROUP BY run_id HAVING COUNT(DISTINCT (instance_id, stack_epoch)) = 1)
SELECT run_id FROM sr WHERE run_id NOT IN (SELECT run_id FROM mm) AND run_id IN (SELECT run_id FROM dep)""",
    "ambiguous_identities": "WITH " + STORE + """
SELECT namespace_name, name, COUNT(DISTINCT uuid) AS uuids FROM ds GROUP BY 1, 2 HAVING COUNT(DISTINCT uuid) > 1""",
    "misattributed_edges": "WITH " + STORE + f""",
outl AS (SELECT 'job-' || {_s('c_custkey')} AS job_uuid, 's3://warehouse-' || {_s('c_nationkey % 4')} AS declared_namespace FROM customer),
f AS (
  SELECT e.job_uuid, ds.namespace_name || ':' || ds.name AS dataset, 'foreign_output' AS reason
  FROM e JOIN ds ON e.dataset_uuid = ds.uuid JOIN outl ON e.job_uuid = outl.job_uuid
  WHERE e.io_type = 'OUTPUT' AND ds.namespace_name <> outl.declared_namespace
  UNION ALL
  SELECT job_uuid, NULL, 'input_without_output' FROM e GROUP BY job_uuid
  HAVING MAX(CASE WHEN io_type = 'INPUT' THEN 1 ELSE 0 END) = 1 AND MAX(CASE WHEN io_type = 'OUTPUT' THEN 1 ELSE 0 END) = 0)
SELECT jb.namespace_name || ':' || jb.name AS job, f.dataset, f.reason FROM f JOIN jb ON f.job_uuid = jb.uuid""",
    "jobs_without_io": "WITH " + STORE + """
SELECT namespace_name || ':' || name AS job FROM jb WHERE uuid NOT IN (SELECT job_uuid FROM e)""",
    "identity_collisions": f"""
SELECT 'mysql:' || {_s('c_nationkey')} AS emitter_key, COUNT(DISTINCT 'shop-' || lower(c_mktsegment)) AS connectors
FROM customer GROUP BY 1 HAVING COUNT(DISTINCT 'shop-' || lower(c_mktsegment)) > 1""",
    "declared_vs_observed": "WITH " + SRUNS + """,
j AS (SELECT DISTINCT k FROM sr)
SELECT 'load_t' || k AS job_name, 'INPUT' AS io_type, 'kafka://kafka:9092/mysqljson.shop.t' || k AS uri, 'both' AS status FROM j
UNION ALL SELECT 'load_t' || k, 'OUTPUT', 's3://poc-warehouse/poc/shop_t' || k || '_json', 'both' FROM j""",
    "after_fields": """
WITH ids AS (
  SELECT DISTINCT CAST(1 + event_id % 2 AS INTEGER) AS schema_id FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0)),
f(field_pos, field_name, nullable) AS (VALUES
  (0, 'user_id', false), (1, 'quantity', false), (2, 'unit_price', false), (3, 'status', false),
  (4, 'created_at', true), (5, 'updated_at', true), (6, 'channel', true))
SELECT ids.schema_id, 'mysql.shop.events-value' AS subject, ids.schema_id AS version, f.field_pos, f.field_name, f.nullable
FROM ids JOIN f ON f.field_pos < CASE WHEN ids.schema_id = 1 THEN 6 ELSE 7 END""",
    "schema_changes": """
SELECT 'mysql.shop.events-value' AS subject, 1 AS from_version, 2 AS to_version, 'channel' AS field_name,
       'added' AS change_kind, false AS breaking
FROM (SELECT COUNT(DISTINCT event_id % 2) AS n FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0)) WHERE n = 2""",
    "ts_precision": """
WITH s AS (
  SELECT CASE WHEN event_id % 3 <> 0 AND event_type <> 'view' THEN epoch_us(ts)
              ELSE (epoch_us(ts) // 1000000) * 1000000 END AS ts_us
  FROM events WHERE event_type <> 'view' AND NOT (event_type = 'error' AND event_id % 2 = 0))
SELECT CASE WHEN ts_us % 1000000 = 0 THEN 'second-padded' WHEN ts_us % 1000 = 0 THEN 'millisecond' ELSE 'microsecond' END AS precision,
       COUNT(*) AS events
FROM s GROUP BY 1""",
    "commits_in_window": f"""
WITH c AS (
  SELECT event_id * 1000003 + 17 AS snapshot_id, 'run-' || {_s('user_id')} AS run_id, ts AS committed_at
  FROM events WHERE event_type = 'purchase' AND user_id % 10 <> 0),
w AS (SELECT 'run-' || {_s('user_id')} AS run_id, MIN(ts) AS w0, MAX(ts) AS w1 FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
SELECT c.snapshot_id, c.run_id, COALESCE(c.committed_at BETWEEN w.w0 AND w.w1, false) AS inside
FROM c LEFT JOIN w ON c.run_id = w.run_id""",
}
