"""DuckDB oracle SQL for the queries of ``queries_runs``."""

from __future__ import annotations

from .oracle_changelog import EV, LATEST, STAGE_COLUMNS

LOADS = "WITH " + EV + """,
m AS (SELECT part, MAX(event_id) AS m FROM ev GROUP BY part),
l AS (
  SELECT ev.part, 1 AS load, MIN(event_id) AS a, MAX(event_id) + 1 AS b FROM ev JOIN m ON ev.part = m.part WHERE event_id < m // 4 GROUP BY 1
  UNION ALL SELECT ev.part, 2, MIN(event_id), MAX(event_id) + 1 FROM ev JOIN m ON ev.part = m.part WHERE event_id >= m // 2 AND event_id < 3 * m // 4 GROUP BY 1
  UNION ALL SELECT ev.part, 3, MIN(event_id), MAX(event_id) + 1 FROM ev JOIN m ON ev.part = m.part WHERE event_id >= m // 8 AND event_id < m // 4 GROUP BY 1),
w AS (
  SELECT part, MAX(a) FILTER (load = 1) AS a1, MAX(b) FILTER (load = 1) AS b1, MAX(a) FILTER (load = 2) AS a2, MAX(b) FILTER (load = 2) AS b2,
         MAX(a) FILTER (load = 3) AS a3, MAX(b) FILTER (load = 3) AS b3 FROM l GROUP BY part)"""

DOCS = """
WITH e AS (
  SELECT ts, user_id AS u, CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'RUNNING' END AS kind,
         'run-' || CAST(user_id AS VARCHAR) AS run_id, CASE WHEN user_id % 10 = 0 THEN 'airflow' ELSE 'spark' END AS job_ns, 'load_t' || CAST(user_id % 4 AS VARCHAR) AS job_name
  FROM events),
io AS (
  SELECT DISTINCT run_id, 'INPUT' AS io_type, 'kafka://broker:9092' AS ns, 'mysqljson.shop.t' || CAST(u % 4 AS VARCHAR) AS name FROM e WHERE u % 10 <> 0
  UNION SELECT DISTINCT run_id, 'INPUT', 'kafka://broker:9092', 'mysqljson.shop.t' || CAST((u + 1) % 4 AS VARCHAR) FROM e WHERE u % 10 <> 0 AND u % 6 = 0
  UNION SELECT DISTINCT run_id, 'OUTPUT', 's3://warehouse', 'poc/shop_t' || CAST(u % 4 AS VARCHAR) FROM e WHERE u % 10 <> 0 AND kind = 'COMPLETE'),
h AS (SELECT run_id, md5(io_type || chr(31) || ns || chr(31) || name) AS h FROM io),
s AS (
  SELECT run_id, COUNT(*) AS n, SUM(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS s1, SUM(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS s2 FROM h GROUP BY 1),
r AS (
  SELECT run_id, md5(job_ns || chr(31) || job_name) AS job_uuid, job_ns, job_name, MAX(ts) FILTER (kind = 'COMPLETE') AS done FROM e GROUP BY run_id, job_ns, job_name),
v AS (
  SELECT r.*, md5(job_uuid || chr(31) || CAST(coalesce(n, 0) AS VARCHAR) || chr(31) || CAST(coalesce(s1, 0) AS VARCHAR) || chr(31) || CAST(coalesce(s2, 0) AS VARCHAR)) AS jv
  FROM r LEFT JOIN s ON s.run_id = r.run_id),
cur AS (SELECT jv FROM (SELECT *, row_number() OVER (PARTITION BY job_uuid ORDER BY done DESC, run_id DESC) AS k FROM v WHERE done IS NOT NULL) WHERE k = 1),
m AS (SELECT DISTINCT v.job_uuid, v.jv, io.ns, io.name, io.io_type, v.jv IN (SELECT jv FROM cur) AS is_current FROM v JOIN io ON io.run_id = v.run_id)"""

CHAINS = """
WITH e AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id // 500 AS VARCHAR) AS run_id, 'inst-' || CAST(user_id % 2 AS VARCHAR) AS instance_id,
         CASE WHEN user_id % 13 = 0 AND event_id % 2 = 0 THEN 2 ELSE 1 END AS stack_epoch, 't' || CAST(user_id % 4 AS VARCHAR) AS t, CAST(user_id % 3 AS INTEGER) AS part,
         event_id, event_type, user_id, event_id // 1700 AS c
  FROM events),
k AS (SELECT run_id, instance_id, stack_epoch, t, part, MIN(event_id) AS a, MAX(event_id) + 1 AS b FROM e GROUP BY ALL),
p AS (
  SELECT DISTINCT instance_id, t, part, c, 1 AS stack_epoch FROM e UNION SELECT DISTINCT instance_id, t, part, c, 2 FROM e WHERE c % 2 = 1),
s AS (SELECT run_id, instance_id, stack_epoch, MAX(event_id) * 1000003 + 17 AS snapshot_id FROM e WHERE event_type = 'purchase' GROUP BY ALL),
x AS (
  SELECT k.run_id, k.instance_id, k.stack_epoch, 'mysqljson.shop.' || k.t AS topic, k.part AS partition, k.a AS start_offset, k.b AS end_offset,
         'conn-mysqljson.shop.' || p.t || '-' || CAST(p.c AS VARCHAR) AS connector_run_id, 'shop.' || p.t AS source, s.snapshot_id, p.c IS NOT NULL AND s.snapshot_id IS NOT NULL AS whole
  FROM k LEFT JOIN p ON p.instance_id = k.instance_id AND p.stack_epoch = k.stack_epoch AND p.t = k.t AND p.part = k.part AND p.c * 1700 <= k.a AND k.b <= (p.c + 1) * 1700
  LEFT JOIN s ON s.run_id = k.run_id AND s.instance_id = k.instance_id AND s.stack_epoch = k.stack_epoch)"""

SQL = {
    "facet_column_edges": """
WITH e AS (SELECT event_id AS e, user_id % 4 AS k FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 7 <> 0),
f AS (
  SELECT k, 'id' AS out_col, 'id' AS in_col, 0 AS r FROM e
  UNION ALL SELECT k, 'total', c, CASE WHEN e.e % 3 <> 0 THEN 0 ELSE 1 END FROM e, (VALUES ('quantity'), ('price')) v(c)
  UNION ALL SELECT k, 'c' || (e.e % 5), CASE WHEN e.e % 2 = 0 THEN 'raw' END, CASE WHEN e.e % 2 = 0 THEN 1 ELSE 2 END FROM e)
SELECT 'spark' AS job_ns, 'load_t' || k AS job_name, 's3://warehouse' AS out_ns, 'poc/shop_t' || k AS out_name, out_col,
       CASE WHEN in_col IS NOT NULL THEN 'kafka://broker:9092' END AS in_ns, CASE WHEN in_col IS NOT NULL THEN 'mysqljson.shop.t' || k END AS in_name, in_col,
       CASE MIN(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'lost' END AS precision, COUNT(*) AS n_claims
FROM f GROUP BY k, out_col, in_col""",
    "facet_problems": """
WITH e AS (
  SELECT event_id % 13 = 0 AS cut, CASE WHEN event_id % 13 <> 0 THEN user_id % 4 END AS k, event_id % 11 = 0 AS bad,
         CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 3 WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS untraced
  FROM events)
SELECT CASE WHEN k IS NOT NULL THEN 'spark' END AS job_ns, CASE WHEN k IS NOT NULL THEN 'load_t' || k END AS job_name, COUNT(*) AS n_documents,
       COUNT(*) FILTER (cut) AS n_malformed, COUNT(*) FILTER (bad AND NOT cut) AS n_bad_facets, CAST(SUM(untraced) AS BIGINT) AS n_untraced
FROM e GROUP BY k""",
    "resume_ranges": LOADS + """
SELECT 'mysqljson.shop.events' AS topic, part AS partition, start_offset, end_offset FROM (
  SELECT part, 0 AS start_offset, a1 AS end_offset FROM w UNION ALL SELECT part, b1, a2 FROM w UNION ALL SELECT part, b2, NULL FROM w)
WHERE end_offset IS NULL OR start_offset < end_offset""",
    "offset_gaps": LOADS + """
SELECT 'mysqljson.shop.events' AS topic, part AS partition, kind, a AS start_offset, b AS end_offset FROM (
  SELECT part, 'gap' AS kind, b1 AS a, a2 AS b FROM w UNION ALL SELECT part, 'overlap', a3, b3 FROM w) WHERE a < b""",
    "resumed_load": "WITH " + LATEST + "\nSELECT " + STAGE_COLUMNS + " FROM latest",
    "store_from_events": DOCS + """
SELECT DISTINCT 'dataset' AS kind, md5(ns || chr(31) || name) AS uuid, ns AS a, name AS b, NULL::BOOLEAN AS is_current FROM io
UNION ALL SELECT DISTINCT 'job', job_uuid, job_ns, job_name, NULL FROM r
UNION ALL SELECT DISTINCT 'job_version', jv, job_uuid, NULL, NULL FROM v
UNION ALL SELECT 'io', jv, md5(ns || chr(31) || name), io_type, is_current FROM m""",
    "edges_from_events": DOCS + """
SELECT DISTINCT r.job_ns || ':' || r.job_name AS job, m.ns || ':' || m.name AS dataset, m.io_type FROM m JOIN r ON r.job_uuid = m.job_uuid WHERE m.is_current""",
    "run_chains": CHAINS + "\nSELECT * FROM x",
    "complete_runs": CHAINS + """
SELECT run_id, instance_id, stack_epoch FROM x
WHERE run_id IN (SELECT run_id FROM e WHERE user_id % 7 <> 2) AND run_id IN (SELECT run_id FROM e WHERE event_type = 'purchase')
GROUP BY ALL HAVING bool_and(whole)""",
}
