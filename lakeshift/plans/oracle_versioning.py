"""DuckDB oracle SQL for merge, snapshot, retention, reconciliation and identity queries."""

from __future__ import annotations

from .oracle_changelog import CUST_V1, CUST_V2, EV, LATEST, STAGE_COLUMNS

STAGE = CUST_V1 + ", " + CUST_V2 + """,
stage AS (
  SELECT v2.* FROM v2 LEFT JOIN v1 ON v1.c_custkey = v2.c_custkey
  WHERE v1.c_custkey IS NULL OR v1.c_name IS DISTINCT FROM v2.c_name
     OR v1.c_nationkey IS DISTINCT FROM v2.c_nationkey OR v1.c_acctbal IS DISTINCT FROM v2.c_acctbal
     OR v1.c_mktsegment IS DISTINCT FROM v2.c_mktsegment)"""

SNAPS = """
snaps AS (
  SELECT 'poc.shop_t' || CAST(user_id % 4 AS VARCHAR) || '_json' AS "table",
         event_id * 1000003 + 17 AS snapshot_id, ts AS committed_at,
         'app-' || CAST(user_id AS VARCHAR) AS app_id, 'run-' || CAST(user_id AS VARCHAR) AS run_id
  FROM events WHERE event_type = 'purchase' AND user_id % 10 <> 0)"""

TOPICS = """
t AS (SELECT DISTINCT topic FROM (
  SELECT 'mysqljson.shop.events' AS topic FROM events
  UNION ALL SELECT 'mysql.shop.orders' FROM orders
  UNION ALL SELECT 'mysqljson.shop.customers' FROM customer))"""

SQL = {
    "merge_upsert": "WITH " + STAGE + """
SELECT * FROM stage
UNION ALL
SELECT * FROM v1 WHERE c_custkey NOT IN (SELECT c_custkey FROM stage)""",
    "merge_actions": "WITH " + STAGE + """
SELECT CASE WHEN stage.c_custkey IS NULL THEN 'keep' WHEN v1.c_custkey IS NULL THEN 'insert' ELSE 'update' END AS action,
       COUNT(*) AS row_count
FROM v1 FULL OUTER JOIN stage ON v1.c_custkey = stage.c_custkey GROUP BY 1""",
    "merge_two_batches": "WITH " + LATEST + "\nSELECT " + STAGE_COLUMNS + " FROM latest",
    "merge_apply_deletes": "WITH " + EV + """,
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev)
  WHERE rn = 1 AND event_type <> 'error')
SELECT """ + STAGE_COLUMNS + " FROM latest",
    "load_table_versions": "WITH " + EV + """,
half AS (SELECT part, MAX(event_id) // 2 AS cut FROM ev GROUP BY part),
k AS (SELECT ev.user_id, bool_or(ev.event_id < half.cut) AS in_first, bool_or(ev.event_id >= half.cut) AS in_second
      FROM ev JOIN half ON ev.part = half.part WHERE event_type <> 'error' GROUP BY ev.user_id)
SELECT 1 AS version, 'create' AS operation, 0 AS inserted, 0 AS updated, 0 AS deleted, NULL AS run_id, NULL AS hop
UNION ALL SELECT 2, 'merge', COUNT(*) FILTER (in_first), 0, 0, 'load-1', 'topic->table' FROM k
UNION ALL SELECT 3, 'merge', COUNT(*) FILTER (in_second AND NOT in_first), COUNT(*) FILTER (in_second AND in_first), 0, 'load-2', 'topic->table' FROM k""",
    "current_snapshot": "WITH " + SNAPS + """
SELECT "table", snapshot_id, committed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY committed_at DESC, snapshot_id DESC) AS rn FROM snaps)
WHERE rn = 1""",
    "snapshot_for_run": "WITH " + SNAPS + """,
by_run AS (
  SELECT run_id, "table", snapshot_id AS run_snapshot_id FROM (
    SELECT *, row_number() OVER (PARTITION BY app_id, "table" ORDER BY committed_at DESC, snapshot_id DESC) AS rn FROM snaps)
  WHERE rn = 1),
cur AS (
  SELECT "table", snapshot_id AS current_snapshot_id FROM (
    SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY committed_at DESC, snapshot_id DESC) AS rn FROM snaps)
  WHERE rn = 1)
SELECT by_run.run_id, by_run."table", run_snapshot_id, current_snapshot_id,
       run_snapshot_id = current_snapshot_id AS is_current
FROM by_run JOIN cur ON by_run."table" = cur."table\"""",
    "check_retention": "WITH " + SNAPS + """,
r AS (SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, MIN(ts) AS first_ts FROM events GROUP BY user_id),
f AS (
  SELECT s."table", s.snapshot_id, s.run_id,
         s.committed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS live,
         COALESCE(r.first_ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR, false) AS replayable
  FROM snaps s LEFT JOIN r ON s.run_id = r.run_id)
SELECT "table", snapshot_id, run_id, live, replayable, live AND NOT replayable AS violation FROM f""",
    "reconcile": "WITH " + LATEST + """
SELECT user_id, CASE WHEN user_id % 17 = 0 THEN 'only_avro' ELSE 'differs' END AS status,
       CASE WHEN user_id % 17 = 0 THEN NULL ELSE 'quantity' END AS diff_columns
FROM latest WHERE user_id % 17 = 0 OR user_id % 19 = 0""",
    "identity_from_topic": "WITH " + TOPICS + """
SELECT topic, split_part(topic, '.', 1) AS prefix, split_part(topic, '.', 2) AS db, split_part(topic, '.', 3) AS tbl,
       split_part(topic, '.', 2) || '.' || split_part(topic, '.', 3) AS mysql_dataset,
       topic || '-value' AS subject, true AS subject_round_trip,
       'poc.' || split_part(topic, '.', 2) || '_' || split_part(topic, '.', 3)
         || CASE WHEN split_part(topic, '.', 1) = 'mysqljson' THEN '_json' ELSE '' END AS sink_logical
FROM t""",
    "identity_physical_logical": """
SELECT DISTINCT 'spark' AS job_ns, 'load_t' || k AS job_name, 'spark:load_t' || k AS job_logical,
       's3://poc-warehouse/poc/shop_t' || k || '_json' AS output_uri,
       's3://poc-warehouse/poc' AS uri_namespace, 'shop_t' || k || '_json' AS uri_name,
       'nessie.poc' AS physical_namespace, 'shop_t' || k || '_json' AS physical_table
FROM (SELECT CAST(user_id % 4 AS VARCHAR) AS k FROM events WHERE user_id % 10 <> 0)""",
    "storage_name_to_logical": """
WITH s AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 3 = 0 THEN 'poc/shop_c' || CAST(c_custkey AS VARCHAR) || '_' || substr(h, 1, 8) || '-' || substr(h, 9, 4)
                   || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
              ELSE 'poc/shop_c' || CAST(c_custkey AS VARCHAR) END AS storage_name
  FROM (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer))
SELECT c_custkey, storage_name,
       regexp_replace(storage_name, '_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$', '') AS logical_name
FROM s""",
    "job_tags": """
SELECT job, split_part(kv, '=', 1) AS tag_key, split_part(kv, '=', 2) AS tag_value FROM (
  SELECT c_name AS job,
         unnest(string_split('segment=' || c_mktsegment || ',nation=' || CAST(c_nationkey AS VARCHAR)
                             || ',owner=team' || CAST(c_custkey % 5 AS VARCHAR), ',')) AS kv
  FROM customer)""",
}
