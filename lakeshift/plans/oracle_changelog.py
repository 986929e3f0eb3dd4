"""DuckDB oracle SQL for the change-log queries: the derivation rules restated in SQL,
computed straight from the driver tables (no JSON / Avro round trip)."""

from __future__ import annotations

# Fixed values shared with sources/derived.py
EV = """
ev AS (
  SELECT event_id, user_id, event_type, ts,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'click' THEN 'u'
                         WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' END AS op,
         CAST(1 + event_id % 10 AS INTEGER) AS quantity,
         CAST(value AS DECIMAL(10,2)) AS unit_price,
         CAST(user_id % 3 AS INTEGER) AS part,
         (event_type = 'error' AND event_id % 2 = 0) AS tombstone
  FROM events)"""

LATEST = EV + """,
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
    FROM ev WHERE event_type <> 'error') WHERE rn = 1)"""

STAGE_COLUMNS = """user_id, quantity, unit_price,
       CAST(unit_price * quantity AS DECIMAL(12,2)) AS total_price,
       event_type AS status,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS created_at,
       ts AS updated_at"""

CUST_V1 = "v1 AS (SELECT * FROM customer WHERE c_custkey % 5 <> 1)"
CUST_V2 = """v2 AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
         c_mktsegment
  FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 1)"""

SQL = {
    "live_changes": "WITH " + EV + """
SELECT user_id, event_id AS "offset", op, event_type AS status FROM ev WHERE event_type <> 'error'""",
    "latest_by_key": "WITH " + LATEST + """
SELECT user_id, event_id AS "offset", op, event_type AS status FROM latest""",
    "latest_by_key_maxby": "WITH " + EV + """
SELECT user_id, arg_max(event_id, event_id) AS "offset", arg_max(op, event_id) AS op,
       arg_max(event_type, event_id) AS status
FROM ev WHERE event_type <> 'error' GROUP BY user_id""",
    "json_upsert_projection": "WITH " + LATEST + "\nSELECT " + STAGE_COLUMNS + " FROM latest",
    "avro_upsert_projection": "WITH " + LATEST + "\nSELECT " + STAGE_COLUMNS + " FROM latest",
    "avro_frame_header": "WITH " + EV + """
SELECT CASE WHEN tombstone THEN NULL ELSE CAST(1 + event_id % 2 AS INTEGER) END AS schema_id,
       COUNT(*) AS frames
FROM ev GROUP BY 1""",
    "customer_passthrough": """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""",
    "source_position": """
WITH s AS (
  SELECT event_id, event_type,
         (event_id % 3 <> 0 AND event_type <> 'view') AS g,
         CASE WHEN event_id % 3 <> 0 AND event_type <> 'view' THEN epoch_us(ts)
              ELSE (epoch_us(ts) // 1000000) * 1000000 END AS ts_us
  FROM events)
SELECT event_id AS "offset",
       'mysql-bin.' || lpad(CAST(event_id // 10000 + 1 AS VARCHAR), 6, '0') AS binlog_file,
       (event_id % 10000) * 100 + 4 AS binlog_pos,
       CASE WHEN g THEN '5d3c1b2a-0f1e-11ee-8c90-0242ac120002' END AS gtid_source,
       CASE WHEN g THEN event_id END AS gtid_txn,
       ts_us // 1000 AS ts_ms, ts_us, ts_us * 1000 AS ts_ns,
       CASE WHEN ts_us % 1000000 = 0 THEN 'second-padded' WHEN ts_us % 1000 = 0 THEN 'millisecond'
            ELSE 'microsecond' END AS precision,
       (ts_us * 1000) % 1000 = 0 AS ns_derived
FROM s WHERE NOT (event_type = 'error' AND event_id % 2 = 0)""",
    "changelog_counts": "WITH " + EV + """
SELECT 'mysqljson.shop.events' AS topic, CASE WHEN tombstone THEN NULL ELSE op END AS op, COUNT(*) AS messages
FROM ev GROUP BY 1, 2""",
    "key_multiplicity": """
SELECT user_id, COUNT(*) AS messages FROM events GROUP BY user_id HAVING COUNT(*) >= 2""",
    "offset_ranges": """
SELECT 'mysqljson.shop.events' AS topic, CAST(user_id % 3 AS INTEGER) AS "partition",
       MIN(event_id) AS start_offset, MAX(event_id) + 1 AS end_offset, COUNT(*) AS messages
FROM events GROUP BY 2""",
    "incremental_offsets": "WITH " + EV + """,
r AS (SELECT part, MAX(event_id) // 2 AS start_offset FROM ev GROUP BY part)
SELECT ev.part AS "partition", ev.event_id AS "offset", CASE WHEN tombstone THEN NULL ELSE op END AS op
FROM ev JOIN r ON ev.part = r.part WHERE ev.event_id >= r.start_offset""",
    "sample_changelog": "WITH " + EV + """
SELECT part AS "partition", event_id AS "offset", tombstone FROM ev ORDER BY part, event_id LIMIT 5""",
    "route_topics": """
SELECT 'mysql.shop.orders' AS topic, CAST(o_orderkey % 3 AS INTEGER) AS "partition", COUNT(*) AS messages
FROM orders GROUP BY 2
UNION ALL
SELECT 'mysqljson.shop.events', CAST(user_id % 3 AS INTEGER), COUNT(*) FROM events GROUP BY 2""",
    "snapshot_to_changes": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate,
       CAST(o_orderkey % 3 AS INTEGER) AS "partition", (2 * o_orderkey // 3) * 2 AS "offset", 'r' AS op
FROM orders""",
    "capture_chain": "WITH " + CUST_V1 + ", " + CUST_V2 + """,
v3 AS (
  SELECT * FROM v2 WHERE c_custkey NOT IN (SELECT c_custkey FROM v1 WHERE c_custkey % 7 = 0)
  UNION ALL SELECT * FROM v1 WHERE c_custkey % 7 = 0)
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal - 50 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM v3 WHERE c_custkey % 11 <> 0""",
    "table_diff_to_changes": "WITH " + CUST_V1 + ", " + CUST_V2 + """,
j AS (
  SELECT COALESCE(v1.c_custkey, v2.c_custkey) AS k, v1.c_acctbal AS b, v2.c_acctbal AS a,
         CASE WHEN v1.c_custkey IS NULL THEN 'c' WHEN v2.c_custkey IS NULL THEN 'd'
              WHEN v1.c_name IS DISTINCT FROM v2.c_name OR v1.c_nationkey IS DISTINCT FROM v2.c_nationkey
                OR v1.c_acctbal IS DISTINCT FROM v2.c_acctbal OR v1.c_mktsegment IS DISTINCT FROM v2.c_mktsegment
              THEN 'u' END AS op
  FROM v1 FULL OUTER JOIN v2 ON v1.c_custkey = v2.c_custkey)
SELECT k AS c_custkey, op, false AS tombstone, b AS before_acctbal, a AS after_acctbal,
       CAST(k % 3 AS INTEGER) AS "partition", (2 * k // 3) * 2 AS "offset"
FROM j WHERE op IS NOT NULL
UNION ALL
SELECT k, NULL, true, NULL, NULL, CAST(k % 3 AS INTEGER), (2 * k // 3) * 2 + 1 FROM j WHERE op = 'd'""",
}

SQL["customers_avro_projection"] = SQL["capture_chain"]
SQL["stream_upsert"] = SQL["load_then_stream"] = SQL["json_upsert_projection"]
