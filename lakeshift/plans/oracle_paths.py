"""DuckDB SQL twins of ``queries_paths``: as-of by the newest time, the oldest message by scanning messages, paths written out."""

from __future__ import annotations

UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"

SQL = {
    "run_outages": """
WITH b AS (SELECT 'connector-' || CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 7 END AS run_id, ts, event_type = 'error' AS ended FROM events),
g AS (SELECT run_id, ts AS silent_from, LEAD(ts) OVER (PARTITION BY run_id ORDER BY ts, ended) AS resumed_at, ended FROM b),
x AS (SELECT *, coalesce(resumed_at, TIMESTAMP '2024-01-31 00:00:00') AS stop FROM g WHERE resumed_at IS NOT NULL OR NOT ended)
SELECT run_id, silent_from, resumed_at, CAST((epoch_us(stop) - epoch_us(silent_from)) // 1000000 AS BIGINT) AS seconds
FROM x WHERE stop >= silent_from + INTERVAL 2 HOURS""",
    "lineage_cycles": """
WITH RECURSIVE c AS (SELECT c_custkey AS c, c_nationkey AS n, c_custkey - c_custkey % 6 AS base FROM customer),
e AS (
  SELECT 'data|' || c AS src, 'job|' || c AS dst FROM c
  UNION SELECT 'job|' || c, 'data|' || (base + (5 * c + n) % 6) FROM c
  UNION SELECT 'job|' || c, 'data|' || (base + (c + 7) % 6) FROM c WHERE n % 3 = 0),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
s AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src),
m AS (SELECT node, MIN(other) AS component FROM s GROUP BY node)
SELECT component, node, COUNT(*) FILTER (node LIKE 'job|%') OVER (PARTITION BY component) AS n_jobs FROM m""",
    "sink_identity_as_of": f"""
WITH m AS (
  SELECT k, ts, event_id, 'poc/shop_t' || k || '_json_' || {UUID} AS storage
  FROM (SELECT k, ts, event_id, md5(event_id || '-' || k) AS h FROM events, range(4) r(k) WHERE event_id % 50 = 0)),
i AS (SELECT k, ts, MAX(event_id) AS event_id, arg_max(storage, event_id) AS storage FROM m GROUP BY k, ts),
w AS (
  SELECT user_id, event_id, ts, user_id % 4 AS k, CASE WHEN user_id % 5 = 2 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS named,
         event_id - event_id % 50 - CASE WHEN event_id % 3 = 0 AND user_id % 5 <> 2 THEN 50 ELSE 0 END AS made
  FROM events WHERE user_id % 10 <> 0),
o AS (
  SELECT user_id, event_id, ts, k, 'poc/shop_t' || named || '_json' AS plain,
         'poc/shop_t' || named || '_json' || CASE WHEN user_id % 5 = 1 THEN '' ELSE '_' || {UUID} END AS storage
  FROM (SELECT *, md5(made || '-' || named) AS h FROM w))
SELECT 'run-' || o.user_id AS run_id, o.event_id, 'poc.shop_t' || o.k || '_json' AS "table", o.ts AS observed_at, o.storage AS storage_name,
       i.event_id * 1000003 + 17 AS snapshot_id, CASE WHEN i.k IS NOT NULL THEN 'nessie.poc.shop_t' || i.k || '_json' END AS physical_table, i.storage AS storage_in_force,
       CASE WHEN i.k IS NULL THEN 'unknown' WHEN i.storage = o.storage THEN 'current' WHEN o.plain = 'poc/shop_t' || i.k || '_json' THEN 'stale' ELSE 'foreign' END AS status
FROM o ASOF LEFT JOIN i ON o.k = i.k AND o.ts >= i.ts""",
    "retention_by_offsets": """
WITH s AS (
  SELECT event_id, user_id % 4 AS t, user_id % 3 AS p, ts, greatest(0, event_id - 300 - 700 * (user_id % 7)) AS a FROM events WHERE event_type = 'purchase'),
x AS (
  SELECT s.event_id, s.t, s.ts, MIN(m.ts) AS oldest FROM s JOIN events m ON m.user_id % 3 = s.p AND m.event_id BETWEEN s.a AND s.event_id GROUP BY ALL),
l AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(oldest)) / 1000000) AS BIGINT) AS lag FROM x)
SELECT 'poc.shop_t' || t AS "table", event_id * 1000003 + 17 AS snapshot_id, oldest, lag AS lag_seconds, MAX(lag) OVER (PARTITION BY t) AS worst_lag_seconds,
       ts >= now_at - INTERVAL 168 HOURS AS live, oldest >= now_at - INTERVAL 336 HOURS AS replayable,
       ts >= now_at - INTERVAL 168 HOURS AND oldest < now_at - INTERVAL 336 HOURS AS violation, MAX(lag) OVER (PARTITION BY t) + 604800 <= 1209600 AS safe
FROM l, (SELECT TIMESTAMP '2024-01-31 00:00:00' AS now_at)""",
    "column_path_precision": """
WITH p AS (SELECT p_partkey AS part, p_brand AS brand, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_partkey % 3 END AS r FROM part),
o AS (SELECT o_orderkey AS ord, o_custkey AS cust, o_orderkey % 2 AS r FROM orders),
l AS (SELECT l_orderkey AS ord, l_partkey AS part, MIN(l_linenumber % 3) AS r FROM lineitem GROUP BY ALL),
op AS (
  SELECT cust, part, MIN(r) AS r FROM (
    SELECT o.cust, l.part, greatest(o.r, l.r) AS r FROM o JOIN l USING (ord)
    UNION ALL SELECT o.cust, x.l_partkey, 0 FROM lineitem x JOIN o ON o.ord = x.l_orderkey WHERE x.l_linenumber = 7)
  GROUP BY ALL),
a AS (
  SELECT cust, 'order|' || ord AS in_col, r FROM o
  UNION ALL SELECT cust, 'part|' || part, r FROM op
  UNION ALL SELECT cust, 'brand|' || brand, MIN(greatest(op.r, p.r)) FROM op JOIN p USING (part) GROUP BY ALL)
SELECT 'customer|' || cust AS out_col, in_col, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'lost' END AS precision
FROM a WHERE cust IN (SELECT c_custkey FROM customer)""",
}
