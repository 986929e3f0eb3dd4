"""Inputs derived from the driver tables by Spark, so that every query's work grows with them.

Each function documents its rule; ``plans/oracle.py`` restates the same rules in SQL.

* ``events_log``      -- JSON change log of ``events`` (key = user_id, offset = event_id)
* ``events_avro_log`` -- the same changes, Confluent-framed Avro, two writer schema ids
* ``customers_v1/v2`` -- two versions of ``customer`` (updates, inserts, deletes)
* ``orders_snapshot_log`` -- initial snapshot of ``orders``
* ``tree_edges``      -- region -> nation -> customer -> order node edges
* ``run_events``      -- lineage run events, one run per user
* ``snapshots`` / ``markers`` -- table versions and version markers of those runs
* ``lineage_store``   -- datasets / jobs / job_versions / io_mapping from part, supplier,
  customer, orders and lineitem
"""

from __future__ import annotations

from decimal import Decimal
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import avro_binary
from .changelog import snapshot_to_changes, table_diff_to_changes

EVENTS_TOPIC = "mysqljson.shop.events"
EVENTS_AVRO_TOPIC = "mysql.shop.events"
ORDERS_TOPIC = "mysql.shop.orders"
CUSTOMERS_TOPIC = "mysqljson.shop.customers"
LOG_PARTITIONS = 3
GTID_SERVER = "5d3c1b2a-0f1e-11ee-8c90-0242ac120002"
ISO_Z = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

EVENTS_AFTER_DDL = "user_id bigint, quantity int, unit_price string, status string, created_at string, updated_at string"
CUSTOMER_AFTER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table; ``spread`` for inputs of CPU-heavy derivations (encoding logs)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallelism(df) if spread else df


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has cores.

    A single-row-group file cannot be split by the reader, so derivation work on it would
    run in one task.  Large inputs (many files / row groups) already plan at least
    ``defaultParallelism`` partitions and are left untouched -- no extra shuffle at scale.
    The partition count comes from planning only (no job).  Rows are hash-partitioned on
    their own values: deterministic on retry like a round-robin repartition, but without
    the per-task sort round-robin needs for that.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    flat = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    return df.repartition(par, *flat) if flat else df.repartition(par)


# ------------------------------------------------------------------ events log -------


OP_SQL = (
    "CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'click' THEN 'u' "
    "WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'd' END"
)
TRUE_US_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def events_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed change rows of ``events`` before encoding (shared by the JSON and Avro logs).

    GTID is on for ``event_id % 3 != 0`` except snapshot reads; without it the source
    timestamp is padded to whole seconds.
    """
    gtid_on = f"(event_id % 3 <> 0 AND {OP_SQL} <> 'r')"
    return table(spark, sf_dir, "events", spread=True).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        f"{OP_SQL} AS op",
        "CAST(1 + event_id % 10 AS INT) AS quantity",
        "CAST(value AS DECIMAL(10,2)) AS unit_price",
        f"date_format(date_trunc('day', ts), \"{ISO_Z}\") AS created_at",
        f"date_format(ts, \"{ISO_Z}\") AS updated_at",
        f"CAST(CASE WHEN {gtid_on} THEN {TRUE_US_SQL} ELSE ({TRUE_US_SQL} div 1000000) * 1000000 END AS BIGINT) AS ts_us",
        f"CASE WHEN {gtid_on} THEN concat('{GTID_SERVER}:', CAST(event_id AS STRING)) END AS gtid",
        "concat('mysql-bin.', lpad(CAST(event_id div 10000 + 1 AS STRING), 6, '0')) AS binlog_file",
        "(event_id % 10000) * 100 + 4 AS binlog_pos",
    )


AFTER_SQL = (
    "named_struct('user_id', user_id, 'quantity', quantity, 'unit_price', CAST(unit_price AS STRING), "
    "'status', event_type, 'created_at', created_at, 'updated_at', updated_at)"
)


def source_sql(name: str) -> str:
    return (
        f"named_struct('connector', 'mysql', 'name', '{name}', 'db', 'shop', 'table', 'events', "
        "'ts_ms', ts_us div 1000, 'ts_us', ts_us, 'ts_ns', ts_us * 1000, 'gtid', gtid, "
        "'file', binlog_file, 'pos', binlog_pos, 'snapshot', CASE WHEN op = 'r' THEN 'true' ELSE 'false' END)"
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON change log of ``events``.

    error events are deletes: an even ``event_id`` is a tombstone (NULL value), an odd
    one a delete envelope with a ``before`` image and no ``after``.
    """
    src = source_sql("mysqljson")
    value = (
        "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL "
        f"WHEN event_type = 'error' THEN to_json(named_struct('before', {AFTER_SQL}, 'op', op, 'source', {src})) "
        f"ELSE to_json(named_struct('after', {AFTER_SQL}, 'op', op, 'source', {src})) END"
    )
    return events_changes(spark, sf_dir).selectExpr(
        "CAST(to_json(named_struct('user_id', user_id)) AS BINARY) AS key",
        f"CAST({value} AS BINARY) AS value",
        f"'{EVENTS_TOPIC}' AS topic",
        f"CAST(pmod(user_id, {LOG_PARTITIONS}) AS INT) AS partition",
        "event_id AS offset",
    )


# ------------------------------------------------------------- Avro events log -------

def _value_fields(extra: bool) -> list[dict]:
    fields = [
        {"name": "user_id", "type": "long"},
        {"name": "quantity", "type": "int"},
        {"name": "unit_price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}},
        {"name": "status", "type": "string"},
        {"name": "created_at", "type": ["null", {"type": "string", "connect.name": "io.debezium.time.ZonedTimestamp"}], "default": None},
        {"name": "updated_at", "type": ["null", {"type": "string", "connect.name": "io.debezium.time.ZonedTimestamp"}], "default": None},
    ]
    if extra:
        fields.append({"name": "channel", "type": ["null", "string"], "default": None})
    return fields


def envelope_schema(extra: bool) -> dict:
    return {
        "type": "record",
        "name": "Envelope",
        "namespace": "mysql.shop.events",
        "fields": [
            {"name": "before", "type": ["null", {"type": "record", "name": "Value", "fields": _value_fields(extra)}], "default": None},
            {"name": "after", "type": ["null", "Value"], "default": None},
            {"name": "op", "type": "string"},
            {"name": "ts_ms", "type": ["null", "long"], "default": None},
        ],
    }


def registry(spark: SparkSession) -> DataFrame:
    """Schema registry rows: id 1 = base value schema, id 2 = id 1 plus ``channel``."""
    import json

    subject = f"{EVENTS_AVRO_TOPIC}-value"
    rows = [
        (1, subject, 1, json.dumps(envelope_schema(False))),
        (2, subject, 2, json.dumps(envelope_schema(True))),
    ]
    return spark.createDataFrame(rows, "schema_id int, subject string, version int, schema string")


def _avro_encoder(schemas: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {k: avro_binary.parse_schema(v) for k, v in schemas.items()}
        for b in batches:
            d = b.to_pydict()
            out = []
            for i in range(b.num_rows):
                eid, etype = d["event_id"][i], d["event_type"][i]
                if etype == "error" and eid % 2 == 0:
                    out.append(None)
                    continue
                sid = 1 + eid % 2
                rec = {
                    "user_id": d["user_id"][i],
                    "quantity": d["quantity"][i],
                    "unit_price": d["unit_price"][i] if d["unit_price"][i] is not None else Decimal(0),
                    "status": etype,
                    "created_at": d["created_at"][i],
                    "updated_at": d["updated_at"][i],
                    "channel": "web" if sid == 2 else None,
                }
                env = {"before": None, "after": rec, "op": d["op"][i], "ts_ms": d["ts_us"][i] // 1000}
                if etype == "error":
                    env = {"before": rec, "after": None, "op": "d", "ts_ms": d["ts_us"][i] // 1000}
                out.append(avro_binary.frame(sid, avro_binary.encode(nodes[sid], env)))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [("{\"user_id\":%d}" % u).encode() for u in d["user_id"]],
                    "value": out,
                    "topic": [EVENTS_AVRO_TOPIC] * b.num_rows,
                    "partition": [u % LOG_PARTITIONS for u in d["user_id"]],
                    "offset": d["event_id"],
                },
                schema=pa.schema(
                    [("key", pa.binary()), ("value", pa.binary()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())]
                ),
            )

    return run


def events_avro_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confluent-framed Avro change log of ``events``: schema id ``1 + event_id % 2``."""
    import json

    schemas = {1: json.dumps(envelope_schema(False)), 2: json.dumps(envelope_schema(True))}
    ch = events_changes(spark, sf_dir).select(
        "event_id", "user_id", "event_type", "op", "quantity", "unit_price", "created_at", "updated_at", "ts_us"
    )
    return ch.mapInArrow(_avro_encoder(schemas), "key binary, value binary, topic string, partition int, offset bigint")


# ------------------------------------------------------------ table versions ---------


def customers_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1: all customers but those with ``key % 5 = 1``, who come with version 2."""
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 5 != 1)


def customers_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 2: v1 minus keys divisible by 7, plus the customers with ``key % 5 = 1``;
    keys divisible by 3 get ``c_acctbal + 100``."""
    c = table(spark, sf_dir, "customer")
    keep = (F.col("c_custkey") % 7 != 0) | (F.col("c_custkey") % 5 == 1)
    return c.filter(keep).select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment",
    )


def customers_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 3: v2 minus keys divisible by 11, plus v1's keys divisible by 7 again; keys divisible by 4 get ``c_acctbal - 50``."""
    back = customers_v1(spark, sf_dir).filter(F.col("c_custkey") % 7 == 0)
    rows = customers_v2(spark, sf_dir).join(back.select("c_custkey"), "c_custkey", "left_anti").unionByName(back).filter(F.col("c_custkey") % 11 != 0)
    return rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") - 50).otherwise(F.col("c_acctbal")))


def customers_capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of v1, then the changes to v2, then to v3, each placed after the end of the log before it."""
    v1, v2, v3 = (f(spark, sf_dir) for f in (customers_v1, customers_v2, customers_v3))
    log = snapshot_to_changes(v1, "c_custkey", CUSTOMERS_TOPIC, LOG_PARTITIONS)
    for old, new in ((v1, v2), (v2, v3)):
        log = log.unionByName(table_diff_to_changes(old, new, "c_custkey", CUSTOMERS_TOPIC, LOG_PARTITIONS, log=log))
    return log


def customers_avro_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``customers_capture_log`` as Confluent-framed Avro (value schema id 11, key schema id 12), and its registry rows."""
    import json

    value = [{"name": "c_custkey", "type": "long"}, *({"name": n, "type": ["null", t]} for n, t in (("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")))]
    row = {"type": "record", "name": "Value", "fields": value}
    envelope = {"type": "record", "name": "Envelope", "fields": [{"name": "before", "type": ["null", row]}, {"name": "after", "type": ["null", "Value"]}, {"name": "op", "type": "string"}]}
    key = {"type": "record", "name": "Key", "fields": [{"name": "c_custkey", "type": "long"}]}
    schemas = {11: json.dumps(envelope), 12: json.dumps(key)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {k: avro_binary.parse_schema(v) for k, v in schemas.items()}
        framed = lambda sid, text: None if text is None else avro_binary.frame(sid, avro_binary.encode(nodes[sid], json.loads(text)))
        for b in batches:
            cols = [[framed(12, x) for x in b.column("key").to_pylist()], [framed(11, x) for x in b.column("value").to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), b.column("topic"), b.column("partition"), b.column("offset")], ["key", "value", "topic", "partition", "offset"])

    log = customers_capture_log(spark, sf_dir).withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))
    rows = [(11, f"{CUSTOMERS_TOPIC}-value", 1, schemas[11]), (12, f"{CUSTOMERS_TOPIC}-key", 1, schemas[12])]
    return log.mapInArrow(encode, "key binary, value binary, topic string, partition int, offset bigint"), spark.createDataFrame(rows, "schema_id int, subject string, version int, schema string")


def customers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_to_changes(table(spark, sf_dir, "customer"), "c_custkey", CUSTOMERS_TOPIC, LOG_PARTITIONS, {"db": "shop", "table": "customers"})


def orders_snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", spread=True).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    return snapshot_to_changes(o, "o_orderkey", ORDERS_TOPIC, LOG_PARTITIONS, {"db": "shop", "table": "orders"})


# ------------------------------------------------------------------ graph ------------


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)`` node edges: region -> nation -> customer -> order."""
    return (
        table(spark, sf_dir, "nation").selectExpr("concat('region:', CAST(n_regionkey AS STRING)) AS src", "concat('nation:', CAST(n_nationkey AS STRING)) AS dst")
        .unionByName(table(spark, sf_dir, "customer").selectExpr("concat('nation:', CAST(c_nationkey AS STRING)) AS src", "concat('customer:', CAST(c_custkey AS STRING)) AS dst"))
        .unionByName(table(spark, sf_dir, "orders", spread=True).selectExpr("concat('customer:', CAST(o_custkey AS STRING)) AS src", "concat('order:', CAST(o_orderkey AS STRING)) AS dst"))
    )


# ------------------------------------------------------------- run events ------------

def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user: ``run-{user_id}``.  Users with ``user_id % 10 = 0`` are orchestrator
    runs (no dataset I/O) and parents of the next nine users' Spark runs.  Backfills are for day ``user_id % 20 + 1`` of January."""
    orch = "user_id % 10 = 0"
    k = "CAST(user_id % 4 AS STRING)"
    no_io = "CAST(array() AS ARRAY<STRUCT<ns: STRING, name: STRING>>)"
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS event_time",
        "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'START' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' "
        "WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' END AS event_type",
        "concat('run-', CAST(user_id AS STRING)) AS run_id",
        f"CASE WHEN NOT ({orch}) THEN concat('run-', CAST(user_id - user_id % 10 AS STRING)) END AS parent_run_id",
        f"CASE WHEN {orch} THEN 'airflow' ELSE 'spark' END AS job_ns",
        f"CASE WHEN {orch} THEN concat('dag_t', {k}) ELSE concat('load_t', {k}) END AS job_name",
        f"CASE WHEN {orch} THEN {no_io} ELSE array(named_struct('ns', 'kafka://kafka:9092', 'name', concat('mysqljson.shop.t', {k}))) END AS inputs",
        f"CASE WHEN {orch} THEN {no_io} ELSE array(named_struct('ns', 's3://poc-warehouse', 'name', concat('poc/shop_t', {k}, '_json'))) END AS outputs",
        "map('run_type', element_at(array('scheduled', 'manual', 'backfill'), CAST(user_id % 3 + 1 AS INT)), "
        "'app_id', concat('app-', CAST(user_id AS STRING)), "
        "'logical_date', CASE WHEN user_id % 3 = 2 THEN concat('2024-01-', lpad(CAST(user_id % 20 + 1 AS STRING), 2, '0')) END) AS facets",
        "concat('inst-', CAST(user_id % 2 AS STRING)) AS instance_id",
        "CASE WHEN user_id % 13 = 0 AND event_id % 2 = 0 THEN 2 ELSE 1 END AS stack_epoch",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sink commits: every purchase event of a Spark run commits one snapshot."""
    ev = table(spark, sf_dir, "events").filter((F.col("event_type") == "purchase") & (F.col("user_id") % 10 != 0))
    u = F.col("user_id")
    return ev.select(
        F.concat(F.lit("poc.shop_t"), (u % 4).cast("string"), F.lit("_json")).alias("table"),
        (F.col("event_id") * 1000003 + 17).alias("snapshot_id"),
        F.col("ts").alias("committed_at"),
        F.lit("overwrite").alias("operation"),
        F.concat(F.lit("app-"), u.cast("string")).alias("app_id"),
        F.concat(F.lit("run-"), u.cast("string")).alias("run_id"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version markers of Spark runs with deliberate gaps.

    binlog (absent when ``user_id % 5 = 1``), kafka_offset = max offset (absent when
    ``user_id % 7 = 2``), snapshot_id = latest commit of the run (absent without commits).
    """
    ev = table(spark, sf_dir, "events").filter(F.col("user_id") % 10 != 0)
    per = ev.groupBy("user_id").agg(
        F.max("event_id").alias("max_offset"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("event_id") * 1000003 + 17)).alias("snap"),
    )
    u = F.col("user_id")
    m = F.array(
        F.when(u % 5 != 1, F.struct(F.lit("mysql").alias("hop"), F.lit("binlog").alias("marker_kind"), F.concat(F.lit("mysql-bin:"), F.col("max_offset").cast("string")).alias("marker_value"))),
        F.when(u % 7 != 2, F.struct(F.lit("kafka").alias("hop"), F.lit("kafka_offset").alias("marker_kind"), F.col("max_offset").cast("string").alias("marker_value"))),
        F.when(F.col("snap").isNotNull(), F.struct(F.lit("sink").alias("hop"), F.lit("snapshot_id").alias("marker_kind"), F.col("snap").cast("string").alias("marker_value"))),
    )
    return per.select(F.concat(F.lit("run-"), u.cast("string")).alias("run_id"), F.explode(F.filter(m, lambda x: x.isNotNull())).alias("m")).select(
        "run_id", "m.hop", "m.marker_kind", "m.marker_value"
    )


# ------------------------------------------------------------ lineage store ----------


def lineage_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four lineage-store tables.

    datasets: parts (``kafka://broker-{p_size % 3}``, name ``p_name``) and suppliers
    (``s3://warehouse-{s_nationkey % 4}``, ``poc/{s_name}``), plus a second uuid for parts
    with ``p_partkey % 97 = 0`` (planted ambiguity).  jobs: customers.  job_versions:
    orders.  io_mapping: lineitems -- odd line numbers read a part (INPUT), even ones
    write a supplier (OUTPUT); current iff ``l_linestatus = 'O'``.
    """
    part = table(spark, sf_dir, "part")
    part_ns = "concat('kafka://broker-', CAST(p_size % 3 AS STRING)) AS namespace_name"
    datasets = (
        part.selectExpr("concat('part-', CAST(p_partkey AS STRING)) AS uuid", part_ns, "p_name AS name")
        .unionByName(part.filter("p_partkey % 97 = 0").selectExpr("concat('part-dup-', CAST(p_partkey AS STRING)) AS uuid", part_ns, "p_name AS name"))
        .unionByName(
            table(spark, sf_dir, "supplier").selectExpr(
                "concat('supp-', CAST(s_suppkey AS STRING)) AS uuid",
                "concat('s3://warehouse-', CAST(s_nationkey % 4 AS STRING)) AS namespace_name",
                "concat('poc/', s_name) AS name",
            )
        )
    )
    jobs = table(spark, sf_dir, "customer").selectExpr(
        "concat('job-', CAST(c_custkey AS STRING)) AS uuid", "concat('spark.', lower(c_mktsegment)) AS namespace_name", "c_name AS name"
    )
    job_versions = table(spark, sf_dir, "orders").selectExpr(
        "concat('jv-', CAST(o_orderkey AS STRING)) AS uuid", "concat('job-', CAST(o_custkey AS STRING)) AS job_uuid"
    )
    io_mapping = table(spark, sf_dir, "lineitem", spread=True).selectExpr(
        "concat('jv-', CAST(l_orderkey AS STRING)) AS job_version_uuid",
        "CASE WHEN l_linenumber % 2 = 1 THEN concat('part-', CAST(l_partkey AS STRING)) ELSE concat('supp-', CAST(l_suppkey AS STRING)) END AS dataset_uuid",
        "CASE WHEN l_linenumber % 2 = 1 THEN 'INPUT' ELSE 'OUTPUT' END AS io_type",
        "l_linestatus = 'O' AS is_current_job_version",
    )
    return {"datasets": datasets, "jobs": jobs, "job_versions": job_versions, "io_mapping": io_mapping}


def job_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared output namespace per job: ``s3://warehouse-{c_nationkey % 4}``."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_uuid"),
        F.concat(F.lit("s3://warehouse-"), (F.col("c_nationkey") % 4).cast("string")).alias("declared_namespace"),
    )
