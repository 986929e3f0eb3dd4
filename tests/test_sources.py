"""Change-log scans, topic routing and the single-file spread guard."""

from pyspark.sql import functions as F

from lakeshift.sources import changelog as cl
from lakeshift.sources import derived as d

SF = "/root/testdata/sf0.001"


def test_include_list_and_routing(spark, scratch):
    log = d.orders_snapshot_log(spark, SF).unionByName(d.events_log(spark, SF))
    cl.write_routed(log, f"{scratch}/log")
    folders = {r["topic"] for r in spark.read.parquet(f"{scratch}/log").select("topic").distinct().collect()}
    assert folders == {d.ORDERS_TOPIC, d.EVENTS_TOPIC}
    only_events = cl.read_changelog(spark, f"{scratch}/log", topics=[d.EVENTS_TOPIC])
    assert only_events.count() == d.table(spark, SF, "events").count()
    assert only_events.columns == cl.LOG_COLUMNS


def test_key_partitioning_keeps_per_key_order(spark):
    log = d.events_log(spark, SF)
    per_key = log.groupBy("key").agg(F.countDistinct("partition").alias("p"))
    assert per_key.filter("p > 1").count() == 0


def test_spread_only_when_under_partitioned(spark):
    par = spark.sparkContext.defaultParallelism
    small = d.ensure_parallelism(spark.read.parquet(f"{SF}/events.parquet"))
    assert small.rdd.getNumPartitions() == par
    wide = spark.range(0, 1000, numPartitions=par * 2)
    assert d.ensure_parallelism(wide) is wide
