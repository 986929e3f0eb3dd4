"""Change capture from table versions."""

from pyspark.sql import functions as F

from lakeshift.operators.decode import decode_json
from lakeshift.sources import changelog as cl

DDL = "k bigint, v string"


def test_table_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], DDL)
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], DDL)
    log = cl.table_diff_to_changes(old, new, "k", "t", 3)
    env = decode_json(log, "k bigint, v string", with_before=True)
    rows = sorted((r["offset"], r["envelope"]["op"] if r["envelope"] else None) for r in env.collect())
    ops = [o for _, o in rows]
    assert sorted(o for o in ops if o) == ["c", "d", "u"] and ops.count(None) == 1
    d_off = [off for off, o in rows if o == "d"][0]
    assert (d_off + 1, None) in rows  # tombstone right after the delete


def test_snapshot_changes(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(10)], DDL)
    log = cl.snapshot_to_changes(df, "k", "t", 3)
    r = log.select("partition", "offset", F.get_json_object(F.col("value").cast("string"), "$.op").alias("op")).collect()
    assert {x["op"] for x in r} == {"r"}
    assert len({(x["partition"], x["offset"]) for x in r}) == 10
    assert sorted(cl.offset_ranges(log).select("messages").collect()) == [(3,), (3,), (4,)]


def test_restrict_offsets_pushes_to_scan(spark, scratch):
    rows = [(b"k", b"v", "t", p, o) for p in range(2) for o in range(100)]
    spark.createDataFrame(rows, cl.LOG_DDL).write.parquet(scratch)
    ranges = spark.createDataFrame([("t", 0, 10, 20), ("t", 1, 90, None)], "topic string, partition int, start_offset bigint, end_offset bigint")
    got = cl.read_changelog(spark, scratch, offsets=ranges)
    assert got.count() == 20
    assert "offset" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:400]


def test_captures_go_on_after_the_log(spark):
    from lakeshift.operators.transform import latest_by_key

    v = [spark.createDataFrame(rows, DDL) for rows in ([(-1, "a"), (2, "a"), (5, "a")], [(-1, "a"), (2, "b"), (7, "b")], [(-1, "c"), (2, "c"), (7, "b")])]
    log = cl.snapshot_to_changes(v[0], "k", "t", 3)
    for old, new in zip(v, v[1:]):
        log = log.unionByName(cl.table_diff_to_changes(old, new, "k", "t", 3, log=log))
    assert log.select("partition", "offset").distinct().count() == log.count()
    assert log.filter("offset < 0").isEmpty()
    flat = decode_json(log, DDL).select(F.from_json(F.col("key").cast("string"), "k bigint").alias("_key"), "envelope.after", "offset")
    got = {(r["_key"]["k"], r["after"]["v"] if r["after"] else None) for r in latest_by_key(flat, ["_key.k"]).collect()}
    assert got == {(-1, "c"), (2, "c"), (5, None), (7, "b")}


def test_string_and_composite_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 40}", i // 40, str(i)) for i in range(200)], "a string, b int, v string")
    log = cl.snapshot_to_changes(rows, ["a", "b"], "t", 4)
    assert log.select("partition", "offset").distinct().count() == 200
    diff = cl.table_diff_to_changes(rows, rows.filter("b > 0"), ["a", "b"], "t", 4, log=log)
    parts = {r["key"]: r["partition"] for r in log.collect()}
    ends = {r["partition"]: r["end_offset"] for r in cl.offset_ranges(log).collect()}
    after = diff.collect()
    assert len(after) == 80 and all(r["partition"] == parts[r["key"]] and r["offset"] >= ends[r["partition"]] for r in after)


def test_overlapping_ranges_keep_rows_once_on_either_side_of_the_limit(spark, monkeypatch):
    log = spark.createDataFrame([(b"k", b"v", "t", 0, o, "x") for o in range(20)], cl.LOG_DDL + ", extra string")
    ranges = [("t", 0, 2, 6), ("t", 0, 4, 8), ("t", 0, 15, None), ("t", 1, 0, None)]
    few = sorted(r["offset"] for r in cl.restrict_offsets(log, ranges).collect())
    monkeypatch.setattr(cl, "MAX_PREDICATE_RANGES", 1)
    many = cl.restrict_offsets(log, ranges)
    assert sorted(r["offset"] for r in many.collect()) == few == [2, 3, 4, 5, 6, 7, 15, 16, 17, 18, 19]
    assert many.columns == log.columns


def test_broker_offsets(spark):
    import json

    r = spark.createDataFrame([("t", 0, 5, 9), ("t", 0, 20, 30), ("t", 1, 2, None)], "topic string, partition int, start_offset bigint, end_offset bigint")
    o = cl.kafka_offsets(r)
    assert json.loads(o["startingOffsets"]) == {"t": {"0": 5, "1": 2}} and json.loads(o["endingOffsets"]) == {"t": {"0": 30, "1": -1}}
