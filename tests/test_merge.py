"""Upsert semantics, versioned table, idempotence and incremental == full load."""

import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakeshift.lineage import audit
from lakeshift.operators import upsert
from lakeshift.operators.transform import assert_unique_keys
from lakeshift.plans import loader
from lakeshift.sources import changelog as cl
from lakeshift.sources import derived as d

SF = "/root/testdata/sf0.001"
DDL = "k int, v string"


def test_merge_semantics(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], DDL)
    s = spark.createDataFrame([(2, "b"), (3, "c"), (None, "m")], DDL)
    out = {(r["k"], r["v"], r["_action"]) for r in upsert.merge_upsert(t, s, ["k"], with_action=True).collect()}
    assert out == {(1, "a", "keep"), (2, "b", "update"), (3, "c", "insert"), (None, "n", "keep"), (None, "m", "insert")}


def test_merge_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], DDL)
    s = spark.createDataFrame([(2, "x"), (3, "c")], DDL)
    once = upsert.merge_upsert(t, s, ["k"])
    twice = upsert.merge_upsert(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_newer_offset_wins(spark):
    ddl = "k int, v string, _offset bigint"
    t = spark.createDataFrame([(1, "new", 10), (2, "old", 1), (4, "kept", 3), (5, "unknown", None)], ddl)
    s = spark.createDataFrame([(1, "stale", 5), (2, "fresh", 7), (3, "ins", 1), (5, "known", 2)], ddl)
    got = upsert.merge_upsert(t, s, ["k"], with_action=True, order_col="_offset")
    out = {r["k"]: (r["v"], r["_action"]) for r in got.collect()}
    assert out == {1: ("new", "keep"), 2: ("fresh", "update"), 3: ("ins", "insert"), 4: ("kept", "keep"), 5: ("known", "update")}


def test_cardinality_guard(spark):
    with pytest.raises(ValueError, match="CARDINALITY"):
        assert_unique_keys(spark.createDataFrame([(1, "a"), (1, "b")], DDL), ["k"])


@pytest.mark.parametrize("cut_div", [2, 3, 7])
def test_incremental_equals_full_load(spark, cut_div):
    log = d.events_log(spark, SF)
    spec = loader.events_spec("json")
    r = cl.offset_ranges(log)
    cut = r.select("topic", "partition", F.floor((F.col("end_offset") - 1) / cut_div).cast("bigint").alias("c"))
    first = cl.restrict_offsets(log, cut.select("topic", "partition", F.lit(0).cast("bigint").alias("start_offset"), F.col("c").alias("end_offset")))
    second = cl.restrict_offsets(log, cut.select("topic", "partition", F.col("c").alias("start_offset"), F.lit(None).cast("bigint").alias("end_offset")))
    inc = upsert.merge_upsert(loader.stage(first, spec), loader.stage(second, spec), ["user_id"])
    full = loader.stage(log, spec)
    assert inc.exceptAll(full).count() == 0 and full.exceptAll(inc).count() == 0


STAGED = "k int, v string, _offset bigint, _deleted boolean"


def put(spark, root, rows, table="t", **kw):
    return upsert.merge_into_table(spark, root, table, DDL, upsert.materialised(spark.createDataFrame(rows, STAGED)), ["k"], **kw)


def rows_of(spark, root, table="t"):
    return sorted(map(tuple, upsert.read_current(spark, root, table, DDL).collect()))


def test_versioned_table(spark, scratch):
    sid0 = put(spark, scratch, [(1, "a", 1, False)])
    assert upsert.current_snapshot(spark, scratch, "t") == sid0
    sid1 = put(spark, scratch, [(1, "b", 2, False), (2, "c", 1, False)], app_id="app", batch_id=5, load_id="app-5")
    assert sid1 != sid0 and upsert.current_snapshot(spark, scratch, "t") == sid1
    assert rows_of(spark, scratch) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, upsert.read_version(spark, scratch, "t", sid0, DDL).collect())) == [(1, "a")]
    log = upsert.read_snapshots(spark, scratch).filter(F.col("snapshot_id") == sid1).first()
    assert (log["version"], log["inserted"], log["updated"], log["kept"]) == (3, 1, 1, 0)
    assert upsert.committed(spark, scratch, "t", "app-5") and not upsert.committed(spark, scratch, "t", "app-6")
    with pytest.raises(RuntimeError):
        upsert.current_snapshot(spark, scratch, "missing")


def test_older_batch_neither_overwrites_nor_revives(spark, scratch):
    put(spark, scratch, [(1, "at 50", 50, False), (2, "at 10", 10, False), (3, "x", 1, False)])
    put(spark, scratch, [(1, "at 3", 3, False), (2, None, 20, True), (9, None, 5, True)])
    assert rows_of(spark, scratch) == [(1, "at 50"), (3, "x")]
    put(spark, scratch, [(2, "at 15", 15, False), (9, "at 4", 4, False)])
    assert rows_of(spark, scratch) == [(1, "at 50"), (3, "x")]
    put(spark, scratch, [(2, "at 30", 30, False)])
    assert rows_of(spark, scratch) == [(1, "at 50"), (2, "at 30"), (3, "x")]
    deleted = [r["deleted"] for r in upsert.read_snapshots(spark, scratch).orderBy("version").collect()]
    assert deleted == [0, 0, 2, 0, 0]


def test_a_load_writes_its_stage_with_as_many_tasks_as_it_has_partitions(spark, scratch):
    rows = spark.range(0, 5000, 1, 24).selectExpr("CAST(id AS int) AS k", "'a' AS v", "1L AS _offset", "false AS _deleted")
    upsert.merge_into_table(spark, scratch, "t", DDL, upsert.materialised(rows), ["k"], load_id="big")
    put(spark, scratch, [(7, "b", 2, False)], load_id="small")
    files = lambda load: len([f for f in os.listdir(upsert.load_path(scratch, "t", load)) if f.endswith(".parquet")])
    assert files("big") == 24 and files("small") <= 4
    assert len(rows_of(spark, scratch)) == 5000 and (7, "b") in rows_of(spark, scratch)


def test_a_writer_that_died_blocks_nobody(spark, scratch, monkeypatch):
    put(spark, scratch, [(1, "a", 1, False)])

    def dies(*_, **__):
        raise OSError("gone")

    monkeypatch.setattr(upsert, "_commit", dies)
    with pytest.raises(OSError):
        put(spark, scratch, [(1, "half", 9, False), (5, "half", 9, False)], load_id="x")
    monkeypatch.undo()
    assert rows_of(spark, scratch) == [(1, "a")]  # what it wrote is in no version
    put(spark, scratch, [(2, "b", 1, False)])
    put(spark, scratch, [(1, "whole", 9, False)], load_id="x")  # runs again, over what it left
    assert rows_of(spark, scratch) == [(1, "whole"), (2, "b")]
    assert {r["marker_kind"] for r in upsert.read_markers(spark, scratch).collect()} == {"snapshot_id"} and upsert.read_markers(spark, scratch).count() == 3


def test_compaction_keeps_rows_and_versions(spark, scratch, monkeypatch):
    monkeypatch.setattr(upsert, "COMPACT_EVERY", 3)
    for i in range(8):
        sid = put(spark, scratch, [(i % 3, f"v{i}", i, i == 4), (None, f"n{i}", i, False)])
        if i == 1:
            early = sid
    assert len(upsert.table_state(spark, scratch, "t").loads) <= 3
    got = sorted(map(str, upsert.read_current(spark, scratch, "t", DDL).collect()))
    assert got == sorted(map(str, [Row(k=0, v="v6"), Row(k=1, v="v7"), Row(k=2, v="v5"), *[Row(k=None, v=f"n{i}") for i in range(8)]]))
    assert sorted(r["v"] for r in upsert.read_version(spark, scratch, "t", early, DDL).collect()) == ["n0", "n1", "v0", "v1"]


def test_a_failed_log_read_is_raised(spark, scratch, monkeypatch):
    put(spark, scratch, [(1, "a", 1, False)])

    def fails(*_):
        raise OSError("transient")

    monkeypatch.setattr(upsert, "_exists", fails)
    with pytest.raises(OSError):
        put(spark, scratch, [(2, "b", 1, False)])
    monkeypatch.undo()
    assert rows_of(spark, scratch) == [(1, "a")]


def test_load_refuses_a_stage_with_two_rows_of_a_key(spark, scratch, monkeypatch):
    spec = loader.events_spec("json")
    stage = loader.stage_changes
    monkeypatch.setattr(loader, "stage_changes", lambda *a: stage(*a).unionByName(stage(*a)))
    with pytest.raises(ValueError, match="CARDINALITY"):
        loader.load_table(spark, spec, d.events_log(spark, SF), scratch, loader.EVENTS_SINK_DDL)
    assert upsert.table_state(spark, scratch, spec.table).version == 0


def test_load_table_twice_is_idempotent_on_rows(spark, scratch):
    spec = loader.events_spec("json")
    log = d.events_log(spark, SF)
    loader.load_table(spark, spec, log, scratch, loader.EVENTS_SINK_DDL)
    first = upsert.read_current(spark, scratch, spec.table, loader.EVENTS_SINK_DDL).collect()
    loader.load_table(spark, spec, log, scratch, loader.EVENTS_SINK_DDL)
    second = upsert.read_current(spark, scratch, spec.table, loader.EVENTS_SINK_DDL).collect()
    assert sorted(first) == sorted(second)
    assert upsert.read_snapshots(spark, scratch).filter(F.col("table") == spec.table).count() == 3  # create + 2 merges


def test_stage_views_for_sql(spark):
    views = loader.register_stage_views(d.events_log(spark, SF), loader.events_spec("json"), "ev")
    assert views == ["ev_flat", "ev_dedup", "ev_stage"]
    n_stage = spark.sql("SELECT COUNT(*) FROM ev_stage").first()[0]
    assert n_stage == spark.sql("SELECT COUNT(DISTINCT after.user_id) FROM ev_dedup").first()[0] > 0


def test_writers_at_the_same_time_lose_nothing(spark, scratch, monkeypatch):
    put(spark, scratch, [(1, "a", 1, False)])
    counts, once = upsert.action_counts, []

    def while_counting(*args):
        if not once:  # another writer commits between this writer's read and its commit
            once.append(1)
            put(spark, scratch, [(3, "c", 1, False), (2, "newer", 5, False)])
        return counts(*args)

    monkeypatch.setattr(upsert, "action_counts", while_counting)
    put(spark, scratch, [(2, "b", 1, False)])
    assert rows_of(spark, scratch) == [(1, "a"), (2, "newer"), (3, "c")]


def test_a_second_load_reads_nothing_that_the_first_consumed(spark, scratch, monkeypatch):
    spec, log = loader.events_spec("json"), d.events_log(spark, SF).filter("offset % 10 <> 3")
    part = log.filter("(offset < 300 OR offset BETWEEN 500 AND 600) AND partition <> 1")
    ddl = loader.EVENTS_SINK_DDL
    loader.load_table(spark, spec, part.filter("offset < 300"), scratch, ddl, run_id="a", resume=True)
    loader.load_table(spark, spec, part.filter("offset >= 500"), scratch, ddl, run_id="b", resume=True)
    seen = []
    stage = loader.stage_changes
    monkeypatch.setattr(loader, "stage_changes", lambda df, *a: (seen.append(df), stage(df, *a))[1])
    loader.load_table(spark, spec, log, scratch, ddl, run_id="c", resume=True)
    loader.load_table(spark, spec, log, scratch, ddl, run_id="d", resume=True)
    read = {r[0] for r in seen[0].select("offset").collect()}
    assert read == {r[0] for r in log.select("offset").collect()} - {r[0] for r in part.select("offset").collect()}
    assert seen[1].count() == 0
    want = loader.stage(log, spec)
    got = upsert.read_current(spark, scratch, spec.table, ddl)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    assert audit.missing_markers(runs, upsert.read_markers(spark, scratch)).count() == 0
    left = cl.resume_ranges(upsert.consumed_ranges(spark, scratch, spec.table)).collect()
    assert len([r for r in left if r["end_offset"] is None]) == 3


def covered(ranges, at):
    return sum(s <= at and (e is None or at < e) for s, e in ranges)


def test_range_arithmetic_equals_brute_force(spark):
    rnd = random.Random(6)
    rows = [("t", p, s := rnd.randint(0, 60), None if rnd.random() < 0.05 else s + rnd.randint(0, 9)) for p in range(6) for _ in range(rnd.randint(1, 9))]
    other = [("t", p, s := rnd.randint(0, 60), s + rnd.randint(0, 20)) for p in range(7) for _ in range(4)]
    frame = lambda x: spark.createDataFrame(x, cl.RANGE_DDL)
    of = lambda x, p: [(r[-2], r[-1]) for r in x if r[1] == p]
    left, rest, gaps = (x.collect() for x in (cl.subtract_ranges(frame(rows), frame(other)), cl.resume_ranges(frame(rows)), cl.offset_gaps(frame(rows))))
    log = spark.createDataFrame([("t", p, o) for p in range(8) for o in range(90)], "topic string, partition int, offset long")
    out = {(r["partition"], r["offset"]) for r in cl.exclude_offsets(log, frame(rows)).collect()}
    for p in range(8):
        mine, minus = of(rows, p), of(other, p)
        ends = [e for _, e in mine]
        for at in range(90):
            n = covered(mine, at)
            assert covered(of(left, p), at) == (n > 0 and covered(minus, at) == 0)
            assert covered(of(rest, p), at) == (n == 0 and p < 6)
            assert ((p, at) in out) == (n == 0)
            full = [r for r in mine if r[1] is None or r[0] < r[1]]
            inside = bool(full) and min(s for s, _ in full) <= at and (None in ends or at < max(e for _, e in full))
            assert covered([(r["start_offset"], r["end_offset"]) for r in gaps if r["partition"] == p and r["kind"] == "gap"], at) == (inside and n == 0)
            assert covered([(r["start_offset"], r["end_offset"]) for r in gaps if r["partition"] == p and r["kind"] == "overlap"], at) == (n > 1)
