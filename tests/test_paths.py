"""As-of identities, retention by offsets and bottleneck paths against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lakeshift.lineage.audit import column_path_precision
from lakeshift.lineage.events import run_of_record
from lakeshift.lineage.graph import bottleneck, strong_components
from lakeshift.lineage.identity_map import as_of_join, sink_identity_as_of
from lakeshift.lineage.outages import run_outages
from lakeshift.lineage.retention import oldest_consumed, retention_by_offsets


def test_as_of_equals_brute_force_over_many_slices(spark):
    rnd = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(n, rnd.choice(keys), rnd.choice([None, *range(400)])) for n in range(1500)] + [(7, "hot", 11)] * 3
    versions = [(rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, *range(0, 400, 9)]), n, f"v{n}") for n in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would otherwise share one slice
    try:
        frame = as_of_join(spark.createDataFrame(rows, "id int, k string, at int"), spark.createDataFrame(versions, "k string, at int, no int, v string"), ["k"], "at", ["v", "no"], "no")
        got = sorted(map(str, (tuple(r) for r in frame.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])

    def newest(k, at):
        seen = [(t, no, v) for key, t, no, v in versions if None not in (k, at, key, t) and key == k and t <= at]
        return (max(seen)[2], max(seen)[1]) if seen else (None, None)

    assert got == sorted(str((i, k, at, *newest(k, at))) for i, k, at in rows)


def test_as_of_empty_sides(spark):
    rows, versions = spark.createDataFrame([(1, "a", 5)], "id int, k string, at int"), spark.createDataFrame([("a", 5, 1)], "k string, at int, no int")
    join = lambda r, v: [tuple(x) for x in as_of_join(r, v, ["k"], "at", ["no"], "no").collect()]
    assert join(rows, versions) == [(1, "a", 5, 1)]  # a version counts from its own time on
    assert join(rows, versions.limit(0)) == [(1, "a", 5, None)] and join(rows.limit(0), versions) == []


def test_identity_status(spark):
    uid = lambda c: f"_{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}"
    ids = spark.createDataFrame([("t", 10, 1, "c.n.t", "poc/t" + uid("a")), ("t", 20, 2, "c.n.t", "poc/t" + uid("b")), ("t", 20, 3, "c.n.t", "poc/t" + uid("c"))], "table string, observed_at int, snapshot_id int, physical_table string, storage_in_force string")
    outs = [("t", "poc/t" + uid("a"), 9), ("t", "poc/t" + uid("a"), 10), ("t", "poc/t" + uid("a"), 20), ("t", "poc/t" + uid("c"), 25), ("t", "poc/t", 25), ("t", "poc/u", 25), ("t", None, 25), ("u", "poc/u", 25)]
    got = sink_identity_as_of(spark.createDataFrame(outs, "table string, storage_name string, observed_at int"), ids)
    got = {(r["table"], r["storage_name"], r["observed_at"]): (r["status"], r["snapshot_id"]) for r in got.collect()}
    want = [("unknown", None), ("current", 1), ("stale", 3), ("current", 3), ("stale", 3), ("foreign", 3), ("foreign", 3), ("unknown", None)]
    assert got == dict(zip(outs, want, strict=True))


def test_oldest_consumed_equals_a_scan(spark):
    rnd = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    messages = [("t", rnd.choice([0, 0, 0, 1]), o, day + dt.timedelta(seconds=rnd.randint(0, 10**6))) for o in rnd.sample(range(4000), 1500)]
    ranges = [(n, "t", rnd.choice([0, 1, 2]), a := rnd.randint(0, 4200), a + rnd.choice([-3, 0, 1, 7, 8, 9, 64, 500, 3000])) for n in range(300)]
    ranges += [(300 + n, "t", 0, 0, e) for n, e in enumerate([1, 7, 8, 9, 4000, 2**33])]
    frames = spark.createDataFrame(ranges, "range_id int, topic string, partition int, start_offset long, end_offset long"), spark.createDataFrame(messages, "topic string, partition int, offset long, ts timestamp_ntz")
    want = {}
    for n, _, p, a, b in ranges:
        seen = [ts for _, q, o, ts in messages if q == p and a <= o < b]
        if seen:
            want[n] = min(seen)
    for step in (1, 8):
        got = {r["range_id"]: r["oldest"] for r in oldest_consumed(*frames, step=step).collect()}
        assert got == want and len(want) > 100
    plan = oldest_consumed(*frames)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_backfill_stands_for_its_own_date(spark):
    when = lambda day: dt.datetime(2024, 2, day)
    rows = [
        ("s1", "job", "scheduled", None, when(1)), ("s2", "job", "scheduled", None, when(9)),
        ("b1", "job", "backfill", dt.date(2024, 2, 1), when(9)),  # does not overwrite the scheduled run of its date
        ("b2", "job", "backfill", dt.date(2024, 2, 5), when(9)), ("b3", "job", "backfill", dt.date(2024, 2, 5), when(10)),
        ("m1", "job", "manual", dt.date(2024, 2, 5), when(8)), ("b4", "job", "backfill", dt.date(2024, 2, 7), when(9)), ("b5", "other", "backfill", dt.date(2024, 2, 1), when(9)),
    ]
    got = run_of_record(spark.createDataFrame(rows, "run_id string, job_name string, run_type string, logical_date date, started_at timestamp_ntz")).collect()
    assert len(got) == len(rows) and {r["run_id"] for r in got if r["is_run_of_record"]} == {"s1", "s2", "m1", "b4", "b5"}
    assert {r["run_id"]: r["logical_date"].day for r in got}["b1"] == 1


def test_retention_rule(spark):
    at = lambda h: dt.datetime(2024, 1, 10) - dt.timedelta(hours=h)
    messages = spark.createDataFrame([("t", 0, 0, at(30)), ("t", 0, 1, at(9)), ("t", 0, 2, at(8))], "topic string, partition int, offset long, ts timestamp_ntz")
    snaps = spark.createDataFrame([("a", 1, at(5)), ("a", 2, at(4)), ("b", 3, at(3)), ("b", 4, at(20)), ("c", 5, at(1))], "table string, snapshot_id int, committed_at timestamp_ntz")
    ranges = spark.createDataFrame([(1, "t", 0, 0, 2), (2, "t", 0, 2, 3), (3, "t", 0, 1, 3), (4, "t", 0, 0, 1), (5, "t", 0, 3, 9)], "range_id int, topic string, partition int, start_offset long, end_offset long")
    got = {r["snapshot_id"]: r for r in retention_by_offsets(snaps, ranges, messages, "2024-01-10 00:00:00", topic_hours=24, snapshot_hours=12).collect()}
    flags = {n: (r["lag_seconds"], r["live"], r["replayable"], r["violation"], r["safe"]) for n, r in got.items()}
    h = 3600
    assert flags == {
        1: (25 * h, True, False, True, False), 2: (4 * h, True, True, False, False),  # its table's worst lag is 25 hours
        3: (6 * h, True, True, False, True), 4: (10 * h, False, False, False, True), 5: (None, True, True, False, True),
    }
    assert got[2]["worst_lag_seconds"] == 25 * h and got[5]["worst_lag_seconds"] is None


def test_bottleneck_equals_brute_force_with_cycles(spark):
    rnd = random.Random(13)
    edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.randrange(3)) for _ in range(34)]
    roots = ["n0", "n1", "n2", "nowhere"]
    frame = spark.createDataFrame(edges, "src string, dst string, rank int")
    seeds = spark.createDataFrame([(r,) for r in roots], "root string")
    for direction in ("down", "up"):
        arcs = edges if direction == "down" else [(b, a, r) for a, b, r in edges]
        want = {}
        for root in roots:
            for limit in (2, 1, 0):  # what edges up to a rank reach, the strictest last
                reached, todo = set(), [root]
                while todo:
                    here = todo.pop()
                    for a, b, r in arcs:
                        if a == here and r <= limit and b not in reached:
                            reached.add(b)
                            todo.append(b)
                want |= {(root, node): limit for node in reached}
        got = {(r["root"], r["node"]): r["rank"] for r in bottleneck(frame, seeds, direction).collect()}
        assert got == want and {0, 1, 2} <= set(want.values())


def test_path_precision_of_unequal_paths(spark):
    edges = [("s", "a", "exact"), ("a", "out", "lost"), ("s", "b", "exact"), ("b", "c", None), ("c", "out", "exact"), ("c", "out", "lost"), ("x", "out", "lost")]
    got = column_path_precision(spark.createDataFrame(edges, "src string, dst string, precision string"), spark.createDataFrame([("out",), ("alone",)], "out_col string"))
    assert {(r["out_col"], r["in_col"]): r["precision"] for r in got.collect()} == {
        ("out", "a"): "lost", ("out", "c"): "exact", ("out", "b"): "inferred", ("out", "s"): "inferred", ("out", "x"): "lost",
    }


def test_strong_components_equal_the_closure(spark):
    rnd = random.Random(21)
    chain = [(f"c{n:02}", f"c{n - 1:02}") for n in range(30, 0, -1)]  # long, no cycle
    ring = [(f"r{n}", f"r{(n + 1) % 9}") for n in range(9)]
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(52)] + chain + ring + ring[:2] + [("c00", "r3"), ("s", "s"), ("r1", "r1"), ("s", "t"), (None, "t"), ("t", None)]
    arcs = {(a, b) for a, b in edges if a and b}

    def closure(pairs):
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        return reach

    plain = closure(arcs)
    want = {a: min(b for b in {x for p in arcs for x in p} if (a, b) in plain and (b, a) in plain) for a, b in plain if a == b}
    rows = [tuple(r) for r in strong_components(spark.createDataFrame(edges, "src string, dst string")).select("node", "component").collect()]
    got = dict(rows)
    assert got == want and len(got) == len(rows) and want["r4"] == "r0" and want["s"] == "s" and "c05" not in want
    # the condensed graph reaches what the plain one does
    name = lambda n: got.get(n, n)
    condensed = closure({(name(a), name(b)) for a, b in arcs if name(a) != name(b)})
    assert condensed == {(name(a), name(b)) for a, b in plain if name(a) != name(b)}


def test_graphs_without_a_cycle(spark):
    frame = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert strong_components(frame).count() == 0 and strong_components(frame.limit(0)).count() == 0


def test_outages_equal_brute_force(spark, monkeypatch):
    from lakeshift.lineage import outages

    monkeypatch.setattr(outages, "SLICES", 2)
    rnd = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    beats = [(rnd.choice(["hot", "hot", "hot", "a"]), day + dt.timedelta(minutes=20 * rnd.randrange(900)), False) for _ in range(260)]
    beats += [("done", day, False), ("done", day + dt.timedelta(days=5), True), ("edge", day, None), ("edge", day + dt.timedelta(hours=2), False), (None, day, False), ("none", None, True)]
    until = day + dt.timedelta(days=14)
    columns = "run_id string, at timestamp_ntz, ended boolean"

    def brute(rows):
        out = []
        for run in {r for r, at, _ in rows if r and at}:
            mine = sorted((at, bool(end)) for r, at, end in rows if r == run and at)
            for (a, _), (b, _) in zip(mine, mine[1:]):
                if b - a >= dt.timedelta(hours=2):
                    out.append((run, a, b, int((b - a).total_seconds())))
            if not mine[-1][1] and until - mine[-1][0] >= dt.timedelta(hours=2):
                out.append((run, mine[-1][0], None, int((until - mine[-1][0]).total_seconds())))
        return sorted(out, key=str)

    found = lambda rows: sorted((tuple(r) for r in run_outages(spark.createDataFrame(rows, columns), str(until)).collect()), key=str)
    want = brute(beats)
    assert found(beats) == want and len([w for w in want if w[0] == "hot"]) > 20 and ("edge", day, day + dt.timedelta(hours=2), 7200) in want
    # a late heartbeat in the middle closes a gap
    run, a, b, seconds = next(w for w in want if w[2] and 7200 < w[3] < 14400 and w[0] == "hot")
    late = [*beats, (run, a + dt.timedelta(seconds=seconds // 2), False)]
    assert found(late) == brute(late) and (run, a, b, seconds) not in found(late)
    assert found([]) == []


def test_columns_of_the_path_query_are_numbers(spark):
    """Pairs of long names cost a shuffle of names a round; numbers come back as names at the end, brands too."""
    from lakeshift.plans import queries_paths as paths

    edges, sinks, brands = paths.column_graph(spark, "/root/testdata/sf0.001")
    assert [edges.schema[c].dataType.simpleString() for c in ("src", "dst")] == ["bigint"] * 2 and sinks.schema["out_col"].dataType.simpleString() == "bigint"
    got = paths.q_column_path_precision(spark, "/root/testdata/sf0.001")
    kinds = {r[0]: r[1] for r in got.groupBy(F.split("in_col", "[|]")[0]).count().collect()}
    assert set(kinds) == {"brand", "part", "order"} and got.filter("in_col is null or out_col is null").isEmpty()
    named = {r[0] for r in got.select(F.expr("substring(in_col, 7)")).filter(F.col("in_col").startswith("brand|")).distinct().collect()}
    assert named <= {r.p_brand for r in brands.collect()}
