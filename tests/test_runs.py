"""Store folded from events, and run chains, against brute force."""

import random

from lakeshift.lineage.chains import complete_runs, contained_in, run_chains
from lakeshift.lineage.graph import current_edges
from lakeshift.lineage.store import run_versions, store_from_events

EVENTS = "event_time string, event_type string, run_id string, job_ns string, job_name string, inputs array<struct<ns:string,name:string>>, outputs array<struct<ns:string,name:string>>"


def events(spark, rows):
    """Rows of ``(time, type, run, job, inputs, outputs)``, datasets as strings of letters."""
    io = lambda names: None if names is None else [("n", x) for x in names]
    return spark.createDataFrame([(f"2024-01-{t:02d}", k, r, "ns", j, io(i), io(o)) for t, k, r, j, i, o in rows], EVENTS)


ROWS = [
    (1, "START", "r1", "load", "ab", None), (2, "COMPLETE", "r1", "load", "b", "x"),
    (3, "START", "r2", "load", "", "x"), (4, "RUNNING", "r2", "load", "b", ""), (5, "COMPLETE", "r2", "load", "a", "x"),  # the set of r1, in another order
    (6, "COMPLETE", "r3", "load", "abc", "x"), (7, "START", "r4", "load", "abcd", "x"), (8, "FAIL", "r4", "load", "abcd", "x"),
    (1, "START", "r5", "never", "a", "y"), (1, "COMPLETE", "r6", "idle", None, None), (9, "COMPLETE", None, "ghost", "q", None),
]


def test_store_from_events(spark):
    store = store_from_events(events(spark, ROWS))
    of = {r["run_id"]: r["job_version_uuid"] for r in run_versions(events(spark, ROWS).filter("run_id IS NOT NULL")).collect()}
    assert of["r1"] == of["r2"] and len(set(of.values())) == 5
    assert store["datasets"].count() == 6 and store["jobs"].count() == 3 and store["job_versions"].count() == 5
    edges = {(r["job"], r["dataset"], r["io_type"]) for r in current_edges(store["datasets"], store["jobs"], store["job_versions"], store["io_mapping"]).collect()}
    assert edges == {("ns:load", f"n:{x}", "INPUT") for x in "abc"} | {("ns:load", "n:x", "OUTPUT")}  # r3 is the last that completed
    again = ROWS + [(10, "COMPLETE", "r7", "load", "ba", "x")]  # the first set is current again, under its old uuid
    io = store_from_events(events(spark, again))["io_mapping"].filter("is_current_job_version").select("job_version_uuid").distinct().collect()
    assert of["r1"] in [r[0] for r in io]
    shuffled = random.Random(2).sample(ROWS, len(ROWS))
    for name, df in store_from_events(events(spark, shuffled)).items():
        assert sorted(map(str, df.collect())) == sorted(map(str, store[name].collect()))


def test_containment_equals_brute_force(spark):
    rnd = random.Random(3)
    inner = [(f"i{n}", rnd.choice("ab"), s := rnd.randint(0, 5000), s + rnd.choice([0, 1, 1, 7, 200])) for n in range(300)]
    outer = [(f"o{n}", rnd.choice("ab"), s := rnd.randint(0, 5000), s + rnd.choice([0, 1, 3, 64, 500, 4000, 2**40])) for n in range(80)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, g string, start_offset long, end_offset long")
    got = contained_in(frame(inner, "i"), frame(outer, "o"), ["g"], ["o"])
    want = {(i, o) for i, g, a, b in inner for o, h, c, e in outer if g == h and a < b and c <= a and b <= e}
    assert sorted((r["i"], r["o"]) for r in got.collect()) == sorted(want) and len(want) > 500
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan


def test_chains_stay_in_one_deployment(spark):
    dep = "instance_id string, stack_epoch int, topic string, partition int, start_offset long, end_offset long"
    consumed = spark.createDataFrame(
        [("r1", "i", 1, "t", 0, 10, 20), ("r1", "i", 2, "t", 0, 10, 20), ("r2", "i", 1, "t", 0, 95, 105), ("r3", "i", 1, "t", 1, 0, 5), ("r4", "j", 1, "t", 0, 10, 20), ("r5", "i", 1, "t", 0, 30, 40)], f"run_id string, {dep}"
    )
    produced = spark.createDataFrame([("c1", "s.t", "i", 1, "t", 0, 0, 100), ("c2", "s.t", "i", 1, "t", 0, 100, 200), ("c3", "s.t", "i", 1, "t", 1, 0, 9)], f"connector_run_id string, source string, {dep}")
    snaps = spark.createDataFrame([(r, i, e, n) for n, (r, i, e) in enumerate([("r1", "i", 1), ("r1", "i", 2), ("r2", "i", 1), ("r4", "j", 1), ("r5", "i", 1), ("r5", "i", 1)])], "run_id string, instance_id string, stack_epoch int, snapshot_id long")
    chains = run_chains(consumed, produced, snaps)
    got = {(r["run_id"], r["stack_epoch"]): (r["connector_run_id"], r["snapshot_id"], r["whole"]) for r in chains.collect()}
    assert got == {("r1", 1): ("c1", 0, True), ("r1", 2): (None, 1, False), ("r2", 1): (None, 2, False), ("r3", 1): ("c3", None, False), ("r4", 1): (None, 3, False), ("r5", 1): ("c1", 5, True)}
    markers = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r1", "b"), ("r5", "a"), ("r2", "a"), ("r2", "b")], "run_id string, marker_kind string")
    assert [tuple(r) for r in complete_runs(chains, markers, ["a", "b"]).collect()] == [("r1", "i", 1)]


def test_facets_of_any_shape(spark):
    import json

    from lakeshift.lineage.facets import facet_column_edges, facet_problems

    use = lambda name, *kinds: {"namespace": "k", "name": "src", "field": name, "transformations": [{"type": t} for t in kinds]}
    doc = lambda *outs: json.dumps({"job": {"namespace": "s", "name": "j"}, "outputs": list(outs)})
    out = lambda fields, *columns: {"namespace": "w", "name": "t", "facets": {"columnLineage": {"fields": fields}, "schema": {"fields": [{"name": c} for c in columns]}}}
    rows = [
        doc(out({"a": {"inputFields": [use("x", "INDIRECT")]}, "b": {"inputFields": []}, "odd key.$": {"inputFields": [use("y")]}}, "a", "b", "c")),
        doc(out({"a": {"inputFields": [use("x", "INDIRECT", "DIRECT")]}, "b": {"inputFields": 7}}, "a"), out([1], "a"), {"name": "bare"}),
        doc(out({}, "a")), doc(out(None)), doc({"facets": {"columnLineage": None}}), doc(), json.dumps({"job": 3, "outputs": {}}), "[]", "", "{cut", None,
    ]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {(r["out_col"], r["in_col"]): (r["precision"], r["n_claims"], r["in_name"], r["out_name"]) for r in facet_column_edges(lines).collect()}
    assert got == {("a", "x"): ("exact", 2, "src", "t"), ("b", None): ("lost", 2, None, "t"), ("odd key.$", "y"): ("inferred", 1, "src", "t")}
    found = {r["job_name"]: tuple(r)[2:] for r in facet_problems(lines).collect()}
    assert found["j"] == (6, 0, 2, 2 + 1 + 1) and sum(n for n, *_ in found.values()) == 10 and sum(bad for _, bad, *_ in found.values()) == 2
    assert facet_column_edges(lines.limit(0)).count() == 0 and facet_problems(lines.limit(0)).count() == 0
