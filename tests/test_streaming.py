"""Streaming upsert == batch load; a replayed batch id is a no-op."""

from pyspark.sql import functions as F

from lakeshift.lineage import audit
from lakeshift.operators import upsert
from lakeshift.plans import loader
from lakeshift.sources import derived as d
from lakeshift.streaming.stream import current_table, stream_identity, stream_upsert, upsert_batch, write_log_files

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replay_is_noop(spark, scratch):
    log_dir = f"{scratch}/log"
    write_log_files(d.events_log(spark, SF), log_dir, 3)
    spec = loader.events_spec("json")
    q = stream_upsert(spark, log_dir, spec, f"{scratch}/tables", loader.EVENTS_SINK_DDL, f"{scratch}/_ckpt")
    q.awaitTermination()
    got = current_table(spark, f"{scratch}/tables", spec, loader.EVENTS_SINK_DDL)
    want = loader.stage(d.events_log(spark, SF), spec)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    snaps = upsert.read_snapshots(spark, f"{scratch}/tables")
    n = snaps.count()
    stream = stream_identity(spark, f"{scratch}/_ckpt")
    upsert_batch(spark, spark.read.parquet(log_dir), 0, spec, f"{scratch}/tables", loader.EVENTS_SINK_DDL, "stream", stream)
    assert upsert.read_snapshots(spark, f"{scratch}/tables").count() == n
    per_batch = upsert.read_markers(spark, f"{scratch}/tables").filter("hop = 'stream'").groupBy("marker_kind").count().collect()
    assert {r["marker_kind"]: r["count"] for r in per_batch} == {"checkpoint": n - 1, "batch_id": n - 1}
    assert audit.missing_markers(spark.createDataFrame([("stream",)], "run_id string"), upsert.read_markers(spark, f"{scratch}/tables")).count() == 0


def test_two_streams_into_one_table(spark, scratch):
    """Two logs, two checkpoints, one table, both under the default run id: the second stream is no replay of the first."""
    spec, log = loader.events_spec("json"), d.events_log(spark, SF)
    for i in (0, 1):
        log.filter(f"partition % 2 = {i}").coalesce(1).write.parquet(f"{scratch}/log{i}")
        stream_upsert(spark, f"{scratch}/log{i}", spec, f"{scratch}/tables", loader.EVENTS_SINK_DDL, f"{scratch}/ck{i}").awaitTermination()
    got, want = current_table(spark, f"{scratch}/tables", spec, loader.EVENTS_SINK_DDL), loader.stage(log, spec)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_run_state_stream_takes_late_events(spark, scratch):
    from lakeshift.streaming.run_state import read_run_state, stream_run_state, with_stale

    slices = [
        [("2024-01-20 00:00:00", 9, "START", "b"), ("2024-01-01 00:00:00", 1, "START", "a")],
        [("2024-01-02 00:00:00", 2, "COMPLETE", "a"), ("2024-01-19 00:00:00", 3, "RUNNING", "b"), (None, 4, "RUNNING", "c")],
        [("2024-01-05 00:00:00", 5, "START", "d")],
    ]
    for rows in slices:
        ev = spark.createDataFrame(rows, "event_time string, seq bigint, event_type string, run_id string")
        ev.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{scratch}/ev")
        q = stream_run_state(spark, f"{scratch}/ev", spark.read.parquet(f"{scratch}/ev").schema, f"{scratch}/t", f"{scratch}/ck")
        q.awaitTermination()
    got = {r["run_id"]: r for r in with_stale(read_run_state(spark, f"{scratch}/t")).collect()}
    assert (got["a"]["state"], str(got["a"]["started_at"]), str(got["a"]["ended_at"]), got["a"]["stale"]) == ("COMPLETE", "2024-01-01 00:00:00", "2024-01-02 00:00:00", False)
    assert (got["b"]["state"], got["b"]["stale"], got["c"]["state"], got["d"]["stale"]) == ("START", False, "RUNNING", True)
