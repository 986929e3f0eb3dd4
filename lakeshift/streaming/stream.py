"""Structured Streaming: change log files -> ``foreachBatch`` upsert into the versioned table.

* ``stream_changelog``: ``readStream`` over a parquet drop folder with the change-log
  layout (or a Kafka topic when the connector is on the classpath).
* ``stream_upsert``: every micro-batch is staged (decode -> live -> latest per key),
  merged newer-offset-wins and committed under the stream's identity (from its checkpoint) and its ``batch_id``;
  a replayed batch is skipped, so the sink is idempotent under retries.  Checkpoint identity, batch id and consumed offset
  ranges are the stream hop's version markers, committed with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..operators.transform import TableSpec
from ..plans import loader
from ..sources.changelog import LOG_COLUMNS, LOG_DDL, offset_ranges


def stream_changelog(spark: SparkSession, source: str, fmt: str = "parquet", max_files_per_trigger: int = 1, options: dict | None = None) -> DataFrame:
    if fmt == "kafka":
        opts = {"kafka.bootstrap.servers": source, "startingOffsets": "earliest"}
        opts.update(options or {})
        return spark.readStream.format("kafka").options(**opts).load().select(*LOG_COLUMNS)
    return spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was made: another checkpoint is another stream."""
    meta = spark.read.text(f"{checkpoint.rstrip('/')}/metadata")
    return meta.select(F.get_json_object("value", "$.id").alias("id")).filter("id IS NOT NULL").first()["id"]


def load_of(stream: str, batch_id: int) -> str:
    return f"{stream}-{batch_id}"


def upsert_batch(spark: SparkSession, batch: DataFrame, batch_id: int, spec: TableSpec, root: str, sink_ddl: str, run_id: str, stream: str) -> None:
    """One micro-batch: skip if this stream already committed it, else add it as a load of its own.

    The load is named by the stream's identity and the batch id, so a batch that is replayed overwrites or finds its own load and
    no other stream's.  Its snapshot row carries the consumed offset ranges and the batch's markers.
    """
    load = load_of(stream, batch_id)
    if upsert.committed(spark, root, spec.table, load):
        return
    batch = upsert.materialised(batch)
    consumed = sorted(tuple(r) for r in offset_ranges(batch).select("topic", "partition", "start_offset", "end_offset").collect())
    staged = upsert.materialised(loader.stage_changes(batch, spec))
    markers = [*loader.load_markers(batch, spec, consumed), ("stream", "checkpoint", stream), ("stream", "batch_id", str(batch_id))]
    upsert.merge_into_table(
        spark, root, spec.table, sink_ddl, staged, list(spec.keys), operation="stream-merge", app_id=run_id, batch_id=batch_id, load_id=load, run_id=run_id, consumed=consumed, markers=markers
    )


def stream_upsert(
    spark: SparkSession,
    log_dir: str,
    spec: TableSpec,
    root: str,
    sink_ddl: str,
    checkpoint: str,
    run_id: str = "stream",
    max_files_per_trigger: int = 1,
    available_now: bool = True,
):
    """Start the streaming upsert; with ``available_now`` it drains the folder and stops."""
    stream = stream_changelog(spark, log_dir, max_files_per_trigger=max_files_per_trigger)
    run = lambda df, bid: upsert_batch(spark, df, bid, spec, root, sink_ddl, run_id, stream_identity(spark, checkpoint))
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_table(spark: SparkSession, root: str, spec: TableSpec, sink_ddl: str) -> DataFrame:
    return upsert.read_current(spark, root, spec.table, sink_ddl)


def write_log_files(log: DataFrame, path: str, files: int) -> None:
    """Drop a change log as ``files`` parquet files in offset order (a topic-shaped folder)."""
    log.repartitionByRange(files, F.col("offset")).sortWithinPartitions("offset").write.mode("error").parquet(path)
