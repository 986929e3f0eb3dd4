"""Exact deduplication by a stateful stream (native: DataFrame operations only).

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  The documents are read as a stream of files; a streaming
aggregate keyed by the digest of the normalised text keeps, in RocksDB (on the executors'
disks, snapshots in the shared checkpoint folder) and without a watermark, so that
nothing ever expires, one fixed-size row per distinct text:

* the digest (SHA-256 of the normalised UTF-8 text),
* the stable identifier and content locator of the row that stays (code points of its
  original text, ``doc_id``, path of the file that holds it),
* the number of rows seen.

The aggregate combines on the map side first, so a text that holds a third of all rows
sends one row per input partition.  A micro-batch appends the state rows it changed to a
table in the shared folder; the newest row of a digest is its state.

A hit is never trusted on its digest alone: the full normalised bytes of every member of a
group of two or more are compared with those of the row that stays, which is found by its
locator.  Groups with a mismatch (a digest collision) are regrouped by their bytes.  Large
groups are dealt out by a salt; the row that stays is repeated once per salt.

Defined results: null text counts as empty; empty texts (and texts of white space only)
form one group; ties by code points go to the smallest ``doc_id`` (null ids last); rows that
repeat a ``doc_id`` are all returned, and of identical rows one stays; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshift.session import scratch_path

from .common import WHITE, stored, text_of

#: Members of a group that are compared with one copy of the row that stays.
ROWS_PER_SALT = 5_000
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small state stores: files of their size, not of a preallocated one
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def _session_conf(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE + "+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def run_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over every file at ``path`` and return the state: one row per digest
    ``(digest, n, rank, keep_id, locator)``.  ``checkpoint`` names a folder to resume from, so that
    later files only add to the state."""
    schema = spark.read.parquet(path).schema
    root = checkpoint or scratch_path(spark, "llm", "dedup")
    out = f"{root}/state"
    rank = F.struct(F.char_length(text_of()).alias("points"), F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("minus_id"), F.col("doc_id").alias("keep_id"), F.col("_metadata.file_path").alias("locator"))
    with _session_conf(spark, _CONF):
        source = spark.readStream.schema(schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        # as a pattern, the path may be one file or a folder
        rows = source.parquet(f"{path[:-1]}[{path[-1]}]").select(digest(normalised(text_of())).alias("digest"), rank.alias("rank"))
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")).start()
        query.awaitTermination()
    fields = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    try:
        seen = spark.read.schema(fields).parquet(f"{out}/b=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):  # no file, so no batch
            raise
        seen = spark.createDataFrame([], fields)
    newest = seen.groupBy("digest").agg(F.max_by(F.struct("n", "rank"), "batch").alias("s"))
    return newest.select("digest", F.col("s.n").alias("n"), F.col("s.rank.keep_id").alias("keep_id"), F.col("s.rank.points").alias("keep_points"), F.col("s.rank.locator").alias("locator"))


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, locator``."""
    state = stored(run_state(spark, path, digest, files_per_batch), "dedup-state")
    docs = spark.read.parquet(path).select("doc_id", text_of().alias("text"))
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), F.char_length("text").alias("points"))
    rows = rows.groupBy("doc_id", "digest", "text_sha256", "points").agg(F.count(F.lit(1)).alias("copies"))

    # the whole bytes of every row whose digest was hit, against those of the row that stays
    hits = state.filter("n > 1").select("digest", "keep_id", "keep_points", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"))
    members = docs.select("doc_id", digest(norm).alias("digest"), norm.alias("norm"), F.char_length("text").alias("points")).join(hits, "digest")
    members = stored(members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "points"), F.col("salts")).cast("int")), "dedup-hits")
    kept = members.filter(_stays()).groupBy("digest").agg(F.max("salts").alias("salts"), F.max("norm").alias("kept_norm"))
    kept = kept.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differs = members.join(kept, ["digest", "salt"], "left").filter(~F.col("norm").eqNullSafe(F.col("kept_norm")))
    collided = stored(differs.select("digest").distinct(), "dedup-collisions")

    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "locator"]
    if not collided.isEmpty():
        clash = members.join(collided, "digest", "left_semi").select("doc_id", "norm", "points")
        rank = F.struct("points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))))
        groups = clash.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.max_by("doc_id", rank).alias("keep_id"), F.max("points").alias("keep_points"))
        groups = groups.select(sha256(F.col("norm")).alias("text_sha256"), "n", "keep_id", "keep_points", F.lit(None).cast("string").alias("locator"))
        clean = rows.join(collided, "digest", "left_anti").join(state, "digest").drop("digest")
        rows = rows.join(collided, "digest", "left_semi").drop("digest").join(groups, "text_sha256")
        joined = clean.unionByName(rows)
    else:
        joined = rows.join(state, "digest")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.withColumn("kept", _stays() & (F.col("copy") == 1)).withColumn("group_size", F.col("n")).select(*cols)
