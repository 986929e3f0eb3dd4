"""Identities versioned by snapshot: which physical table stood behind a logical name when a run wrote to it.

``as_of_join`` gives each row the newest version at or before its time.  Keys are few and hot (a run writes to one of a few tables),
so rows are dealt by range of ``(key, time)``: a key that holds a third of all rows fills many slices.  Inside a slice the
newest version is carried forward; what a slice starts with comes from the last version of the slices before it, of which a slice
needs at most one, as only its first key can have begun earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import storage_to_logical
from ..session import scratch_path


def as_of_join(rows: DataFrame, versions: DataFrame, on: list[str], at: str, carry: list[str], tie: str) -> DataFrame:
    """``rows`` with ``carry`` of the newest of ``versions`` with the same ``on`` whose ``at`` is not after theirs; else null.

    Of versions with one time the greatest ``tie`` counts.  A null in ``on`` or ``at`` meets nothing.  Every row comes out once, repeated
    rows as often as they came.
    """
    spark = rows.sparkSession
    flat = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    known = versions.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*on, at]))
    v = known.select(*on, at, F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.lit(0).cast("long").alias("_spread"), F.struct(*carry).alias("_version"))
    r = rows.select(*on, at, F.lit(1).alias("_kind"), F.xxhash64(*flat).alias("_spread"), F.struct(*rows.columns).alias("_row"))
    dealt = v.unionByName(r, allowMissingColumns=True).repartitionByRange(*on, at, "_kind", "_tie", "_spread")
    path = scratch_path(spark, "as-of")  # slices are numbered once, so that a retried task finds the same ones
    dealt = dealt.withColumn("_slice", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    newest = F.max_by("_version", F.when(F.col("_kind") == 0, F.struct(at, "_tie")))
    ends = dealt.groupBy("_slice", *on).agg(newest.alias("_end"))
    earlier = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice of the key
    starts = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).filter("_start IS NOT NULL").select("_slice", *on, "_start")
    forward = Window.partitionBy("_slice", *on).orderBy(at, "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.withColumn("_seen", F.last("_version", ignorenulls=True).over(forward)).filter("_kind = 1")
    found = met.join(starts, ["_slice", *on], "left").withColumn("_found", F.coalesce("_seen", "_start"))
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in carry])


def sink_identity_as_of(outputs: DataFrame, identities: DataFrame) -> DataFrame:
    """Outputs ``table, storage_name, observed_at`` and more, with the identity in force: ``snapshot_id, physical_table, storage_in_force``, and ``status``.

    ``identities`` hold ``table, observed_at, snapshot_id, physical_table, storage_in_force``, one row whenever a snapshot gave the table a
    new identity.  ``status``: ``current`` where the run named the storage in force, ``stale`` where it named another storage of the same logical
    table (``_<uuid>`` suffixes stripped), ``foreign`` where the names differ without them, ``unknown`` before the first version.
    """
    joined = as_of_join(outputs, identities, ["table"], "observed_at", ["snapshot_id", "physical_table", "storage_in_force"], "snapshot_id")
    same_table = storage_to_logical("storage_name") == storage_to_logical("storage_in_force")
    status = (
        F.when(F.col("storage_in_force").isNull(), F.lit("unknown"))
        .when(F.col("storage_name") == F.col("storage_in_force"), F.lit("current"))
        .when(same_table, F.lit("stale"))
        .otherwise(F.lit("foreign"))
    )
    return joined.withColumn("status", status)
