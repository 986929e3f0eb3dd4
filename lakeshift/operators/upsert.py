"""Upsert into a versioned table, with a snapshot table and version markers.

Catalog tables that support row-level operations get a ``MERGE INTO``.  Otherwise a load adds its stage to the table as one
folder, written by ``DataFrameWriter`` with as many tasks as the stage has partitions, and then one row to the snapshot
table: that row is the commit, and carries the load's counts, the offset ranges that it consumed and its version
markers, so none of them can be there without the others.  A load that dies before its row has changed nothing; when it runs
again under the same load id it overwrites its own folder.

Stored rows carry the log offset of their change (``_offset``) and a delete flag (``_deleted``).  A version of a table is the newest
row of each key over its loads.  That does not depend on the order of the loads, so batch loads and streams, also several at a
time, may write one table without locks or retries: an older image can neither overwrite nor revive a newer state.
``compact`` writes the newest rows as one load that stands for the earlier ones; loads do it every ``COMPACT_EVERY`` of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_root

RANGES = "array<struct<topic:string,partition:int,start_offset:bigint,end_offset:bigint>>"
MARKERS = "array<struct<hop:string,marker_kind:string,marker_value:string>>"
SNAPSHOT_DDL = (
    "table string, version bigint, snapshot_id bigint, committed_at timestamp_ntz, operation string, inserted bigint, updated bigint, deleted bigint, kept bigint, "
    f"app_id string, batch_id bigint, load_id string, keys array<string>, replaces array<string>, run_id string, consumed {RANGES}, markers {MARKERS}"
)
MARKER_DDL = "run_id string, hop string, marker_kind string, marker_value string"
HIDDEN_DDL = "_offset bigint, _deleted boolean"
#: Loads of a table that a reader merges, at most; the next load writes them as one.
COMPACT_EVERY = 32


def merge_upsert(target: DataFrame, stage: DataFrame, keys: Sequence[str], with_action: bool = False, order_col: str | None = None) -> DataFrame:
    """``MERGE ... WHEN MATCHED UPDATE * WHEN NOT MATCHED INSERT *`` as one full-outer join.

    Matched rows take every stage value, unconditionally without ``order_col``; with it, unless the
    target's order is greater (a NULL order is older than any).  Unmatched stage rows are inserted, target rows
    without a stage row are kept.  A NULL key never matches: such rows go around the join, so they
    cannot pile up in one of its partitions.  The planner chooses how to join; the result does not depend on sizes.
    ``_action`` = insert / update / keep.
    """
    cols = target.columns
    vals = [c for c in cols if c not in keys]
    stage = stage.select(*cols)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    t = target.filter(~null_key).select(*keys, F.struct(F.lit(True).alias("_in"), *vals).alias("_t"))
    s = stage.filter(~null_key).select(*keys, F.struct(F.lit(True).alias("_in"), *vals).alias("_s"))
    j = t.join(s, list(keys), "full_outer")
    take = F.col("_s").isNotNull()
    if order_col:
        older = F.col("_t").isNull() | F.col(f"_t.{order_col}").isNull() | (F.col(f"_s.{order_col}") >= F.col(f"_t.{order_col}"))
        take = take & F.coalesce(older, F.lit(False))
    action = F.when(~take, F.lit("keep")).when(F.col("_t").isNull(), F.lit("insert")).otherwise(F.lit("update"))
    merged = j.select(*keys, *[F.when(take, F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c) for c in vals], action.alias("_action")).select(*cols, "_action")
    merged = merged.unionByName(target.filter(null_key).select(*cols, F.lit("keep").alias("_action")))
    merged = merged.unionByName(stage.filter(null_key).select(*cols, F.lit("insert").alias("_action")))
    return merged if with_action else merged.drop("_action")


def merge_changes(target: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newer offset wins, deletes included: the merge of stored rows with a stage, with ``_action``.

    A staged delete marks its key (and keeps its offset); a delete of a key that is not there is kept as a mark
    too, because an older image may still come.  The action counts a newly marked row as ``delete``.
    """
    merged = merge_upsert(target, stage, keys, with_action=True, order_col="_offset")
    action = F.when((F.col("_action") != "keep") & F.col("_deleted"), F.lit("delete")).otherwise(F.col("_action"))
    return merged.withColumn("_action", action)


def merge_actions(merged_with_action: DataFrame) -> DataFrame:
    """Writer metadata of one merge: rows per action."""
    return merged_with_action.groupBy("_action").agg(F.count(F.lit(1)).alias("row_count")).withColumnRenamed("_action", "action")


# ----------------------------------------------------------- versioned tables --------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _snapshot_path(root: str) -> str:
    return f"{root}/_snapshots"


def _marker_path(root: str) -> str:
    return f"{root}/_markers"


def load_path(root: str, table: str, load_id: str) -> str:
    return f"{root}/{table}/_load={load_id}"


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot table; empty only when there is none.  Any other read error is raised."""
    if not _exists(spark, _snapshot_path(root)):
        return spark.createDataFrame([], SNAPSHOT_DDL)
    return spark.read.schema(SNAPSHOT_DDL).parquet(_snapshot_path(root))


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """The markers that were committed with snapshots, and those of catalog tables."""
    of_loads = read_snapshots(spark, root).select("run_id", F.inline("markers"))
    if not _exists(spark, _marker_path(root)):
        return of_loads
    return of_loads.unionByName(spark.read.schema(MARKER_DDL).parquet(_marker_path(root)))


def consumed_ranges(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``run_id, topic, partition, start_offset, end_offset`` of every load of the table."""
    return read_snapshots(spark, root).filter(F.col("table") == table).select("run_id", F.inline("consumed"))


def current_snapshots(snaps: DataFrame) -> DataFrame:
    """Current snapshot per table: latest ``committed_at``, ties broken by ``snapshot_id``."""
    return snaps.groupBy("table").agg(
        F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id")).alias("snapshot_id"),
        F.max("committed_at").alias("committed_at"),
    )


@dataclass(frozen=True)
class TableState:
    """A version of a table: its number, snapshot id, key columns and the loads that it consists of."""

    version: int = 0
    snapshot_id: int | None = None
    keys: tuple[str, ...] = ()
    loads: tuple[str, ...] = ()


def table_state(spark: SparkSession, root: str, table: str, snapshot_id: int | None = None) -> TableState:
    """The current version, or that of ``snapshot_id``; version 0 when there is none.  One row per load comes back."""
    rows = read_snapshots(spark, root).filter(F.col("table") == table).select("version", "committed_at", "snapshot_id", "load_id", "keys", "replaces").collect()
    rows.sort(key=lambda r: (r["version"], r["committed_at"], r["snapshot_id"]))
    if snapshot_id is not None:
        at = [i for i, r in enumerate(rows) if r["snapshot_id"] == snapshot_id]
        rows = rows[: at[0] + 1] if at else []
    if not rows:
        return TableState()
    gone = {x for r in rows for x in r["replaces"] or ()}
    loads = tuple(r["load_id"] for r in rows if r["load_id"] is not None and r["load_id"] not in gone)
    return TableState(rows[-1]["version"], rows[-1]["snapshot_id"], tuple(rows[-1]["keys"] or ()), loads)


def current_snapshot(spark: SparkSession, root: str, table: str) -> int:
    """A table's current snapshot id; raises when there is none."""
    state = table_state(spark, root, table)
    if state.snapshot_id is None:
        raise RuntimeError(f"table {table} has no snapshot")
    return state.snapshot_id


def committed(spark: SparkSession, root: str, table: str, load_id: str) -> bool:
    """Is this load in the table already?  (Replay guard for streams.)"""
    return not read_snapshots(spark, root).filter((F.col("table") == table) & (F.col("load_id") == load_id)).isEmpty()


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the greatest offset of each key (none is the least; of equal ones that of the greatest load id).  Rows with a
    NULL key never match another: all of them stay, around the aggregate."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    vals = [c for c in rows.columns if c not in keys]
    order = F.struct(F.coalesce("_offset", F.lit(-(2**63))), "_load")
    best = rows.filter(~null_key).groupBy(*keys).agg(F.max_by(F.struct(*vals), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
    return best.unionByName(rows.filter(null_key))


Resolve = Callable[[DataFrame, Sequence[str]], DataFrame]


def _schema(ddl: T.StructType | str, hidden: bool) -> T.StructType:
    s = ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)
    extra = T.StructType.fromDDL(HIDDEN_DDL).fields if hidden else []
    return T.StructType([*s.fields, *[f for f in extra if f.name not in s.fieldNames()]])


def _stored_rows(spark: SparkSession, root: str, table: str, state: TableState, schema: T.StructType, resolve: Resolve = newest) -> DataFrame:
    """One row per key of a version, deleted ones included.  A single load has one row per key already."""
    if not state.loads:
        return spark.createDataFrame([], schema)
    paths = [load_path(root, table, x) for x in state.loads]
    rows = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths).withColumn("_load", F.col("_load").cast("string"))
    return (rows if len(paths) == 1 else resolve(rows, state.keys)).select(*schema.fieldNames())


def read_version(spark: SparkSession, root: str, table: str, snapshot_id: int | None, schema: T.StructType | str, resolve: Resolve = newest) -> DataFrame:
    """Rows of one version (None: the current one), without deleted ones; an empty frame of ``schema`` if there is none."""
    state = table_state(spark, root, table, snapshot_id)
    rows = _stored_rows(spark, root, table, state, _schema(schema, resolve is newest), resolve)
    if resolve is newest:
        rows = rows.filter(~F.coalesce("_deleted", F.lit(False)))
    return rows.select(*_schema(schema, False).fieldNames())


def read_current(spark: SparkSession, root: str, table: str, schema: T.StructType | str, resolve: Resolve = newest) -> DataFrame:
    return read_version(spark, root, table, None, schema, resolve)


def _commit(spark: SparkSession, root: str, table: str, version: int, operation: str, app_id: str, **row) -> int:
    """Add one row to the snapshot table; returns its snapshot id."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    sid = uuid.uuid4().int >> 65
    row = {"inserted": 0, "updated": 0, "deleted": 0, "kept": 0} | row
    row |= {"table": table, "version": version, "snapshot_id": sid, "committed_at": now, "operation": operation, "app_id": app_id or spark.sparkContext.applicationId}
    row["markers"] = [*row.get("markers", ()), ("topic->table", "snapshot_id", str(sid))] if operation not in ("create", "compact") else []
    fields = T.StructType.fromDDL(SNAPSHOT_DDL).fieldNames()
    spark.createDataFrame([tuple(row.get(f) for f in fields)], SNAPSHOT_DDL).coalesce(1).write.mode("append").parquet(_snapshot_path(root))
    return sid


def ensure_table(spark: SparkSession, root: str, table: str, app_id: str = "", keys: Sequence[str] = ()) -> None:
    """``CREATE TABLE IF NOT EXISTS``: an empty first version when there is none."""
    if table_state(spark, root, table).version == 0:
        _commit(spark, root, table, 1, "create", app_id, keys=list(keys))


def action_counts(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Rows per action of a merge by offset, from the keys, offsets and flags alone."""
    slim = [*keys, "_offset", "_deleted"]
    merged = merge_changes(target.select(*slim), staged.select(*slim), keys)
    return {r["_action"]: r["n"] for r in merged.groupBy("_action").agg(F.count(F.lit(1)).alias("n")).collect()}


def merge_into_table(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType | str,
    staged: DataFrame,
    keys: Sequence[str],
    resolve: Resolve = newest,
    operation: str = "merge",
    app_id: str = "",
    batch_id: int | None = None,
    load_id: str | None = None,
    run_id: str = "",
    consumed: Sequence[tuple] = (),
    markers: Sequence[tuple] = (),
) -> int:
    """Add a materialised stage (one row per key) to the table and commit it; returns the snapshot id.

    With the default ``resolve`` the newer offset wins, deletes included, and the snapshot row counts the actions.
    """
    ensure_table(spark, root, table, app_id, keys)
    state = table_state(spark, root, table)
    if len(state.loads) >= COMPACT_EVERY:
        compact(spark, root, table, schema, resolve, app_id)
        state = table_state(spark, root, table)
    full = _schema(schema, resolve is newest)
    load = load_id or uuid.uuid4().hex
    staged.select(*full.fieldNames()).write.mode("overwrite").parquet(load_path(root, table, load))
    counts = action_counts(_stored_rows(spark, root, table, state, full), staged, keys) if resolve is newest else {}
    n = {name: counts.get(a, 0) for name, a in (("inserted", "insert"), ("updated", "update"), ("deleted", "delete"), ("kept", "keep"))}
    rest = {"batch_id": batch_id, "load_id": load, "keys": list(keys), "run_id": run_id or app_id or spark.sparkContext.applicationId, "consumed": list(consumed), "markers": list(markers)}
    return _commit(spark, root, table, state.version + 1, operation, app_id, **n, **rest)


def compact(spark: SparkSession, root: str, table: str, schema: T.StructType | str, resolve: Resolve = newest, app_id: str = "") -> int | None:
    """Write the newest rows as one load that stands for those it was made of; loads committed meanwhile are not among them."""
    state = table_state(spark, root, table)
    if not state.loads:
        return None
    rows = _stored_rows(spark, root, table, state, _schema(schema, resolve is newest), resolve)
    load = uuid.uuid4().hex
    rows.write.parquet(load_path(root, table, load))
    return _commit(spark, root, table, state.version + 1, "compact", app_id, load_id=load, keys=list(state.keys), replaces=list(state.loads))


def record_marker(spark: SparkSession, root: str, run_id: str, hop: str, kind: str, value: str) -> None:
    """A marker of a catalog table, whose snapshots are the catalog's."""
    spark.createDataFrame([(run_id, hop, kind, value)], MARKER_DDL).coalesce(1).write.mode("append").parquet(_marker_path(root))


def supports_merge(spark: SparkSession, table_name: str) -> bool:
    """True when ``table_name`` is a catalog table whose provider accepts ``MERGE INTO``."""
    if not spark.catalog.tableExists(table_name):
        return False
    provider = spark.sql(f"DESCRIBE TABLE EXTENDED {table_name}").filter(F.col("col_name") == "Provider").first()
    return provider is not None and str(provider["data_type"]).lower() in {"delta", "iceberg", "hudi"}


def merge_into_catalog(spark: SparkSession, table_name: str, staged: DataFrame, keys: Sequence[str]) -> None:
    """Row-level ``MERGE INTO`` for catalog tables that support it, with the same meaning: newer offset wins, deletes mark.

    The catalog table has the ``_offset`` and ``_deleted`` columns like any other table here."""
    view = f"_stage_{uuid.uuid4().hex[:8]}"
    staged.createOrReplaceTempView(view)
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    spark.sql(f"MERGE INTO {table_name} AS t USING {view} AS s ON {on} WHEN MATCHED AND (t._offset IS NULL OR s._offset >= t._offset) THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    spark.catalog.dropTempView(view)


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint()
