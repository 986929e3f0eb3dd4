"""Latest-event-per-key and the declarative, mapping-driven projection.

One mapping (a list of ``ColumnRule``) drives both the ``select`` that builds the stage
and the column-lineage edge rows, so the recorded lineage is exact by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def latest_by_key(
    changes: DataFrame,
    keys: Sequence[str | Column],
    order: Sequence[str] = ("offset",),
    method: str = "agg",
    where: Column | None = None,
    keep_keys: bool = False,
) -> DataFrame:
    """Keep the latest event per primary key (highest ``order``), ties impossible by offset.

    ``method="agg"``: ``max_by(row, order)`` -- a partial aggregate on the map side, so a
    hot key is reduced to one row per input partition before the shuffle.
    ``method="window"``: ``row_number() = 1`` over ``partitionBy(keys)``; Spark inserts a
    partial ``WindowGroupLimit`` before the exchange.  Both keep one row for the NULL key.

    ``where`` restricts the candidates without a Filter node below the ranking (agg: rows
    failing it get a NULL ordering, which ``max_by`` skips; window: they sort last and are
    dropped above the window).  The optimizer therefore cannot push the predicate below an
    expensive decode projection, and the decode runs once per row.

    ``keep_keys`` (agg form) also returns the grouping keys as ``_k0, _k1, ...``; a later
    projection that reads the key from them keeps the aggregate's hash partitioning, so a
    merge join on the key needs no second shuffle of the stage.
    """
    key_cols = _cols(keys)
    names = changes.columns
    if method == "window":
        cand = [F.when(where, 1).otherwise(0).desc()] if where is not None else []
        w = Window.partitionBy(*key_cols).orderBy(*cand, *[F.col(o).desc() for o in order])
        ranked = changes.withColumn("_rn", F.row_number().over(w))
        keep = F.col("_rn") == 1
        if where is not None:
            ranked = ranked.withColumn("_ok", where)
            keep = keep & F.col("_ok")
        return ranked.filter(keep).select(*names)
    ordering = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    if where is not None:
        ordering = F.when(where, ordering)
    out = changes.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key_cols)]).agg(
        F.max_by(F.struct(*[F.col(c) for c in names]), ordering).alias("_row")
    )
    if where is not None:
        out = out.filter(F.col("_row").isNotNull())
    key_out = [F.col(f"_k{i}") for i in range(len(key_cols))] if keep_keys else []
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in names], *key_out)


def duplicate_keys(stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row (hash aggregate with map-side combine)."""
    return stage.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def assert_unique_keys(stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when ``stage`` holds several rows for one key (the MERGE cardinality guard).

    Eager: one aggregate pass that stops at the first offending key.
    """
    if duplicate_keys(stage, keys).limit(1).count() > 0:
        raise ValueError(f"MERGE_CARDINALITY_VIOLATION: duplicate keys {list(keys)} in stage")
    return stage


@dataclass(frozen=True)
class ColumnRule:
    """One output column: SQL expression over the decoded change, and its lineage."""

    out_col: str
    expr: str
    inputs: tuple[str, ...]
    transformation: str = "IDENTITY"
    precision: str = "exact"
    data_type: str | None = None


@dataclass
class TableSpec:
    """Declarative description of one change-log -> table load."""

    table: str
    topic: str
    keys: tuple[str, ...]
    after_ddl: str
    mapping: list[ColumnRule] = field(default_factory=list)
    fmt: str = "json"
    deletes: str = "ignore"  # "ignore" (the last live image wins) or "apply"
    avro_keys: bool = False  # message keys are Avro frames, not JSON
    avro_after: T.StructType | None = None  # reader type of an Avro image, where it is not that of ``after_ddl``

    @property
    def key_paths(self) -> list[str]:
        return [f"after.{k}" for k in self.keys]


def project(
    changes: DataFrame, mapping: Sequence[ColumnRule], extra: Sequence[Column] = (), key_columns: dict[str, str] | None = None
) -> DataFrame:
    """``select`` driven by the mapping (all expressions stay JVM-side); ``extra`` columns
    (e.g. the log offset for newer-wins merges) are appended.  ``key_columns`` maps a rule
    expression (``after.pk``) to an equal grouping column (``_k0``) to read it from."""
    out = []
    for r in mapping:
        src = (key_columns or {}).get(r.expr)
        c = F.col(src) if src else F.expr(r.expr)
        if r.data_type:
            c = c.cast(r.data_type)
        out.append(c.alias(r.out_col))
    return changes.select(*out, *extra)


def mapping_frame(spark: SparkSession, table: str, mapping: Sequence[ColumnRule]) -> DataFrame:
    """The mapping as a DataFrame: one row per output column, inputs as an array."""
    rows = [(table, r.out_col, list(r.inputs), r.transformation, r.precision) for r in mapping]
    schema = "out_table string, out_col string, inputs array<string>, transformation string, precision string"
    return spark.createDataFrame(rows, schema)


def mapping_to_edges(mapping_df: DataFrame) -> DataFrame:
    """Column-lineage edges: one row per (output column, input column)."""
    return mapping_df.select(
        "out_table", "out_col", F.explode("inputs").alias("in_col"), "transformation", "precision"
    )
