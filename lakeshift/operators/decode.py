"""Envelope decoding: JSON (``from_json``) and Confluent-framed Avro.

JSON stays JVM-side.  Avro frames are split natively; the bodies are decoded in Arrow batches (``mapInArrow``),
column by column for all rows of a writer schema (``functions/avro_columns``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import avro_columns

SOURCE_DDL = (
    "struct<connector:string,name:string,db:string,table:string,ts_ms:bigint,ts_us:bigint,"
    "ts_ns:bigint,gtid:string,file:string,pos:bigint,snapshot:string>"
)
PASS_COLUMNS = ["key", "topic", "partition", "offset"]


def envelope_ddl(after_ddl: str, *, with_before: bool = False, with_source: bool = False) -> str:
    parts = [f"after:struct<{after_ddl}>", "op:string"]
    if with_before:
        parts.insert(0, f"before:struct<{after_ddl}>")
    if with_source:
        parts.append(f"source:{SOURCE_DDL}")
    return "struct<" + ",".join(parts) + ">"


def decode_json(log: DataFrame, after_ddl: str, *, with_before: bool = False, with_source: bool = False) -> DataFrame:
    """Parse a payload-only JSON envelope with an explicit schema (PERMISSIVE).

    NULL/empty value -> NULL envelope; malformed text -> struct of NULLs; unknown keys are
    ignored.  Only the listed fields are materialised (nested-field pruning).
    """
    schema = envelope_ddl(after_ddl, with_before=with_before, with_source=with_source)
    return log.select(
        F.from_json(F.col("value").cast("string"), schema).alias("envelope"),
        *[c for c in PASS_COLUMNS if c in log.columns],
    )


def flatten_envelope(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``envelope.after``, ``envelope.op`` (+ requested envelope fields) beside the log position."""
    extra = [F.col(f"envelope.{k}").alias(k) for k in keep]
    return parsed.select(
        F.col("envelope.after").alias("after"),
        F.col("envelope.op").alias("op"),
        *extra,
        "topic",
        "partition",
        "offset",
    )


def live_condition() -> F.Column:
    """``after IS NOT NULL AND op != 'd'`` -- tombstones, deletes and NULL ops drop out."""
    return F.col("after").isNotNull() & (F.col("op") != F.lit("d"))


def keep_decoded(df: DataFrame, predicate) -> DataFrame:
    """Filter rows on fields of a decoded envelope without re-decoding.

    ``from_json`` is not whole-stage-codegen'd and a plain ``filter`` on its fields is
    pushed below the decoding projection, re-parsing the value once per predicate.  The
    predicate is applied inside a generator over the already decoded row
    (``inline(filter(array(row), predicate))``), which the optimizer does not push through.
    ``predicate`` maps the row struct to a boolean column.
    """
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), predicate)))


def live_changes(flat: DataFrame) -> DataFrame:
    """Keep live changes (``after`` present, ``op != 'd'``), decoding each envelope once."""
    return keep_decoded(flat, lambda r: r["after"].isNotNull() & (r["op"] != F.lit("d")))


def drop_tombstones(log: DataFrame) -> DataFrame:
    """``value IS NOT NULL`` on the raw log: reaches the scan (``PushedFilters``) and can
    never drop a live change, since a tombstone has no envelope."""
    return log.filter(F.col("value").isNotNull())


# ---------------------------------------------------------------- Avro ---------------


def split_confluent(log: DataFrame) -> DataFrame:
    """Native Confluent frame split: magic byte must be 0, 4-byte big-endian id, payload.

    NULL value (tombstone) -> NULL id and payload.  A non-zero magic byte fails the job.
    """
    v = F.col("value")
    magic_ok = F.hex(F.substring(v, 1, 1)) == F.lit("00")
    schema_id = F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("int")
    checked_id = F.when(v.isNull(), F.lit(None).cast("int")).when(magic_ok, schema_id).otherwise(
        F.raise_error(F.concat(F.lit("frame does not begin with the magic byte 00 but with "), F.hex(F.substring(v, 1, 1)))).cast("int")
    )
    return log.select(
        *PASS_COLUMNS,
        checked_id.alias("schema_id"),
        F.when(v.isNotNull(), F.substring(v, 6, 2147483647)).alias("payload"),
    )


#: Schema texts that are sent to the tasks; a larger registry is joined to the frames by id.
REGISTRY_BYTES = 16 << 20


def with_schema(frames: DataFrame, id_column: str, registry: DataFrame) -> tuple[DataFrame, dict[int, str] | None]:
    """The frames and the schema of each id: as a map when all texts together are small, else as a joined column ``writer_schema``."""
    size = registry.agg(F.coalesce(F.sum(F.octet_length("schema")), F.lit(0))).first()[0]
    if size <= REGISTRY_BYTES:
        return frames, {r["schema_id"]: r["schema"] for r in registry.select("schema_id", "schema").collect()}
    return frames.join(registry.select(F.col("schema_id").alias(id_column), F.col("schema").alias("writer_schema")), id_column, "left"), None


def _arrow_decoder(column: str, kind: pa.DataType, schemas: dict[int, str] | None, keep: list[str], out: pa.Schema):
    """Decode the bodies in ``column``, the rows of one schema id at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(f"{column}_id")
            parts, order = [], []
            for schema_id in ids.unique().to_pylist():
                rows = np.flatnonzero((ids.is_null() if schema_id is None else pc.equal(ids, schema_id).fill_null(False)).to_numpy(zero_copy_only=False))
                order.append(rows)
                if schema_id is None:
                    parts.append(pa.nulls(len(rows), kind))
                    continue
                text = schemas.get(schema_id) if schemas is not None else b.column("writer_schema")[int(rows[0])].as_py()
                if text is None:
                    raise ValueError(f"Unknown schema id: {schema_id}")
                parts.append(avro_columns.conform(avro_columns.read_bodies(text, b.column(column).take(pa.array(rows))), kind))
            back = np.argsort(np.concatenate(order)) if order else np.zeros(0, np.int64)
            decoded = pa.concat_arrays(parts).take(pa.array(back)) if parts else pa.nulls(0, kind)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], decoded], schema=out)

    return run


def _decode_bodies(frames: DataFrame, column: str, kind: T.DataType, name: str, registry: DataFrame) -> DataFrame:
    """Replace ``column`` (bodies) and ``{column}_id`` by the decoded column ``name``."""
    frames, schemas = with_schema(frames, f"{column}_id", registry)
    keep = [c for c in frames.columns if c not in (column, f"{column}_id", "writer_schema")]
    out = T.StructType([*[frames.schema[c] for c in keep], T.StructField(name, kind)])
    arrow = to_arrow_schema(out)
    return frames.mapInArrow(_arrow_decoder(column, arrow.field(name).type, schemas, keep, arrow), out)


def decode_avro(frames: DataFrame, after_type: T.StructType, registry: DataFrame) -> DataFrame:
    """Decode schemaless Avro bodies (``split_confluent`` output) to ``envelope: struct<after, op>`` with the reader type.

    Fields the writer has and the reader lacks are dropped; fields the reader has and the writer lacks are NULL;
    an id that the registry does not have fails the job.  Only ids and bodies go to the tasks.
    """
    envelope = T.StructType([T.StructField("after", after_type), T.StructField("op", T.StringType())])
    return _decode_bodies(frames.withColumnRenamed("schema_id", "payload_id"), "payload", envelope, "envelope", registry)


def decode_avro_key(df: DataFrame, key_type: T.StructType, registry: DataFrame) -> DataFrame:
    """Decode Confluent-framed message keys (column ``key``) to ``_key: key_type``."""
    k = F.col("key")
    framed = df.withColumn("_body_id", F.conv(F.hex(F.substring(k, 2, 4)), 16, 10).cast("int")).withColumn("_body", F.substring(k, 6, 2147483647)).drop("key")
    return _decode_bodies(framed, "_body", key_type, "_key", registry)
