"""Avro bodies of one writer schema, read column by column.

A batch holds many bodies of one schema; each field is read of all of them at once with array
operations, from the position where the field before it ended.  Nothing loops over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .avro_binary import parse_schema


def _longs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zig-zag variable-length integers that begin at ``at``, and the positions after them."""
    value = np.zeros(len(at), np.uint64)
    at, open_ = at.copy(), np.ones(len(at), bool)
    for shift in range(0, 70, 7):
        byte = data[at[open_]].astype(np.uint64)
        value[open_] |= (byte & np.uint64(0x7F)) << np.uint64(shift)
        at[open_] += 1
        open_[open_] = byte >= 0x80
        if not open_.any():
            break
    return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64), at


def _spans(data: np.ndarray, at: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The bytes ``data[at : at + size]`` of each row as one binary or string array."""
    ends = np.cumsum(size)
    picked = data[np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    large = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(large, len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())]).cast(kind)


def _decimals(data: np.ndarray, at: np.ndarray, size: np.ndarray, scale: int) -> pa.Array:
    """Big-endian two's complement of up to 16 bytes as decimal128."""
    if len(size) and size.max() > 16:
        raise ValueError("a decimal of more than 16 bytes")
    out = np.zeros((len(at), 16), np.uint8)  # little-endian
    negative = np.zeros(len(at), bool)
    some = size > 0
    negative[some] = data[at[some]] >= 0x80
    out[negative] = 0xFF
    for k in range(int(size.max(initial=0))):
        rows = size > k
        out[rows, k] = data[at[rows] + size[rows] - 1 - k]
    return pa.Array.from_buffers(pa.decimal128(38, scale), len(at), [None, pa.py_buffer(out.tobytes())])


def _read(node: dict, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    kind = node["type"]
    if kind == "record":
        columns = []
        for _, sub in node["fields"]:
            column, at = _read(sub, data, at)
            columns.append(column)
        return pa.StructArray.from_arrays(columns, [name for name, _ in node["fields"]]), at
    if kind == "union":
        branch, at = _longs(data, at)
        ends, parts, where = at.copy(), [], np.full(len(at), -1, np.int64)
        for b, sub in enumerate(node["branches"]):
            rows = np.flatnonzero(branch == b)
            if sub["type"] == "null":
                continue
            column, ends[rows] = _read(sub, data, at[rows])
            where[rows] = sum(map(len, parts)) + np.arange(len(rows))
            parts.append(column)
        if not parts:
            return pa.nulls(len(at)), ends
        joined = pa.concat_arrays(parts) if len(parts) > 1 else parts[0]
        return joined.take(pa.array(where, pa.int64(), mask=where < 0)), ends
    if kind == "null":
        return pa.nulls(len(at)), at
    if kind == "boolean":
        return pa.array(data[at] == 1), at + 1
    if kind in ("float", "double"):
        width = 4 if kind == "float" else 8
        raw = data[at[:, None] + np.arange(width)]
        return pa.array(np.ascontiguousarray(raw).view(f"<f{width}").reshape(-1)), at + width
    value, at = _longs(data, at)
    if kind in ("int", "long"):
        return pa.array(value), at
    if kind == "enum":
        return pa.DictionaryArray.from_arrays(pa.array(value), pa.array(node["symbols"])).cast(pa.string()), at
    if kind == "string":
        return _spans(data, at, value, pa.string()), at + value
    if kind == "bytes":
        column = _decimals(data, at, value, node["scale"]) if "scale" in node else _spans(data, at, value, pa.binary())
        return column, at + value
    raise ValueError(f"unsupported Avro type {kind}")


def read_bodies(schema: str, bodies: pa.Array) -> pa.Array:
    """Bodies without nulls, all written with ``schema``, as one array of the schema's type."""
    bodies = bodies.cast(pa.large_binary())
    ends = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1] if len(bodies) else np.zeros(1, np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8) if len(bodies) else np.zeros(0, np.uint8)
    return _read(parse_schema(schema), data, ends[:-1].copy())[0]


def conform(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A column in the reader's type: struct fields by name, missing ones null, extra ones dropped."""
    if not pa.types.is_struct(kind):
        return column if column.type == kind else column.cast(kind)
    if not pa.types.is_struct(column.type):
        return pa.nulls(len(column), kind)
    have = {column.type.field(i).name: i for i in range(column.type.num_fields)}
    fields = [conform(column.field(have[f.name]), f.type) if f.name in have else pa.nulls(len(column), f.type) for f in kind]
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=column.is_null())
