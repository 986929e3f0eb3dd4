"""Avro schemas, and an encoder for the change logs that ``sources/derived.py`` makes (a log's writer is not this library).

Reading is in ``avro_columns``.  Covered types: null, boolean, int, long, float, double, string, bytes (with the
decimal logical type), enum, records (named and referenced) and unions.
"""

from __future__ import annotations

import json
import struct
from decimal import Decimal
from typing import Any

_PRIMS = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}


def parse_schema(schema: str | dict | list) -> Any:
    """Resolve named-type references into one nested tree."""
    names: dict[str, Any] = {}

    def walk(s: Any, ns: str | None) -> Any:
        if isinstance(s, str):
            if s in _PRIMS:
                return {"type": s}
            full = s if "." in s or ns is None else f"{ns}.{s}"
            return names.get(full) or names[s]
        if isinstance(s, list):
            return {"type": "union", "branches": [walk(b, ns) for b in s]}
        t = s["type"]
        if t == "record":
            rns = s.get("namespace", ns)
            node: dict[str, Any] = {"type": "record", "name": s["name"], "fields": []}
            names[s["name"]] = node
            names[f"{rns}.{s['name']}" if rns else s["name"]] = node
            node["fields"] = [(f["name"], walk(f["type"], rns)) for f in s["fields"]]
            return node
        if t == "enum":
            node = {"type": "enum", "symbols": list(s["symbols"])}
            names[s["name"]] = node
            return node
        if isinstance(t, (dict, list)) or (isinstance(t, str) and t not in _PRIMS):
            return walk(t, ns)
        node = {"type": t}
        if s.get("logicalType") == "decimal":
            node["scale"] = int(s.get("scale", 0))
        return node

    return walk(json.loads(schema) if isinstance(schema, str) else schema, None)


def _write_long(out: bytearray, v: int) -> None:
    z = (v << 1) ^ (v >> 63)
    while z & ~0x7F:
        out.append((z & 0x7F) | 0x80)
        z >>= 7
    out.append(z)


def _branch(node: Any, v: Any) -> int:
    for i, b in enumerate(node["branches"]):
        bt = b["type"]
        if (v is None) == (bt == "null"):
            return i
    raise ValueError("no union branch for value")


def _write(node: Any, v: Any, out: bytearray) -> None:
    t = node["type"]
    if t == "record":
        for name, sub in node["fields"]:
            _write(sub, (v or {}).get(name), out)
    elif t == "union":
        i = _branch(node, v)
        _write_long(out, i)
        _write(node["branches"][i], v, out)
    elif t in ("int", "long"):
        _write_long(out, int(v))
    elif t == "string":
        raw = v.encode("utf-8")
        _write_long(out, len(raw))
        out += raw
    elif t == "bytes":
        if "scale" in node:
            unscaled = int(Decimal(v).scaleb(node["scale"]))
            raw = unscaled.to_bytes(max(1, (unscaled.bit_length() + 8) // 8), "big", signed=True)
        else:
            raw = bytes(v)
        _write_long(out, len(raw))
        out += raw
    elif t == "null":
        pass
    elif t == "boolean":
        out.append(1 if v else 0)
    elif t == "double":
        out += struct.pack("<d", v)
    elif t == "float":
        out += struct.pack("<f", v)
    elif t == "enum":
        _write_long(out, node["symbols"].index(v))
    else:
        raise ValueError(f"unsupported Avro type {t}")


def encode(node: Any, value: Any) -> bytes:
    out = bytearray()
    _write(node, value, out)
    return bytes(out)


def frame(schema_id: int, payload: bytes) -> bytes:
    """Confluent wire frame: magic 0x00, 4-byte big-endian schema id, payload."""
    return b"\x00" + schema_id.to_bytes(4, "big") + payload
