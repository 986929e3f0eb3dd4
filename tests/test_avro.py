"""Confluent framing and Avro decoding (FIXTURES F4); Avro path == JSON path."""

import json
import random
from decimal import Decimal

import pyarrow as pa
import pytest

from lakeshift.functions import avro_binary, avro_columns
from lakeshift.operators import decode
from lakeshift.operators.decode import decode_avro, split_confluent
from lakeshift.plans import loader
from lakeshift.sources import derived as d

SF = "/root/testdata/sf0.001"


def test_columns_equal_what_was_encoded():
    rnd = random.Random(3)
    schema = d.envelope_schema(True)
    node = avro_binary.parse_schema(schema)
    text = lambda: "".join(rnd.choice("aé😀 ") for _ in range(rnd.randint(0, 80)))
    rows = []
    for _ in range(300):
        rec = {"user_id": rnd.randint(-(2**62), 2**62), "quantity": rnd.randint(-70, 70), "unit_price": Decimal(rnd.randint(-(10**9), 10**9)).scaleb(-2), "status": text(), "created_at": None if rnd.random() < 0.5 else text(), "updated_at": text(), "channel": "web"}
        rows.append({"before": None if rnd.random() < 0.5 else rec, "after": None if rnd.random() < 0.3 else rec, "op": "u", "ts_ms": rnd.choice([None, 0, -1, 1788957880828])})
    bodies = pa.array([avro_binary.encode(node, r) for r in rows], pa.binary())
    got = avro_columns.read_bodies(json.dumps(schema), bodies.slice(0)).to_pylist()
    assert got == rows
    assert avro_columns.read_bodies(json.dumps(schema), bodies.slice(5, 7)).to_pylist() == rows[5:12]
    assert avro_columns.read_bodies(json.dumps(schema), bodies.slice(0, 0)).to_pylist() == []
    flat = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "boolean"}, {"name": "b", "type": "float"}, {"name": "c", "type": "double"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["x", "y"]}}, {"name": "z", "type": "bytes"}]}
    one = {"a": True, "b": 0.5, "c": -2.25, "e": "y", "z": b"\x00\xff"}
    raw = avro_binary.encode(avro_binary.parse_schema(flat), one)
    assert avro_columns.read_bodies(json.dumps(flat), pa.array([raw, raw], pa.binary())).to_pylist() == [one, one]


def _frames(spark, values):
    rows = [(b"k", v, "mysql.shop.events", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint")


def test_bad_magic_fails(spark):
    log = _frames(spark, [b"\x01\x00\x00\x00\x01abc"])
    with pytest.raises(Exception, match="magic"):
        split_confluent(log).collect()


def test_unknown_schema_id_fails(spark):
    log = _frames(spark, [avro_binary.frame(99, b"")])
    with pytest.raises(Exception, match="Unknown schema id"):
        decode_avro(split_confluent(log), loader.EVENTS_AVRO_AFTER, d.registry(spark)).collect()


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_two_writer_schemas_and_tombstone(spark, monkeypatch, limit):
    monkeypatch.setattr(decode, "REGISTRY_BYTES", limit)
    v1 = avro_binary.parse_schema(d.envelope_schema(False))
    v2 = avro_binary.parse_schema(d.envelope_schema(True))
    rec = {"user_id": 1, "quantity": 2, "unit_price": Decimal("9.99"), "status": "s", "created_at": "2024-01-01T00:00:00Z", "updated_at": None}
    vals = [
        avro_binary.frame(1, avro_binary.encode(v1, {"after": rec, "op": "c"})),
        avro_binary.frame(2, avro_binary.encode(v2, {"after": {**rec, "user_id": 2, "channel": "web"}, "op": "u"})),
        None,
    ]
    out = decode_avro(split_confluent(_frames(spark, vals)), loader.EVENTS_AVRO_AFTER, d.registry(spark)).orderBy("offset").collect()
    assert out[0]["envelope"]["after"]["unit_price"] == Decimal("9.99")
    assert out[1]["envelope"]["after"]["user_id"] == 2 and out[1]["envelope"]["op"] == "u"
    assert out[2]["envelope"] is None


def test_avro_keys_and_another_table(spark):
    log, registry = d.customers_avro_log(spark, SF)
    a = loader.stage_changes(log, loader.customers_spec("avro", deletes="apply"), registry)
    j = loader.stage_changes(d.customers_capture_log(spark, SF), loader.customers_spec(deletes="apply"))
    assert a.filter("_deleted").count() > 0
    assert a.exceptAll(j).count() == 0 and j.exceptAll(a).count() == 0


def test_avro_path_equals_json_path(spark):
    a = loader.stage(d.events_avro_log(spark, SF), loader.events_spec("avro"), d.registry(spark))
    j = loader.stage(d.events_log(spark, SF), loader.events_spec("json"))
    assert a.exceptAll(j).count() == 0 and j.exceptAll(a).count() == 0
    assert a.count() > 0
