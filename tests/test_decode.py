"""JSON envelope decoding, live filter and projection on literal rows (FIXTURES F1, F3)."""

from decimal import Decimal

from pyspark.sql import functions as F

from lakeshift.operators.decode import decode_json, flatten_envelope, live_changes
from lakeshift.operators.transform import ColumnRule, TableSpec, latest_by_key
from lakeshift.plans import loader

ORDER_AFTER = (
    "order_id int, customer_id int, product_id int, quantity int, unit_price string, status string, "
    "created_at string, updated_at string"
)
ORDER_MAPPING = [
    ColumnRule("order_id", "after.order_id", ("order_id",)),
    ColumnRule("customer_id", "after.customer_id", ("customer_id",)),
    ColumnRule("product_id", "after.product_id", ("product_id",)),
    ColumnRule("quantity", "after.quantity", ("quantity",)),
    ColumnRule("unit_price", "try_cast(after.unit_price as decimal(10,2))", ("unit_price",), data_type="decimal(10,2)"),
    ColumnRule("total_price", "try_cast(after.unit_price as decimal(10,2)) * after.quantity", ("quantity", "unit_price"), "TRANSFORMATION", data_type="decimal(12,2)"),
    ColumnRule("status", "after.status", ("status",)),
    ColumnRule("created_at", "try_cast(after.created_at as timestamp_ntz)", ("created_at",)),
    ColumnRule("updated_at", "try_cast(after.updated_at as timestamp_ntz)", ("updated_at",)),
]
ORDERS = TableSpec("poc.shop_orders_json", "mysqljson.shop.orders", ("order_id",), ORDER_AFTER, ORDER_MAPPING)


def _log(spark, values):
    rows = [(b'{"order_id":%d}' % i, None if v is None else v.encode(), "mysqljson.shop.orders", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint")


def _after(oid, cid, pid, qty, price, status):
    return (
        '{"after":{"order_id":%d,"customer_id":%d,"product_id":%d,"quantity":%d,"unit_price":"%s","status":"%s",'
        '"created_at":"2026-09-07T14:00:00.000Z","updated_at":"2026-09-07T14:00:00.000Z"},"op":"c"}' % (oid, cid, pid, qty, price, status)
    )


def test_seed_orders_total_price(spark):
    seed = [(1, 101, 2, 2, "19.99", "NEW"), (2, 102, 1, 1, "49.50", "SHIPPED"), (3, 103, 5, 5, "9.99", "DELIVERED"), (4, 101, 3, 3, "19.99", "CANCELLED")]
    log = _log(spark, [_after(o, c, p, q, pr, s) for (o, c, p, q, pr, s) in seed])
    out = {r["order_id"]: r["total_price"] for r in loader.stage(log, ORDERS).collect()}
    assert out == {1: Decimal("39.98"), 2: Decimal("49.50"), 3: Decimal("49.95"), 4: Decimal("59.97")}


def test_envelope_cases(spark):
    values = [
        None,  # tombstone
        "",  # empty string
        "not json",
        '{"after":null,"op":"d"}',
        '{"after":{"order_id":1,"unit_price":"19.99"},"op":"c"}',
        '{"after":{"order_id":2,"unit_price":19.90},"op":"c"}',
        '{"after":{},"op":"c"}',
        '{"after":{"order_id":"x"},"op":"c"}',
        '{"after":{"order_id":3}}',
    ]
    flat = flatten_envelope(decode_json(_log(spark, values), ORDER_AFTER))
    rows = flat.orderBy("offset").collect()
    assert rows[0]["after"] is None and rows[0]["op"] is None
    assert rows[1]["after"] is None
    assert rows[2]["after"] is None and rows[2]["op"] is None
    assert rows[3]["after"] is None and rows[3]["op"] == "d"
    assert rows[5]["after"]["unit_price"] == "19.9"  # number -> string loses the trailing zero
    live = sorted(r["offset"] for r in live_changes(flat).collect())
    assert live == [4, 5, 6, 7]  # {} and order_id "x" survive with a NULL key; missing op is dropped


def test_null_keys_keep_one_row(spark):
    values = ['{"after":{},"op":"c"}', '{"after":{"order_id":"x"},"op":"c"}', '{"after":{"order_id":1},"op":"c"}']
    st = loader.stage(_log(spark, values), ORDERS).collect()
    assert sorted((r["order_id"] is None) for r in st) == [False, True]


def test_filter_before_rank_keeps_deleted_rows(spark):
    values = [_after(1, 1, 1, 1, "1.00", "NEW"), '{"before":{"order_id":1},"after":null,"op":"d"}', None]
    log = _log(spark, values).withColumn("key", F.lit(b'{"order_id":1}'))
    ignore = loader.stage(log, ORDERS).collect()
    assert [r["status"] for r in ignore] == ["NEW"]  # the last live image wins
    apply = loader.stage(log, TableSpec(**{**ORDERS.__dict__, "deletes": "apply"})).collect()
    assert apply == []


def test_window_equals_max_by(spark):
    from lakeshift.sources import derived as d

    flat = loader.decoded_changes(d.events_log(spark, "/root/testdata/sf0.001"), loader.events_spec("json"))
    a = latest_by_key(live_changes(flat), ["after.user_id"], method="window").select("offset")
    b = latest_by_key(live_changes(flat), ["after.user_id"], method="agg").select("offset")
    c = latest_by_key(flat, ["after.user_id"], method="agg", where=(F.col("after").isNotNull() & (F.col("op") != "d"))).select("offset")
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(c.collect())


def test_live_changes_decodes_once(spark):
    from lakeshift.sources import derived as d

    flat = loader.decoded_changes(d.events_log(spark, "/root/testdata/sf0.001"), loader.events_spec("json"))
    plan = live_changes(flat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(after") == 1


def test_hot_key_is_reduced_before_the_shuffle(spark):
    """A key holding a third of all rows: the dedup aggregates partially on the map side."""
    from pyspark.sql import functions as F

    rows = [(b'{"order_id":1}' if i % 3 == 0 else b'{"order_id":%d}' % i,
             (_after(1 if i % 3 == 0 else i, 1, 1, 1, "1.00", "NEW")).encode(), "t", 0, i) for i in range(300)]
    log = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint").repartition(4)
    st = loader.stage(log, ORDERS)
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert st.filter(F.col("order_id") == 1).count() == 1 and st.count() == 200  # keys 1 and 2..299 not divisible by 3


def test_key_predicate_stays_above_the_dedup(spark):
    """A filter on the stage key must not be pushed into the decode / scan."""
    from lakeshift.operators.decode import keep_decoded
    from lakeshift.sources import derived as d

    st = loader.stage(d.events_log(spark, "/root/testdata/sf0.001"), loader.events_spec("json"))
    plain = st.filter(F.col("user_id") % 17 != 0)._jdf.queryExecution().optimizedPlan().toString()
    kept = keep_decoded(st, lambda r: r["user_id"] % 17 != 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count("from_json") > kept.count("from_json")  # the plain filter re-decodes below
    assert sorted(keep_decoded(st, lambda r: r["user_id"] % 17 != 0).collect()) == sorted(st.filter(F.col("user_id") % 17 != 0).collect())
