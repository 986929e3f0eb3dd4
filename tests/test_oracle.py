"""Every registered query against its DuckDB oracle on sf0.001 (sf0.01 is the driver's gate)."""

import pytest

from oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, verbose=False)
    errors = {k: v["error"] for k, v in res.items() if "error" in v}
    assert not errors, errors
    bad = {k: v for k, v in res.items() if v.get("has_oracle") and not v.get("match")}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["user_id", "quantity", "unit_price", "total_price", "status", "created_at", "updated_at"]
