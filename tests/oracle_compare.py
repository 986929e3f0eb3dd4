"""Run registered queries in Spark and their oracle SQL in DuckDB; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v:.6g}" if abs(v) < 1e-3 else f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v != 0 else "0"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as e

    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        rec = {"has_oracle": name in sqls}
        try:
            df = qs[name](spark, sf_dir)
            srows = df.collect()
            scols = df.columns
            rec["spark_rows"] = len(srows)
            rec["spark_sec"] = round(time.time() - t0, 2)
            if name in sqls:
                cur = con.execute(sqls[name])
                dcols = [c[0] for c in cur.description]
                drows = cur.fetchall()
                rec["oracle_rows"] = len(drows)
                rec["cols_match"] = sorted(scols) == sorted(dcols)
                if not rec["cols_match"]:
                    rec["spark_cols"], rec["oracle_cols"] = scols, dcols
                a, b = rows_canon(scols, srows), rows_canon(dcols, drows)
                rec["match"] = rec["cols_match"] and a == b
                if not rec["match"] and rec["cols_match"]:
                    sa, sb = set(a), set(b)
                    rec["only_spark"] = [list(x) for x in sorted(sa - sb)[:3]]
                    rec["only_oracle"] = [list(x) for x in sorted(sb - sa)[:3]]
                    rec["sorted_cols"] = sorted(scols)
                rec["spark_types"] = dict(df.dtypes)
        except Exception as ex:  # report and continue
            rec["error"] = f"{type(ex).__name__}: {str(ex)[:600]}"
        results[name] = rec
        if verbose:
            status = "OK " if rec.get("match") else ("ROW" if not rec["has_oracle"] and "error" not in rec else "BAD")
            print(status, name, json.dumps({k: v for k, v in rec.items() if k not in ("spark_types",)}, default=str), flush=True)
    return results


if __name__ == "__main__":
    from lakeshift.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, only)
    bad = [k for k, v in res.items() if v.get("has_oracle") and not v.get("match")]
    print("SUMMARY", len(res), "queries;", len(bad), "mismatches:", bad)
