"""Run catalogue queries in Spark and their DuckDB twins; compare results.

Usage: python tools/oracle_check.py [--sf DIR] [name-prefix ...]
Comparison: same column names and types, same row count, and equal multisets of rows
(columns sorted by name, floats compared after rounding to 6 significant
decimals of their own magnitude).
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablewright.plans.fixtures import TABLES  # noqa: E402
from tablewright.plans.registry import load_all  # noqa: E402
from tablewright.session import get_spark  # noqa: E402


STRICT = False


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return norm(v.item())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT"}


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--strict", action="store_true", help="compare floats exactly")
    ap.add_argument("prefix", nargs="*")
    a = ap.parse_args()
    global STRICT
    STRICT = a.strict
    spark = get_spark()
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    ok = bad = 0
    for name, q in sorted(load_all().items()):
        if a.prefix and not any(name.startswith(p) for p in a.prefix):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, a.sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception:
            print(f"FAIL {name}: spark error\n{traceback.format_exc()[-1500:]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s)")
            ok += 1
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:
            print(f"FAIL {name}: duckdb error {e}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duckdb={dcols}")
            bad += 1
            continue
        dtypes = {d[0]: str(d[1]) for d in res.description}
        wrong = [(c, t, dtypes[c]) for c, t in sdf.dtypes if SPARK_TO_DUCK.get(t, t) != dtypes[c]]
        if wrong:
            print(f"FAIL {name}: types differ {wrong}")
            bad += 1
            continue
        a_rows, b_rows = rows_of(scols, srows), rows_of(dcols, drows)
        if len(a_rows) != len(b_rows):
            print(f"FAIL {name}: rows spark={len(a_rows)} duckdb={len(b_rows)}")
            bad += 1
            continue
        diff = [(x, y) for x, y in zip(a_rows, b_rows) if x != y]
        if diff:
            print(f"FAIL {name}: {len(diff)} differing rows, e.g. spark={diff[0][0]} duckdb={diff[0][1]}")
            bad += 1
            continue
        print(f"OK   {name}: {len(srows)} rows ({ts:.1f}s)")
        ok += 1
    print(f"{ok} ok, {bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()
