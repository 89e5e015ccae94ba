"""Run registered queries and their DuckDB oracles side by side.

Usage: python scripts/check_oracle.py [--sf-dir DIR] [key ...]
Prints one line per key: OK / MISMATCH / ERROR with row counts, and writes a
JSON summary to stdout at the end.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from strata.plans.registry import TABLES, all_queries  # noqa: E402
from strata.session import build_session  # noqa: E402


EXACT = False


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v) if EXACT else round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def spark_kind(dt) -> str:
    n = dt.simpleString()
    if n in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if n in ("float", "double"):
        return "float"
    if n.startswith("decimal"):
        return "decimal"
    if n.startswith("timestamp"):
        return "timestamp"
    return n.split("<")[0]


def duck_kind(t: str) -> str:
    t = str(t).upper()
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t.startswith("TIMESTAMP"):
        return "timestamp"
    if t == "VARCHAR":
        return "string"
    return {"BOOLEAN": "boolean", "DATE": "date"}.get(t, t.lower())


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--tz", default=None, help="session time zone to run under (robustness check)")
    ap.add_argument("--exact", action="store_true", help="compare floats bit for bit")
    ap.add_argument("--plain", action="store_true", help="plain session without the library's defaults")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    global EXACT
    EXACT = args.exact
    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("local[8]", shuffle_partitions=8)
    if args.tz:
        spark.conf.set("spark.sql.session.timeZone", args.tz)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf_dir}/{t}.parquet'")
    reg = all_queries()
    keys = args.keys or sorted(reg)
    summary = {}
    for k in keys:
        fn, sql = reg[k]
        t0 = time.time()
        try:
            df = fn(spark, args.sf_dir)
            srows = df.collect()
            scols = df.columns
            t1 = time.time()
            if sql is None:
                summary[k] = "rows-only"
                print(f"{k:32s} ROWS-ONLY spark={len(srows)} ({t1 - t0:.1f}s)", flush=True)
                continue
            res = con.execute(sql)
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
            problems = []
            sk = {f.name: spark_kind(f.dataType) for f in df.schema.fields}
            ok = {d[0]: duck_kind(d[1]) for d in res.description}
            tdiff = {c: (sk[c], ok[c]) for c in sk if c in ok and sk[c] != ok[c]}
            if tdiff:
                problems.append(f"types {tdiff}")
            if sorted(scols) != sorted(ocols):
                problems.append(f"cols spark={sorted(scols)} oracle={sorted(ocols)}")
            if len(srows) != len(orows):
                problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
            if not problems:
                a, b = canon(scols, srows), canon(ocols, orows)
                if a != b:
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                    problems.append(f"values differ e.g. {diff}")
            status = "OK" if not problems else "MISMATCH"
            summary[k] = status
            print(f"{k:32s} {status} rows={len(srows)} ({t1 - t0:.1f}s) {'; '.join(problems)[:1500]}", flush=True)
        except Exception as e:  # noqa: BLE001
            summary[k] = "ERROR"
            print(f"{k:32s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
            traceback.print_exc(limit=3)
    print(json.dumps(summary))
    spark.stop()


if __name__ == "__main__":
    main()
