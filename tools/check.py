"""Run named queries next to their SQL in DuckDB and compare columns, row counts and values.

usage: python tools/check.py [--sf DIR] [--only MODULE[,MODULE]] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from sightline.catalog import MODULES
from sightline.catalog.registry import ORACLES, QUERIES
from sightline.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in v.items()) + "}"
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def kinds(rows, cols):
    out = {}
    for i, c in enumerate(cols):
        out[c] = sorted({type(r[i]).__name__ for r in rows if r[i] is not None})
    return out


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--plain", action="store_true", help="a session without any of our settings")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    mods = args.only.split(",") if args.only else MODULES
    for m in mods:
        importlib.import_module(f"sightline.catalog.{m}")
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    if args.plain:
        builder = SparkSession.builder.master("local[8]")
        for key, value in quiet.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    else:
        spark = build_session("check", "local[8]", **quiet, **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    wanted = [n for n, fn in QUERIES.items() if fn.__module__.rsplit(".", 1)[1] in mods]
    for name in args.names or wanted:
        started = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got_rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in ORACLES:
                print(f"ROWS  {name:28s} n={len(got_rows)} {took:.1f}s", flush=True)
                if args.names and got_rows:
                    print("   ", df.columns, str(got_rows[0])[:400])
                bad += not got_rows
                continue
            started = time.time()
            cur = con.execute(ORACLES[name])
            cols = [d[0] for d in cur.description]
            want_rows = cur.fetchall()
            took_sql = time.time() - started
            got, gc = rows_of(df.columns, got_rows)
            want, wc = rows_of(cols, want_rows)
            ok = got == want and gc == wc
            print(f"{'ok   ' if ok else 'FAIL '} {name:28s} n={len(got)} {took:.1f}s sql {took_sql:.1f}s" + ("" if got else "  EMPTY"), flush=True)
            if kinds(got_rows, df.columns) != kinds(want_rows, cols) and ok:
                print("   types", kinds(got_rows, df.columns), kinds(want_rows, cols))
            if not ok:
                bad += 1
                print("   cols", gc, wc, "rows", len(got), len(want))
                sg, sw = set(got), set(want)
                print("   only spark:", [x for x in got if x not in sw][:3])
                print("   only sql  :", [x for x in want if x not in sg][:3])
        except Exception as exc:
            bad += 1
            print(f"ERROR {name}: {str(exc)[:1500]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
