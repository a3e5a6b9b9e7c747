"""Run the driver contract the way an external harness does: a plain SparkSession (no
package settings), `__spark_entry__.py` loaded by path from any working directory,
`entry()` on the smallest tables, then every query compared with its SQL oracle.

Usage: python tools/driver_check.py [--sf-dir DIR]
"""

from __future__ import annotations

import argparse
import importlib.util
import math
import os

import duckdb
from pyspark.sql import SparkSession

ENTRY = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("spark_entry", ENTRY)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    print("entry rows", mod.entry(spark).count())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf_dir}/{t}.parquet')")
    queries, oracle = mod.queries(), mod.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        df = fn(spark, args.sf_dir)
        cols = sorted(df.columns)
        got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
        if name not in oracle:
            print(f"{name:30s} rows-only {len(got)}")
            continue
        cur = con.execute(oracle[name])
        ocols = [d[0] for d in cur.description]
        want = sorted(tuple(_norm(r[ocols.index(c)]) for c in cols) for r in cur.fetchall())
        status = "OK" if got == want else "MISMATCH"
        bad += status != "OK"
        print(f"{name:30s} {status} rows={len(got)}")
    print(f"checked={len(queries)} failing={bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
