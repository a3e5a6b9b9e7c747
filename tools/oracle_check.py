"""Run registered queries on Spark and their SQL oracles on DuckDB; compare results.

Usage: python tools/oracle_check.py [--sf-dir DIR] [name ...]

Comparison: same column names (sorted), same row count, same multiset of rows after
rounding floats to 6 places. Prints one line per query and a summary.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raterspark.plans import all_oracles, all_queries  # noqa: E402
from raterspark.plans.common import TABLES  # noqa: E402
from raterspark.session import build_session, ensure_checkpoint_dir  # noqa: E402


# Spark simpleString / DuckDB type names mapped to one vocabulary.
_TYPES = {
    "bigint": "i64", "BIGINT": "i64", "int": "i32", "INTEGER": "i32", "double": "f64", "DOUBLE": "f64",
    "string": "str", "VARCHAR": "str", "boolean": "bool", "BOOLEAN": "bool", "float": "f32", "FLOAT": "f32",
    "smallint": "i16", "SMALLINT": "i16", "tinyint": "i8", "TINYINT": "i8",
    "timestamp_ntz": "ts", "TIMESTAMP": "ts", "date": "date", "DATE": "date",
}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    spark = build_session("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf_dir}/{t}.parquet')")

    qs, oracle = all_queries(), all_oracles()
    names = args.names or list(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = qs[name](spark, args.sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"{name:32s} rows-only  spark_rows={len(s_rows)} ({ts:.1f}s)")
            continue
        try:
            t1 = time.time()
            cur = con.execute(oracle[name])
            o_cols = [d[0] for d in cur.description]
            o_rows = cur.fetchall()
            to = time.time() - t1
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} ORACLE-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(o_cols):
            print(f"{name:32s} COLUMNS spark={sorted(s_cols)} oracle={sorted(o_cols)}")
            bad += 1
            continue
        s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        o_types = {d[0]: str(d[1]) for d in cur.description}
        type_diff = {c: (s_types[c], o_types.get(c)) for c in s_types
                     if _TYPES.get(s_types[c], s_types[c]) != _TYPES.get(o_types.get(c), o_types.get(c))}
        if type_diff:
            print(f"{name:32s} TYPES {type_diff}")
        a, b = _rows(s_cols, s_rows), _rows(o_cols, o_rows)
        if a == b:
            print(f"{name:32s} OK rows={len(a)} spark={ts:.1f}s duckdb={to:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"{name:32s} MISMATCH spark_rows={len(a)} oracle_rows={len(b)} cols={sorted(s_cols)}")
            print("   only spark :", sorted(sa - sb)[:4])
            print("   only oracle:", sorted(sb - sa)[:4])
    print(f"checked={len(names)} failing={bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
