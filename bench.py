"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (all rows computed, nothing
collected to the driver). One warm-up run, then the median of $BENCH_RUNS timed runs.
Prints ONE JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from raterspark.plans import all_queries  # noqa: E402
from raterspark.session import build_session, ensure_checkpoint_dir  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    base = os.path.basename(sf_dir)
    try:
        sf: float | str = float(base[2:]) if base.startswith("sf") else base
    except ValueError:
        sf = base

    spark = build_session(f"local[{cpus}]", app_name="raterspark-bench", shuffle_partitions=cpus)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    qs = all_queries()
    names = only or list(qs)
    timings: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples = []
            for _ in range(runs):
                t0 = time.perf_counter()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                samples.append(time.perf_counter() - t0)
            timings[name] = round(statistics.median(samples), 4)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "memory_gb": round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30, 1),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
