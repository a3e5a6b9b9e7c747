"""Summarise the physical plan of every registered query (markdown on stdout).

For each query: exchanges (shuffles), broadcast exchanges, join strategies, aggregate
kinds, scans, windows and Python evaluation nodes, with scalar subqueries and cached inputs.
Plans are taken after execution on the given tables, so AQE's runtime choices
(broadcasts from measured sizes, coalesced partitions) are the ones shown.

Usage: python tools/plan_report.py [--sf-dir DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raterspark.plans import all_queries  # noqa: E402
from raterspark.session import build_session, ensure_checkpoint_dir  # noqa: E402

def executed_nodes(df) -> list:
    """Every operator of the executed physical plan, scalar subqueries and cached inputs
    included; a reused exchange or subquery is one node and is not entered again."""
    qe = df._jdf.queryExecution()
    # This QueryExecution itself is run, so that its adaptive plan is the final one.
    qe.toRdd().count()
    found, todo = [], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        found.append(node)
        if name.startswith("Reused"):
            continue
        if name == "InMemoryTableScanExec":
            todo.append(node.relation().cachedPlan())
        for inner in (node.children(), node.subqueries()):
            todo += [inner.apply(i) for i in range(inner.size())]
    return found


def node_names(df) -> Counter:
    """How often each operator occurs; a shuffle also counts under its partitioning."""
    names = Counter()
    for node in executed_nodes(df):
        name = node.getClass().getSimpleName().removesuffix("Exec")
        names[name] += 1
        if name == "ShuffleExchange":
            names[node.outputPartitioning().getClass().getSimpleName().removesuffix("$")] += 1
    return names


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    spark = build_session("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="plans-ckpt-", dir="/tmp"))
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{args.sf_dir}` (local[8], AQE on; counts are of")
    print("final adaptive plans after execution, so runtime broadcasts are included).\n")
    print("| query | shuffles (hash / range / round-robin / single) | reused | broadcasts | joins | aggregates | other |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in all_queries().items():
        counts = node_names(fn(spark, args.sf_dir))

        def listed(*names: str) -> str:
            return ", ".join(f"{n} x{counts[n]}" for n in names if counts[n]) or "-"

        kinds = ("HashPartitioning", "RangePartitioning", "RoundRobinPartitioning", "SinglePartition")
        print(f"| `{name}` | {' / '.join(str(counts[k]) for k in kinds)} | {counts['ReusedExchange']} | "
              f"{counts['BroadcastExchange']} | "
              + listed("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
              + " | " + listed("HashAggregate", "ObjectHashAggregate", "SortAggregate") + " | "
              + listed("FileSourceScan", "Window", "WindowGroupLimit", "Expand", "Generate", "ArrowEvalPython",
                       "BatchEvalPython", "InMemoryTableScan") + " |")
    spark.stop()


if __name__ == "__main__":
    main()
