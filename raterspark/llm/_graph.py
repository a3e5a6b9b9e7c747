"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for edges held by one task; roots are left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges (u, v) of each partition by a spanning forest of the same groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for x in batches:
            a, b = spanning_forest(
                np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()])
            )
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v: non-null longs).

    ``component`` is the smallest node reachable. Each round first replaces a partition's
    edges by a spanning forest, then runs large-star and small-star as an aggregate and a
    join, so a hub with very many edges is pre-aggregated and may be split. Rounds end when
    every edge points at a root; the number of rounds is logarithmic in the longest path.
    """
    e = materialize(contract(edges.where("u <> v")), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = contract(large.distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).union(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = materialize(small.distinct(), "edges")
        parents = e.select(F.col("v").alias("u")).distinct()
        twice = e.groupBy("u").count().where("count > 1")
        if e.join(parents, "u", "left_semi").isEmpty() and twice.isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
