"""Global order without a global window: positions, running totals, dense ranks, quantiles.

Rows are range-partitioned by the order, sorted within partitions and written once, each with
its partition and place. The totals of the partitions (one row each and group) give every
partition its offset, so no task sees more than its own range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterspark.sources.io import materialize


def _same(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)])


def running_total(
    df: DataFrame, order: Sequence[Column], weight: str | None = None, groups: Sequence[str] = (), out: str = "before"
) -> DataFrame:
    """``df`` with the total of ``weight`` (default: 1 a row) over the rows of the same group
    that come earlier in ``order``. Rows equal in all of ``order`` come in any order; NULL
    groups are one group."""
    by = [*[F.col(g).asc_nulls_last() for g in groups], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered").withColumn("_range", F.shiftright("_place", 33))
    w = F.col(weight) if weight else F.lit(1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if groups:
        earlier = Window.partitionBy(*[f"_g{k}" for k in range(len(groups))]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range and group in it
    totals = rows.groupBy("_range", *groups).agg(F.sum(w).alias("_w")).toDF("_range", *[f"_g{k}" for k in range(len(groups))], "_w")
    offsets = totals.select(
        F.col("_range").alias("_r"), *[f"_g{k}" for k in range(len(groups))], F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_off")
    )
    local = Window.partitionBy("_range", *groups).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_local", F.coalesce(F.sum(w).over(local), F.lit(0)))
    keys = ["_range", *groups], ["_r", *[f"_g{k}" for k in range(len(groups))]]
    found = placed.join(offsets, _same(placed, offsets, *keys))
    return found.select(*df.columns, (F.col("_off") + F.col("_local")).alias(out))


def sort_keys(keys: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Sort expressions of (column, "asc" or "desc") pairs; a missing value is last either way."""
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in pairs]


def arrange(df: DataFrame, keys: Sequence[str | tuple[str, str]], out: str = "position") -> DataFrame:
    """``arrange(a, desc(b), c)``: every row with its position (from 1) in the order of
    several keys. Name keys that make rows unique to get the same positions every time."""
    return running_total(df, sort_keys(keys), out=out).withColumn(out, (F.col(out) + 1).cast("long"))


def order_by_measure(df: DataFrame, level: str, measure: str, out: str = "level_rank") -> DataFrame:
    """Dense rank of levels by a measure, largest first, NULL last (``fct_reorder``).

    Ranks are the positions of the distinct values."""
    values = arrange(df.select(F.col(measure).alias("_value")).distinct(), [("_value", "desc")], out)
    ranked = df.join(values, df[measure].eqNullSafe(values["_value"]))
    return ranked.select(*df.columns, F.col(out).cast("int").alias(out))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group by linear interpolation (R's type 7): groups and one column
    for each of ``probs``. NULL values do not count (a group without others has NULLs); NULL
    groups are one group.

    Values are counted first, so the work behind the first aggregate is that of the distinct
    values, and none is gathered: the ranks next to each quantile are looked up.
    """
    counts = df.groupBy(*groups, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    ranked = running_total(counts, [F.col("_v").asc_nulls_last()], "_n", groups, "_before")
    totals = ranked.groupBy(*groups).agg(F.sum("_n").alias("_total")).toDF(*[f"_t{k}" for k in range(len(groups))], "_total")
    with_total = ranked.join(totals, _same(ranked, totals, list(groups), [f"_t{k}" for k in range(len(groups))]))
    cols = []
    for name, q in probs.items():
        at = (F.col("_total") - 1) * F.lit(q)

        def value_at(rank: Column) -> Column:
            return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v")))

        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        part = F.max(at - F.floor(at))
        # both neighbours are weighted, as the percentile functions of SQL engines do it
        cols.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(name))
    return with_total.groupBy(*groups).agg(*cols)
