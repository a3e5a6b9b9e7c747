"""Reshape operators: list explosion, flag unpivot, grid completion, literal domains.

No operator here uses a cross join. Grids are completed by exploding each group row over
a *bounded* domain (a year range or a set of observed values) obtained through a scalar
subquery, so the work and output grow with (groups x domain), the size of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_tokens(df: DataFrame, col: str, sep: str, out_col: str | None = None, trim: bool = True) -> DataFrame:
    """One row per token of a delimited string; a NULL or '' value keeps one row
    (NULL / '') like ``separate_rows``."""
    out_col = out_col or col
    tok = F.explode_outer(F.split(F.col(col), sep)).alias(out_col)
    rest = [c for c in df.columns if c != out_col]
    out = df.select(*rest, tok)
    if trim:
        out = out.withColumn(out_col, F.regexp_replace(F.col(out_col), r"^\s+|\s+$", ""))
    return out


def flags_to_long(df: DataFrame, flag_cols: Sequence[str], name_col: str = "category", drop: Sequence[str] = ()) -> DataFrame:
    """Wide 0/1 flag columns -> one row per flag equal to 1 (rows with no flag vanish).

    One projection + explode of the names of the set flags; no union of per-flag scans.
    """
    names = F.filter(
        F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in flag_cols]), lambda x: x.isNotNull()
    )
    keep = [c for c in df.columns if c not in flag_cols and c not in drop]
    return df.select(*keep, F.explode(names).alias(name_col))


def with_domain(df: DataFrame, name: str, values: Sequence, distinct: bool = True) -> DataFrame:
    """Every row once per literal value of a new column (``crossing(name = values)``);
    duplicates removed first when ``distinct`` (as ``crossing`` does)."""
    base = df.distinct() if distinct else df
    return base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def year_spine(df: DataFrame, year: str) -> tuple[Column, Column]:
    """(min, max) of a year column as scalar subqueries."""
    return df.agg(F.min(year)).scalar(), df.agg(F.max(year)).scalar()


def complete_years(
    counts: DataFrame,
    groups: Sequence[str],
    year: str,
    measure: str,
    lo: Column | int | None = None,
    hi: Column | int | None = None,
) -> DataFrame:
    """``complete(g, year = lo:hi, fill = 0)``: every observed group gets every year of
    the range; missing measures become 0. Default range = observed min..max year."""
    if lo is None or hi is None:
        lo_s, hi_s = year_spine(counts, year)
        lo = lo_s if lo is None else lo
        hi = hi_s if hi is None else hi
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    grid = counts.select(*groups).distinct().select(
        *groups, F.explode(F.sequence(lo_c, hi_c)).alias(year), F.lit(0).alias(measure)
    )
    return _filled(grid, counts, [*groups, year], measure)


def _filled(grid: DataFrame, counts: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Zero rows of a grid and counted rows added up; one aggregate, in which NULL keys are
    equal, and no join. Other columns of ``counts`` are not kept."""
    both = grid.select(*keys, measure).unionByName(counts.select(*keys, measure))
    return both.groupBy(*keys).agg(F.coalesce(F.sum(measure), F.lit(0)).cast("long").alias(measure))


def complete_observed(counts: DataFrame, dims: Sequence[str], measure: str) -> DataFrame:
    """``complete(a, b, c, fill = 0)``: the product of the observed values of each
    dimension, NULL being a value. The first dimension stays as rows (any size) and is
    exploded over the value sets of the others, so put the largest dimension first."""
    first, rest = dims[0], list(dims[1:])
    grid = counts.select(first).distinct()
    for d in rest:
        # structs keep a NULL value in the set, which collect_set alone would drop
        values = counts.agg(F.sort_array(F.collect_set(F.struct(F.col(d).alias("v"))))).scalar()
        grid = grid.select("*", F.explode(values).alias("_s")).select("*", F.col("_s.v").alias(d)).drop("_s")
    return _filled(grid.withColumn(measure, F.lit(0)), counts, list(dims), measure)


def cols_ending(df: DataFrame, suffix: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names ending with ``suffix`` (``select(ends_with(...), -x)``)."""
    return [c for c in df.columns if c.endswith(suffix) and c not in set(exclude)]


def full_outer(a: DataFrame, b: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Full outer join on ``keys`` with one coalesced column per key. With
    ``null_safe`` a NULL key matches a NULL key (as R's ``merge`` does)."""
    renamed = b
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        c = a[k].eqNullSafe(renamed[f"_r_{k}"]) if null_safe else (a[k] == renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    j = a.join(renamed, cond, "full")
    for k in keys:
        j = j.withColumn(k, F.coalesce(F.col(k), F.col(f"_r_{k}"))).drop(f"_r_{k}")
    return j


def expand_years(
    df: DataFrame,
    year_col: str,
    repeat_col: str,
    ranges: dict | None = None,
    out_col: str = "year",
    sep: str = ";",
) -> DataFrame:
    """One row per year of a survey: its (text) year plus its repeat years.

    ``ranges`` maps literal range texts to one year ("2017 - 2021" -> "2019"). The year
    list is ``year`` when the repeat list is missing or '', else ``year;repeats`` (a
    missing year is written ``NA``), all whitespace removed, split on ``sep``; each
    piece is parsed with ``try_cast`` so an unknown range gives a NULL year.
    """
    from raterspark.functions.nulls import paste0
    from raterspark.operators.linkage import recode

    y = recode(F.col(year_col).cast("string"), ranges or {})
    rep = F.col(repeat_col)
    years = F.when(rep.isNull() | (rep == ""), y).otherwise(F.concat_ws(sep, paste0(y), rep))
    years = F.regexp_replace(years, r"\s+", "")
    rest = [c for c in df.columns if c not in (year_col, repeat_col, out_col)]
    out = df.select(*rest, F.explode_outer(F.split(years, sep)).alias("_y"))
    return out.withColumn(out_col, F.col("_y").try_cast("int")).drop("_y")


def dense_index(df: DataFrame, col: str, out: str = "_idx") -> DataFrame:
    """Contiguous 0-based index of the distinct values of ``col`` in sort order, without
    a global window: values are range-partitioned and sorted, numbered within each
    partition, and shifted by the prefix sum of the (few) per-partition counts."""
    values = df.select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    values = values.withColumn("_pid", F.spark_partition_id())
    per_part = values.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a global window over it is small.
    offsets = per_part.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off")
    )
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(col)) - 1
    numbered = values.withColumn("_local", local)
    return numbered.join(F.broadcast(offsets), "_pid").select(
        col, (F.col("_off") + F.col("_local")).cast("long").alias(out)
    )
