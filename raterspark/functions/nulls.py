"""Missing-value rules as column expressions.

The R code this package re-expresses treats missing values differently from SQL in a few
places; each helper states the rule it implements so callers never rely on a default.
All helpers are JVM-side expressions (no Python UDF), so they stay inside codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def in_set(col: Column | str, values: Iterable) -> Column:
    """``x %in% values``: never NULL; a NULL x is simply not in the set."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))


def not_in(col: Column | str, values: Iterable) -> Column:
    """``x %ni% values``: the negation of :func:`in_set`, so NULL rows are KEPT.

    Plain ``~col.isin(...)`` yields NULL for a NULL x and would drop the row in a filter.
    """
    return ~in_set(col, values)


def if_else3(cond: Column, yes, no) -> Column:
    """R ``ifelse``: a NULL condition gives NULL (SQL CASE would fall to ELSE)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def n_distinct_na(col: Column | str) -> Column:
    """``n_distinct(x)``: distinct count where NULL counts as one more value (aggregate)."""
    c = _c(col)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def paste0(*cols: Column | str) -> Column:
    """``paste0``: NULL parts are rendered as the text ``NA``; no separator."""
    return F.concat(*[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def sum_na_rm(col: Column | str) -> Column:
    """``sum(x, na.rm=TRUE)``: NULLs ignored and an all-NULL group gives 0 (aggregate)."""
    return F.coalesce(F.sum(_c(col)), F.lit(0))


def sum_strict(col: Column | str) -> Column:
    """``sum(x)`` without na.rm: any NULL in the group makes the sum NULL (aggregate)."""
    c = _c(col)
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def safe_div(num: Column, den: Column) -> Column:
    """Division where x/0 is NULL instead of NaN or an ANSI error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sentinel_to(col: Column | str, sentinels: Iterable[str], replacement: str) -> Column:
    """``ifelse(x %in% sentinels, replacement, x)``: NULL x stays NULL."""
    c = _c(col)
    return F.when(in_set(c, sentinels), F.lit(replacement)).otherwise(c)
