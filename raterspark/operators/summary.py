"""Coverage summaries: bins, ordered levels, totals, shares, top-k with ties, growth.

Distinct counts are exact (``count_distinct``); Spark plans them as an aggregate on
(group, item) with partial aggregation before the exchange, so a hot group is reduced
map-side. Denominators are scalar subqueries or joins with small aggregated tables.
Global (unpartitioned) windows run only on small aggregated outputs: the last values of
levels, and the at most k distinct values of a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterspark.functions.nulls import safe_div


def bin_left_closed(col: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """``cut(x, breaks, labels, right=FALSE)``: ``[b_i, b_{i+1})`` -> label_i; values
    outside the breaks or NULL -> NULL (unlike Bucketizer, the last bin is open too)."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for lo, hi, lab in zip(breaks[:-1], breaks[1:], labels):
        cond = (c >= F.lit(lo)) & (c < F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def ordered_level(col: Column | str, levels: Sequence[str]) -> Column:
    """Position (1-based) of the value in ``levels``; unknown or NULL -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), c)
    return F.when(pos > 0, pos.cast("int"))


def group_totals(
    df: DataFrame, group: str, split: str, measure: str, out: str = "n", keep_null_group: bool = True
) -> DataFrame:
    """Sum of ``measure`` per (group, split) and per group (split NULL) in one
    aggregate (GROUPING SETS). NULLs in the measure are ignored; an all-NULL cell is 0.
    ``keep_null_group=False`` leaves rows without a group out (``filter(!is.na(group))``)."""
    if not keep_null_group:
        df = df.where(F.col(group).isNotNull())
    agg = df.groupingSets([[group, split], [group]], group, split).agg(
        F.coalesce(F.sum(measure), F.lit(0)).alias(out),
        F.grouping(split).alias("_gs"),
    )
    return agg.select(group, F.when(F.col("_gs") == 0, F.col(split)).alias(split), out)


def topic_share(df: DataFrame, item: str, topic: str) -> DataFrame:
    """Distinct items per topic divided by distinct items overall."""
    total = df.agg(F.count_distinct(item)).scalar()
    per = df.groupBy(topic).agg(F.count_distinct(item).alias("n_items"))
    return per.select(topic, "n_items", total.alias("n_total"), safe_div(F.col("n_items"), total).alias("share"))


def topic_share_within(
    df: DataFrame, item: str, topic: str, group: str, denominator: DataFrame | None = None,
    denominator_col: str = "n_total",
) -> DataFrame:
    """Share of a group's items per topic.

    Default denominator: distinct items of the group, computed in the same aggregate
    as the numerator (GROUPING SETS ((group, topic), (group)), one Expand).
    ``denominator``: a table (group, denominator_col) holding another measure (for
    example incidences), joined on the group.
    """
    if denominator is None:
        agg = df.groupingSets([[group, topic], [group]], group, topic).agg(
            F.count_distinct(item).alias("_n"), F.grouping(topic).alias("_gs")
        )
        # The group total sits on the same aggregate's output (one row per group and
        # topic plus one per group): a window over that small result attaches it, so
        # the distinct aggregate runs once.
        w = Window.partitionBy(group)
        total = F.max(F.when(F.col("_gs") == 1, F.col("_n"))).over(w)
        out = agg.select(group, topic, "_gs", F.col("_n").alias("n_items"), total.alias(denominator_col))
        out = out.where(F.col("_gs") == 0).drop("_gs")
        return out.withColumn("share", safe_div(F.col("n_items"), F.col(denominator_col)))
    else:
        detail = df.groupBy(group, topic).agg(F.count_distinct(item).alias("n_items"))
        totals = denominator.select(F.col(group).alias("_group"), denominator_col)
    out = detail.join(totals, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return out.withColumn("share", safe_div(F.col("n_items"), F.col(denominator_col)))


def top_k_ties(df: DataFrame, measure: str, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows whose ``rank()`` by ``measure`` (descending) is at most k: ties at the cut
    are all kept, so more than k rows can come back. NULLs rank last.

    The k-th value comes from a distributed top-k; rows at or above it are kept by a filter
    and ranked through the at most k distinct values they have, so ties are never gathered."""
    top = df.orderBy(F.col(measure).desc_nulls_last()).limit(k)
    cut = top.agg(F.struct(F.min(measure).alias("least"), F.count_if(F.col(measure).isNull()).alias("nulls"))).scalar()
    kept = df.where((F.col(measure) >= cut["least"]) | (cut["nulls"] > 0))
    w = Window.orderBy(F.col("_value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    values = kept.groupBy(F.col(measure).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = values.select("_value", (F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).cast("int").alias(rank_col))
    return kept.join(ranks, F.col(measure).eqNullSafe(F.col("_value"))).drop("_value")


def cumulative(df: DataFrame, groups: Sequence[str], order: str, measure: str, out: str) -> DataFrame:
    """Running total of ``measure`` within groups ordered by ``order``."""
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(measure).over(w))


def last_value_rank(df: DataFrame, level: str, order: str, value: str, out: str = "level_rank") -> DataFrame:
    """Order levels by their value at the last ``order`` position, descending
    (``fct_reorder2``); returns (level, rank)."""
    last = df.groupBy(level).agg(F.max_by(value, order).alias("_last"))
    w = Window.orderBy(F.col("_last").desc(), F.col(level))
    return last.select(level, F.row_number().over(w).alias(out))


def mean_se(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """mean, sample sd, n, se = sd / sqrt(n) per group."""
    agg = df.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n")
    )
    return agg.withColumn("se", safe_div(F.col("sd"), F.sqrt(F.col("n"))))


def freq_table(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """``table(x)``: count per value, NULL excluded."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def percent_label(share: Column | str) -> Column:
    """Share as a whole-percent label ("37%"); NULL stays NULL."""
    c = F.col(share) if isinstance(share, str) else share
    return F.when(c.isNotNull(), F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%")))


def label_filter(df: DataFrame, flags: Sequence[str], none_col: str, require_any_label: bool = False) -> DataFrame:
    """Keep labelled items and drop the 'none' category.

    Literal default: ``sum(flags) >= 1`` is evaluated over the WHOLE table (one scalar,
    so rows whose flags are all 0 stay; a NULL flag anywhere makes the sum NULL and
    drops every row, as a sum without na.rm does), then ``none_col != 1`` row-wise
    (NULL dropped). ``require_any_label=True`` applies the sum test per row instead.
    """
    total = None
    for c in flags:
        total = F.col(c) if total is None else total + F.col(c)
    if require_any_label:
        any_label = total
    else:
        any_label = df.agg(F.when(F.count_if(total.isNull()) == 0, F.sum(total))).scalar()
    return df.where((any_label >= 1) & (F.col(none_col) != 1))


def label_tallies(df: DataFrame, flags: Sequence[str], none_col: str, by: Sequence[str]) -> DataFrame:
    """One pass over the labelled rows for a whole-table label filter that is decided later:
    per ``by``, the flag sum, the rows with a NULL flag and the rows with ``none_col`` != 1."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in flags])
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(total), F.lit(0)).alias("flag_sum"), F.count_if(total.isNull()).alias("null_flags"),
        F.count_if(F.col(none_col) != 1).alias("n_kept"),
    )


def labelled_entity_counts(tallies: DataFrame, entity: str, out: str = "n") -> DataFrame:
    """``entity_counts(label_filter(df, ...))`` from the :func:`label_tallies` of ``df``.

    The predicate is decided over these few rows; entities left without a row are not in
    the result.
    """
    total = lambda c: F.sum(c).alias(c)
    per = tallies.groupBy(entity).agg(total("flag_sum"), total("null_flags"), total("n_kept"))
    any_label = tallies.agg((F.sum("null_flags") == 0) & (F.sum("flag_sum") >= 1)).scalar()
    return per.where(any_label & (F.col("n_kept") > 0)).select(entity, F.col("n_kept").alias(out))


def first_source(sources: Sequence[DataFrame], entity: str, source_col: str = "source_rank", **measures: Column) -> DataFrame:
    """Measures per entity from the first source that has a row for it.

    ``sources`` are in order of precedence, each with the entity and the columns that the
    aggregate ``measures`` read: rows of a later source count only for entities that no
    earlier one has. One aggregate carries each entity's partial results by source rank (from
    1), a second one takes the least rank; no source is searched for the entities of another,
    and a NULL entity is an entity.
    """
    ranked = [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources, 1)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    per = both.groupBy(entity, "_rank").agg(*[c.alias(name) for name, c in measures.items()])
    best = per.groupBy(entity).agg(F.min(F.struct("_rank", *measures)).alias("_best"))
    return best.select(entity, *[F.col(f"_best.{m}").alias(m) for m in measures], F.col("_best._rank").alias(source_col))


def entity_counts(df: DataFrame, entity: str, item: str | None = None, distinct_entities: bool = False,
                  out: str = "n") -> DataFrame:
    """Rows per entity (item x entity incidences, a repeated entity in one item counts
    again), or distinct items per entity with ``distinct_entities=True``."""
    if distinct_entities and item:
        return df.groupBy(entity).agg(F.count_distinct(item).alias(out))
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias(out))
