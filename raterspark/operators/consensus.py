"""Vote consensus over replicate answers.

A replicate table has one row per (item, replicate) with the answer of one rater run.
Operators here turn it into one row per item: the modal answer (first-seen tie-break),
per-class vote counts, a dispersion score and an accept/review decision.

Scale notes. Every operator is a ``groupBy`` on the item key (plus, for the single-label
vote, the answer value), so Spark plans partial aggregation before each exchange. A hot
item holding a large share of all rows is therefore collapsed map-side into one row per
(item, answer) per input partition before anything is shuffled; no operator gathers the
rows of one item into a single task or a list. Window functions on the item key are
avoided for the same reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterspark.functions.nulls import safe_div
from raterspark.functions.text import LIST_MARKS, SPACES


def _struct(cols: Sequence[str]) -> Column:
    """Ordering key: the column itself when there is one (keeps fixed-width aggregation
    buffers for numeric positions), else a struct compared field by field."""
    if len(cols) == 1:
        return F.col(cols[0])
    return F.struct(*[F.col(c) for c in cols])


def norm_gini(*counts: Column) -> Column:
    """Normalised Gini impurity of class counts: ``(1 - sum p^2) / (1 - 1/k)``.

    NULL when the counts sum to 0 (the original gave NaN there, which no threshold
    test selects; NULL behaves the same in filters and cannot sort above numbers).
    """
    k = len(counts)
    total = sum(counts[1:], counts[0]).cast("double")
    sum_sq = None
    for c in counts:
        p = safe_div(c, total)
        sum_sq = p * p if sum_sq is None else sum_sq + p * p
    return F.when(total > 0, (F.lit(1.0) - sum_sq) / F.lit(1.0 - 1.0 / k))


def mode_first(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str],
    mode_col: str | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Mode of ``value`` per ``keys``; ties go to the value seen first in ``order``.

    NULL values are ignored. A group with only NULL values disappears unless
    ``keep_empty=True`` (then its mode is NULL). ``order`` must identify rows within a
    group; the built-in ``mode()`` breaks ties by value, not by position.
    """
    keys = list(keys)
    mode_col = mode_col or f"{value}_mode"
    per_value = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min(_struct(order)).alias("_first")
    )
    out = per_value.groupBy(*keys).agg(
        F.min_by(
            F.col(value),
            F.struct(F.col(value).isNull(), -F.col("_cnt"), F.col("_first")),
        ).alias(mode_col)
    )
    if not keep_empty:
        out = out.where(F.col(mode_col).isNotNull())
    return out


def vote_summary(
    df: DataFrame,
    item: str,
    label: str,
    classes: Mapping[str, str],
    order: Sequence[str],
    mode_col: str = "label_mode",
    gini_col: str = "gini_norm",
    keep_empty: bool = False,
) -> DataFrame:
    """Single-label vote per item: first-seen mode, one count column per class, Gini.

    ``classes`` maps output count column -> label value, e.g.
    ``{"count_excluded": "excluded", "count_included": "included", "count_blank": ""}``.
    Labels outside ``classes`` can still be the mode but are in no count (and not in the
    Gini denominator). NULL labels are ignored.

    Plan: partial+final aggregate on (item, label), then partial+final on item.
    """
    per_value = df.groupBy(item, label).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min(_struct(order)).alias("_first")
    )
    count_exprs = [
        F.coalesce(F.sum(F.when(F.col(label) == F.lit(v), F.col("_cnt"))), F.lit(0)).cast("long").alias(name)
        for name, v in classes.items()
    ]
    out = per_value.groupBy(item).agg(
        F.min_by(
            F.col(label), F.struct(F.col(label).isNull(), -F.col("_cnt"), F.col("_first"))
        ).alias(mode_col),
        *count_exprs,
    )
    if not keep_empty:
        out = out.where(F.col(mode_col).isNotNull())
    return out.withColumn(gini_col, norm_gini(*[F.col(n) for n in classes]))


def vote_gate(
    summary: DataFrame,
    gini_col: str = "gini_norm",
    blank_col: str = "count_blank",
    gini_max: float = 0.5,
    blank_max: int = 2,
    min_count: tuple[str, int] | None = None,
) -> DataFrame:
    """Keep confident items: ``gini < gini_max`` and ``blank < blank_max``.

    Optional ``min_count=(col, n)`` additionally requires ``col > n`` (the inclusion
    rule). A NULL Gini never passes.
    """
    cond = (F.col(gini_col) < F.lit(gini_max)) & (F.col(blank_col) < F.lit(blank_max))
    if min_count is not None:
        cond = cond & (F.col(min_count[0]) > F.lit(min_count[1]))
    return summary.where(cond)


def review_list(
    summary: DataFrame,
    item: str,
    gini_col: str = "gini_norm",
    blank_col: str = "count_blank",
    gini_above: float = 0.5,
    blank_above: int = 1,
) -> DataFrame:
    """Items to check by hand, one row per (item, reason).

    Reasons: ``dispersion`` when ``gini > gini_above``, ``blank`` when
    ``blank > blank_above``. Not the complement of :func:`vote_gate` at the boundary.
    One pass: the reasons are built as an array and exploded.
    """
    reasons = F.array(
        F.when(F.col(gini_col) > F.lit(gini_above), F.lit("dispersion")),
        F.when(F.col(blank_col) > F.lit(blank_above), F.lit("blank")),
    )
    return summary.select(
        F.col(item), F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason")
    )


def label_tokens(text: Column, blank_label: str = "Blank") -> Column:
    """Printed label list -> array of labels: ``''`` -> [blank_label]; brackets, quotes and
    spaces removed in one pass over the text; split on commas."""
    t = F.when(text == F.lit(""), F.lit(blank_label)).otherwise(text)
    return F.split(F.translate(t, LIST_MARKS + SPACES, ""), ",")


def multilabel_consensus(
    df: DataFrame,
    item: str,
    order: Sequence[str],
    labels: str,
    levels: Sequence[str],
    blank_label: str = "Blank",
    unknown_col: str | None = None,
) -> DataFrame:
    """Multi-label vote: each input row is one replicate answer holding a printed list.

    Output per item: ``{L}_mode`` (0/1, majority of replicates, tie -> value of the first
    replicate in ``order``) and ``{L}_count`` (replicates naming L) for each level L,
    plus ``n_reps``. Labels not in ``levels`` are ignored (``unknown_col`` names an
    optional column counting them); a level may be absent from the data (its counts
    are 0). A NULL answer counts as a replicate naming nothing.

    The one-hot step is a projection (``array_contains`` per level) because a replicate
    is one row, so the whole operator is a single partial+final aggregate on ``item``.
    """
    # The tokens are a column of their own, so an answer is read once for all levels.
    df = df.withColumn("_toks", label_tokens(F.col(labels), blank_label))
    toks = F.col("_toks")
    flags = [
        F.coalesce(F.array_contains(toks, F.lit(lv)), F.lit(False)).cast("int") for lv in levels
    ]
    extra = []
    if unknown_col:
        unknown = F.size(F.filter(toks, lambda t: ~t.isin(list(levels)) & (t != F.lit(""))))
        # A NULL answer names nothing (size(NULL) is -1 or NULL depending on settings).
        extra.append(F.when(toks.isNotNull(), unknown).otherwise(F.lit(0)).alias("_unk"))
    # The first replicate's flags travel as one array: one min_by for any number of levels.
    one_hot = df.select(
        F.col(item), _struct(order).alias("_ord"), F.array(*flags).alias("_flags"), *extra
    )
    aggs = [F.count(F.lit(1)).alias("n_reps"), F.min_by("_flags", "_ord").alias("_first")]
    aggs += [F.sum(F.col("_flags")[i]).cast("long").alias(f"_c{i}") for i in range(len(levels))]
    if unknown_col:
        aggs.append(F.sum("_unk").cast("long").alias(unknown_col))
    per_item = one_hot.groupBy(item).agg(*aggs)
    cols = [F.col(item)]
    for i, lv in enumerate(levels):
        c, n = F.col(f"_c{i}"), F.col("n_reps")
        mode = F.when(c * 2 > n, F.lit(1)).when(c * 2 < n, F.lit(0)).otherwise(F.col("_first")[i])
        cols.append(mode.cast("int").alias(f"{lv}_mode"))
        cols.append(c.alias(f"{lv}_count"))
    cols.append(F.col("n_reps"))
    if unknown_col:
        cols.append(F.col(unknown_col))
    return per_item.select(*cols)


def consensus_flags(
    ml: DataFrame,
    item: str,
    levels: Mapping[str, str],
    reader: str,
    blank_count_col: str | None = None,
    blank_max: int = 2,
) -> DataFrame:
    """Rating rows from a multi-label consensus: one 0/1 column per output category.

    ``levels`` maps output column -> level name in ``ml``. Items with
    ``blank_count_col >= blank_max`` are dropped first.
    """
    if blank_count_col:
        ml = ml.where(F.col(blank_count_col) < F.lit(blank_max))
    return ml.select(
        F.col(item),
        *[F.col(f"{lv}_mode").alias(out) for out, lv in levels.items()],
        F.lit(reader).alias("reader"),
    )


def agreement_bands(
    counts: DataFrame,
    count_cols: Mapping[str, str],
    n_replicates: int = 5,
) -> DataFrame:
    """Share of per-item vote counts that are unanimous / near / split.

    ``count_cols`` maps category name -> count column. Bands are the value pairs
    ``(i, n-i)`` for ``i = 0 .. n//2`` (``n_0_5, n_1_4, n_2_3`` for five replicates).
    Output: one row per category and one overall row (``category`` NULL), with
    ``total`` (non-NULL counts), ``n_eq_0`` / ``n_eq_{n}`` (whole-frame extremes),
    ``n_a_b`` and ``prop_a_b``.
    """
    bands = [(i, n_replicates - i) for i in range(n_replicates // 2 + 1)]
    stack = F.explode(
        F.array(*[
            F.struct(F.lit(cat).alias("category"), F.col(c).cast("long").alias("value"))
            for cat, c in count_cols.items()
        ])
    ).alias("kv")
    long = counts.select(stack).select("kv.category", "kv.value")
    aggs = [
        F.count("value").alias("total"),
        F.count_if(F.col("value") == 0).alias("n_eq_0"),
        F.count_if(F.col("value") == n_replicates).alias(f"n_eq_{n_replicates}"),
    ]
    for a, b in bands:
        aggs.append(F.count_if(F.col("value").isin(a, b)).alias(f"n_{a}_{b}"))
    out = long.rollup("category").agg(*aggs)
    props = [safe_div(F.col(f"n_{a}_{b}"), F.col("total")).alias(f"prop_{a}_{b}") for a, b in bands]
    return out.select("*", *props)


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep rows whose ``key`` appears in ``ids`` (a semi join; off by default in the
    callers, where the original computed the restriction but never applied it)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
