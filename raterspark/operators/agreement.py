"""Inter-rater agreement: rating union, mismatches, pairwise and percent agreement,
prevalence, disagreement inspection, set similarity and per-item label support.

Scale notes.

* Rater pairs are counted by blocks of raters: an item costs one row per block of raters
  it really has and per distinct response; pairs inside a block are products within that
  row, and only items with several blocks are joined with themselves. Rows of single rater
  pairs are never emitted per item.
* The overall agreement table does not need pairs at all: per (item, variable) the
  number of agreeing pairs is ``sum_v c_v (c_v - 1) / 2`` over value counts.
* De-duplication keeps the first row per (item, reader) with ``min_by`` in an
  aggregate (partial aggregation before the shuffle) instead of a window, so the repeated
  rows of a hot item are never gathered into one task.
* The rating union leaves its rows dealt by item over parts whose number follows that of
  the ratings (``RATINGS_PER_PART``, and at least ``spark.sql.shuffle.partitions``), and
  which adaptive execution does not merge: aggregates by item run in these parts without
  another exchange, so what a task holds does not grow with the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterspark.functions.nulls import safe_div
from raterspark.functions.text import tokens
from raterspark.operators.ordering import quantiles
from raterspark.operators.reshape import dense_index
from raterspark.sources.io import materialize


def _struct(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


#: Ratings dealt to one part on average. The aggregates by item hold some kilobytes for each
#: item of their part, so this bounds the memory of a task at any size of the tables.
RATINGS_PER_PART = 150_000


def rating_union(
    frames: Sequence[DataFrame],
    item: str,
    reader: str,
    order: Sequence[str],
    min_rows: int = 2,
    dedupe: bool = True,
) -> DataFrame:
    """Union rating tables by column name, keep items with at least ``min_rows`` rows
    (counted before de-duplication), then keep the first row per (item, reader) in
    ``order`` when ``dedupe``. The order columns are kept in the output.

    The ratings are counted once when the plan is built, for the number of parts."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    # An item without a key is no item; it would also be one group of any size.
    u = u.where(F.col(item).isNotNull())
    slots = max(int(u.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-u.count() // RATINGS_PER_PART))
    rest = [c for c in u.columns if c not in (item, reader)]
    if dedupe:
        # One pass over the rows: the first row per (item, reader) and the number of rows it
        # stands for (partial aggregation before the shuffle).
        u = u.groupBy(item, reader).agg(
            F.min_by(F.struct(*[F.col(c) for c in rest]), _struct(order)).alias("_row"),
            F.count(F.lit(1)).alias("_rows"),
        )
        rest_cols = [F.col(f"_row.{c}").alias(c) for c in rest]
    else:
        u = u.withColumn("_rows", F.lit(1))
        rest_cols = [F.col(c) for c in rest]
    # The rows per item (taken before de-duplication, as the original did) come from a window
    # over the rows dealt by item, so the ratings are read and dealt once.
    u = u.repartition(slots, item).withColumn("_n", F.sum("_rows").over(Window.partitionBy(item)))
    return u.where(F.col("_n") >= min_rows).select(item, reader, *rest_cols)


def mismatches(ratings: DataFrame, item: str, cats: Sequence[str]) -> DataFrame:
    """Items where some category takes more than one value across raters.

    Values are distinct counts per category with NULL counted as a value."""
    # Distinct (item, category, value) rows, then their number: several distinct counts in one
    # aggregate would deal every row once for each of them.
    cells = F.array(*[
        F.struct(F.lit(i).alias("cat"), *[F.when(F.lit(i == j), F.col(v)).alias(f"v{j}") for j, v in enumerate(cats)])
        for i in range(len(cats))
    ])
    found = ratings.select(item, F.explode(cells).alias("_c")).select(item, "_c.*").distinct()
    agg = found.groupBy(item).agg(*[F.count_if(F.col("cat") == i).alias(c) for i, c in enumerate(cats)])
    cond = None
    for c in cats:
        cond = (F.col(c) > 1) if cond is None else (cond | (F.col(c) > 1))
    return agg.where(cond)


def long_ratings(
    ratings: DataFrame, item: str, reader: str, cats: Sequence[str]
) -> DataFrame:
    """Wide rating rows -> (item, reader, variable, response) with responses as text."""
    kv = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("response"))
            for c in cats
        ])
    ).alias("kv")
    return ratings.select(item, reader, kv).select(item, reader, "kv.variable", "kv.response")


def single_ratings(
    long: DataFrame, item: str, reader: str, variable: str = "variable", response: str = "response"
) -> DataFrame:
    """Ratings of the readers who rated an (item, variable) exactly once.

    Percent agreement compares an item for a pair of raters only when each of them has one
    row for it, so repeated ratings drop the item for every pair of that rater."""
    return (
        long.groupBy(item, reader, variable)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(response).alias(response))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


# What the row counts of a block stand for: all rows, rows with a response, equal responses.
_ALL, _ANSWERED, _EQUAL = 0, 1, 2


def _pairs_inside(
    long: DataFrame, names: DataFrame, item: str, reader: str, variable: str, response: str, block: int
) -> DataFrame:
    """(variable, kind, block, block, slot, slot, n): pairs of raters of one block."""
    seen = long.join(names, F.col(reader) == F.col("_reader")).select(
        F.col(item).alias("_item"), F.col(variable).alias("_variable"),
        F.col(response).cast("string").alias("_value"), "_blk", "_slot",
    )
    slots, pairs = range(block), [(s, t) for s in range(block) for t in range(s + 1, block)]
    per_value = seen.groupBy("_item", "_variable", "_value", "_blk").agg(
        *[F.count_if(F.col("_slot") == s).alias(f"c{s}") for s in slots]
    )
    answered = F.col("_value").isNotNull()
    per_item = per_value.groupBy("_item", "_variable", "_blk").agg(
        *[F.sum(f"c{s}").alias(f"a{s}") for s in slots],
        *[F.sum(F.when(answered, F.col(f"c{s}")).otherwise(0)).alias(f"m{s}") for s in slots],
        *[F.sum(F.when(answered, F.col(f"c{s}") * F.col(f"c{t}")).otherwise(0)).alias(f"e{s}_{t}") for s, t in pairs],
    )
    found = {_ALL: lambda s, t: F.col(f"a{s}") * F.col(f"a{t}"), _ANSWERED: lambda s, t: F.col(f"m{s}") * F.col(f"m{t}"),
             _EQUAL: lambda s, t: F.col(f"e{s}_{t}")}
    summed = per_item.groupBy("_variable", "_blk").agg(
        *[F.sum(n(s, t)).alias(f"p{kind}_{s}_{t}") for kind, n in found.items() for s, t in pairs]
    )
    cells = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("s"), F.lit(t).alias("t"), F.col(f"p{kind}_{s}_{t}").alias("n"))
        for kind in found for s, t in pairs
    ])
    return summed.select("_variable", F.col("_blk").alias("_lo"), F.col("_blk").alias("_hi"), F.explode(cells).alias("p")).select(
        "_variable", F.col("p.kind").alias("_kind"), "_lo", "_hi", F.col("p.s").alias("_s"), F.col("p.t").alias("_t"), F.col("p.n").alias("_n")
    ).where(F.col("_n") > 0)


def _pairs_across(
    long: DataFrame, names: DataFrame, item: str, reader: str, variable: str, response: str, block: int
) -> DataFrame:
    """The same for raters of two blocks: the blocks of an item meet by an equi-join."""

    def view(kind: int, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    answer = F.col(response).cast("string")
    views = F.when(answer.isNull(), F.array(view(_ALL, F.lit("")))).otherwise(
        F.array(view(_ALL, F.lit("")), view(_ANSWERED, F.lit("")), view(_EQUAL, answer))
    )
    keys = ["_item", "_variable", "_kind", "_value"]
    seen = long.join(names, F.col(reader) == F.col("_reader")).select(
        F.col(item).alias("_item"), F.col(variable).alias("_variable"), "_blk", "_slot", F.explode(views).alias("_v")
    ).select("_item", "_variable", F.col("_v.kind").alias("_kind"), F.col("_v.value").alias("_value"), "_blk", "_slot")
    counts = seen.groupBy(*keys, "_blk").agg(*[F.count_if(F.col("_slot") == s).alias(f"c{s}") for s in range(block)])
    lo, hi = counts.alias("lo"), counts.alias("hi")
    same = F.col("lo._blk") < F.col("hi._blk")
    for k in keys:
        same = same & F.col(f"lo.{k}").eqNullSafe(F.col(f"hi.{k}"))
    slots = [(s, t) for s in range(block) for t in range(block)]
    summed = (
        lo.join(hi, same)
        .groupBy(F.col("lo._variable").alias("_variable"), F.col("lo._kind").alias("_kind"),
                 F.col("lo._blk").alias("_lo"), F.col("hi._blk").alias("_hi"))
        .agg(*[F.sum(F.col(f"lo.c{s}") * F.col(f"hi.c{t}")).alias(f"p_{s}_{t}") for s, t in slots])
    )
    cells = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.col(f"p_{s}_{t}").alias("n")) for s, t in slots
    ])
    return summed.select("_variable", "_kind", "_lo", "_hi", F.explode(cells).alias("p")).select(
        "_variable", "_kind", "_lo", "_hi", F.col("p.s").alias("_s"), F.col("p.t").alias("_t"), F.col("p.n").alias("_n")
    ).where(F.col("_n") > 0)


def pair_counts(
    long: DataFrame,
    item: str,
    reader: str,
    variable: str = "variable",
    response: str = "response",
    block: int = 8,
    roster: DataFrame | None = None,
) -> DataFrame:
    """Per (reader_1, reader_2, variable) with reader_1 < reader_2, over the pairs of their
    rows for one item: all pairs (``n_both``), equal responses (``n_agree``), different
    responses (``n_disagree``) and pairs with a NULL response (``n_na``). Pairs that share no
    item are absent. A rater with several rows for an item gives a pair for each of them; use
    :func:`single_ratings` or :func:`rating_union` first to leave those out. Rows without a
    reader are ignored; a NULL item or variable is a value like any other.

    ``roster`` (a table with the ``reader`` column) can name the raters up front;
    otherwise it is derived from the ratings.

    Plan: raters get a contiguous index, hence a block and a slot, kept in a small table ->
    rows counted per slot for each (item, variable, response, block) that occurs, then per
    (item, variable, block), where the pairs inside the block are products of counts -> sums
    per block. Only if there are several blocks, those of one item meet each other as well.
    Nothing is collected, and any number of raters takes the same path.
    """
    names = dense_index(
        (long if roster is None else roster).select(F.col(reader).alias("_reader")).where(F.col("_reader").isNotNull()),
        "_reader", "_ri",
    ).select(
        "_reader", F.floor(F.col("_ri") / block).alias("_blk"), (F.col("_ri") % block).cast("int").alias("_slot")
    )
    names = materialize(names, "raters")
    flat = _pairs_inside(long, names, item, reader, variable, response, block)
    if not names.where(F.col("_blk") > 0).isEmpty():
        flat = flat.unionByName(_pairs_across(long, names, item, reader, variable, response, block))
    per_pair = flat.groupBy("_variable", "_lo", "_hi", "_s", "_t").agg(*[
        F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("_n"))), F.lit(0)).alias(f"_n{kind}")
        for kind in (_ALL, _ANSWERED, _EQUAL)
    ])

    def named(col: str, blk: str, slot: str) -> DataFrame:
        return names.select(F.col("_reader").alias(col), F.col("_blk").alias(blk), F.col("_slot").alias(slot))

    out = per_pair.join(named("reader_1", "_lo", "_s"), ["_lo", "_s"]).join(named("reader_2", "_hi", "_t"), ["_hi", "_t"])
    return out.select(
        "reader_1", "reader_2", F.col("_variable").alias(variable), F.col(f"_n{_ALL}").alias("n_both"),
        F.col(f"_n{_EQUAL}").alias("n_agree"), (F.col(f"_n{_ANSWERED}") - F.col(f"_n{_EQUAL}")).alias("n_disagree"),
        (F.col(f"_n{_ALL}") - F.col(f"_n{_ANSWERED}")).alias("n_na"),
    )


def agreement_overall(
    long: DataFrame,
    item: str,
    variable: str = "variable",
    response: str = "response",
) -> DataFrame:
    """Agree / disagree / NA pair counts per variable and overall (variable NULL),
    without forming pairs: per (item, variable) with n raters, m non-NULL responses and
    value counts c_v, agree = sum c_v(c_v-1)/2, disagree = m(m-1)/2 - agree,
    na = n(n-1)/2 - m(m-1)/2."""
    per_value = long.groupBy(item, variable, response).agg(F.count(F.lit(1)).alias("_c"))
    per_item = per_value.groupBy(item, variable).agg(
        F.sum("_c").alias("_n"),
        F.sum(F.when(F.col(response).isNotNull(), F.col("_c")).otherwise(0)).alias("_m"),
        F.sum(F.when(F.col(response).isNotNull(), F.col("_c") * (F.col("_c") - 1) / 2).otherwise(0)).alias("_a"),
    )
    return per_item.rollup(variable).agg(
        F.sum("_a").cast("long").alias("n_agree"),
        F.sum(F.col("_m") * (F.col("_m") - 1) / 2 - F.col("_a")).cast("long").alias("n_disagree"),
        F.sum(F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_m") * (F.col("_m") - 1) / 2).cast("long").alias("n_na"),
    )


def pair_type(r1: Column, r2: Column, model_pattern: str) -> Column:
    """'Human-Model' when either rater name matches ``model_pattern``, else 'Human-Human'."""
    hit = F.concat_ws(" ", r1, r2).rlike(model_pattern)
    return F.when(hit, F.lit("Human-Model")).otherwise(F.lit("Human-Human"))


def percent_agreement(pairs: DataFrame, model_pattern: str, variable: str = "variable") -> DataFrame:
    """Per (pair, category): share of co-rated items with equal responses (NULL
    comparisons excluded; NULL when none is left) and the pair type."""
    return pairs.select(
        F.concat_ws("-", "reader_1", "reader_2").alias("pair"),
        F.col(variable).alias("category"),
        safe_div(F.col("n_agree"), F.col("n_agree") + F.col("n_disagree")).alias("percent_agreement"),
        pair_type(F.col("reader_1"), F.col("reader_2"), model_pattern).alias("pair_type"),
    )


def agreement_se(pct: DataFrame) -> DataFrame:
    """Mean, sample sd, n and standard error of percent agreement by category x type."""
    agg = pct.groupBy("category", "pair_type").agg(
        F.avg("percent_agreement").alias("mean_agreement"),
        F.stddev_samp("percent_agreement").alias("sd_agreement"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.withColumn("se", safe_div(F.col("sd_agreement"), F.sqrt(F.col("n"))))


def agreement_by_type(pct: DataFrame) -> DataFrame:
    """Mean percent agreement per pair type (all categories together)."""
    return pct.groupBy("pair_type").agg(F.avg("percent_agreement").alias("mean_agreement"))


def agreement_box(pct: DataFrame) -> DataFrame:
    """Box statistics (min, quartiles with linear interpolation, max) by category x type.

    Exact, and no group is held in one buffer: see :func:`ordering.quantiles`."""
    box = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(pct, ["category", "pair_type"], "percent_agreement", box)


def prevalence(ratings: DataFrame, reader: str, cats: Sequence[str]) -> DataFrame:
    """Positive rate (mean of a 0/1 column, NULL ignored) per reader x category."""
    kv = F.explode(
        F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("double").alias("value")) for c in cats])
    ).alias("kv")
    long = ratings.select(reader, kv).select(reader, "kv.category", "kv.value")
    return long.groupBy(reader, "category").agg(F.avg("value").alias("positive_rate"))


def human_vs_model(prev: DataFrame, reader: str, model_reader: str) -> DataFrame:
    """Model rate next to the human mean and sample sd of rates, per category."""
    model = prev.where(F.col(reader) == model_reader).select(
        "category", F.col("positive_rate").alias("model_rate")
    )
    humans = prev.where(F.col(reader) != model_reader).groupBy("category").agg(
        F.avg("positive_rate").alias("mean_human_rate"),
        F.stddev_samp("positive_rate").alias("sd_human_rate"),
    )
    return model.join(humans, "category", "left")


def comparison_long(cmp: DataFrame) -> DataFrame:
    """Model and human rates in long form for side-by-side display: rater 'Model' with
    sd 0 and rater 'Humans' with the human sd (``pivot_longer`` + recode)."""
    kv = F.explode(F.array(
        F.struct(F.lit("Model").alias("rater"), F.col("model_rate").alias("rate"), F.lit(0.0).alias("sd")),
        F.struct(F.lit("Humans").alias("rater"), F.col("mean_human_rate").alias("rate"),
                 F.col("sd_human_rate").alias("sd")),
    )).alias("kv")
    return cmp.select("category", kv).select("category", "kv.rater", "kv.rate", "kv.sd")


def disagreement_items(long: DataFrame, item: str, variable: str = "variable", response: str = "response") -> DataFrame:
    """(item, variable) groups where two raters give different non-NULL responses."""
    return (
        long.where(F.col(response).isNotNull())
        .groupBy(item, variable)
        .agg(F.count_distinct(response).alias("_k"))
        .where(F.col("_k") > 1)
        .select(item, variable)
    )


def inspect_disagreements(
    long: DataFrame,
    docs: DataFrame,
    item: str,
    doc_cols: Sequence[str],
    doc_order: Sequence[str],
    reader: str = "reader",
    variable: str = "variable",
    response: str = "response",
) -> DataFrame:
    """Rater responses of disagreeing (item, variable) groups next to the item's first
    document row (``doc_order``) -- one row per rater, not per rater pair."""
    bad = disagreement_items(long, item, variable, response)
    first = docs.groupBy(item).agg(
        F.min_by(F.struct(*[F.col(c) for c in doc_cols]), _struct(doc_order)).alias("_d")
    ).select(item, *[F.col(f"_d.{c}").alias(c) for c in doc_cols])
    rows = long.join(bad, [item, variable], "left_semi")
    return rows.join(first, item, "inner").select(item, reader, variable, response, *doc_cols)


def jaccard(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(|A ∩ B|, |A ∪ B|, similarity) of two arrays; duplicates removed; similarity
    NULL when the union is empty. A NULL list gives NULL for all three (whatever the
    session's legacy ``size(NULL)`` setting)."""
    missing = a.isNull() | b.isNull()
    inter = F.when(~missing, F.size(F.array_intersect(a, b)))
    uni = F.when(~missing, F.size(F.array_union(a, b)))
    return inter, uni, F.when(uni > 0, inter / uni)


def set_similarity(df: DataFrame, item: str, left: str, right: str, sep: str = r"\s*[;,]\s*") -> DataFrame:
    """Jaccard similarity of two delimited lists per row."""
    inter, uni, sim = jaccard(tokens(F.col(left), sep), tokens(F.col(right), sep))
    return df.select(item, inter.alias("inter"), uni.alias("uni"), sim.alias("similarity"))


def label_support(
    answers: DataFrame,
    item: str,
    rep: Sequence[str],
    answer: str,
    expected_reps: int = 3,
    unknown: Sequence[str] = ("None", ""),
    sep: str = r"\s*[,;|]\s*",
) -> DataFrame:
    """Per (item, label): replicates naming the label, replicate count of the item, and
    support = named / ``expected_reps`` (a constant, as in the original).

    Answers equal to one of ``unknown`` (or NULL) are skipped; a label repeated inside one
    answer counts once for that replicate.
    """
    reps = answers.groupBy(item).agg(F.count(F.lit(1)).alias("n_reps"))
    ok = answers.where(~F.coalesce(F.col(answer).isin(list(unknown)), F.lit(True)))
    exploded = ok.select(item, *rep, F.explode(F.split(F.col(answer), sep)).alias("_l"))
    exploded = exploded.select(item, *rep, F.regexp_replace("_l", r"^\s+|\s+$", "").alias("label"))
    exploded = exploded.where(F.col("label") != "").distinct()
    counts = exploded.groupBy(item, "label").agg(F.count(F.lit(1)).alias("n_included"))
    out = counts.join(reps, item, "left")
    return out.withColumn("agreement_rate", F.col("n_included") / F.lit(float(expected_reps)))


def modal_agreement(
    answers: DataFrame, item: str, answer: str, unknown: Sequence[str] = ("None", "")
) -> DataFrame:
    """Per item over known answers: n_reps, share of the most frequent answer, and
    whether all answers are identical."""
    ok = answers.where(~F.coalesce(F.col(answer).isin(list(unknown)), F.lit(True)))
    per = ok.groupBy(item, answer).agg(F.count(F.lit(1)).alias("_c"))
    agg = per.groupBy(item).agg(
        F.sum("_c").alias("n_reps"), F.max("_c").alias("_max"), F.count(F.lit(1)).alias("_k")
    )
    return agg.select(
        item, "n_reps", (F.col("_max") / F.col("n_reps")).alias("modal_agreement"),
        (F.col("_k") == 1).alias("full_agreement"),
    )
