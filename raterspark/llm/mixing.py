"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: Bits of a document's draw that one level of the sampling looks at.
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    """Words: maximal runs of bytes other than space and the control characters 9-13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_ranks(sources: DataFrame, source_col: str) -> DataFrame:
    """Adds ``rank`` (0..): position by code point, null last, without a global window.

    A range sort numbers the rows of each partition; the partitions' sizes, one row each,
    give the offsets.
    """
    ordered = sources.orderBy(F.col(source_col).asc_nulls_last())
    one = F.monotonically_increasing_id()
    numbered = materialize(
        ordered.withColumn("__p", F.shiftright(one, 33)).withColumn("__i", one.bitwiseAND(F.lit((1 << 33) - 1))), "ranks"
    )
    sizes = numbered.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(offsets), "__p").select(
        *sources.columns, (F.col("__before") + F.col("__i")).alias("rank")
    )


def water_fill(sources: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """Adds ``target`` to sources (size, weight): shares of the budget, capped and reshared.

    The budget is ``budget_share`` of all sizes. Sources over ``max_epochs`` times their
    size are clamped there and the excess goes to the others by weight, until none is over.
    Each round is one aggregate over the sources; only its few sums reach the driver.
    """
    cap = F.col("size") * max_epochs
    total = sources.agg(F.sum("size")).first()[0] or 0
    budget = budget_share * total
    capped = F.lit(False)
    clamped, weight, n_capped = 0, 0, -1
    while True:
        s = sources.agg(
            F.sum(F.when(capped, cap).otherwise(0)).alias("c"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("w"),
            F.count_if(capped).alias("n"),
        ).first()
        clamped, weight = s["c"] or 0, s["w"] or 0
        if s["n"] == n_capped or weight == 0:
            break
        n_capped = s["n"]
        capped = capped | (F.lit(budget - clamped) * F.col("weight") / F.lit(weight) >= cap)
    share = F.lit(float(budget - clamped)) * F.col("weight") / F.lit(max(weight, 1))
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def draw(id_col: str, seed: int) -> Column:
    """A document's seeded draw: 60 bits of the md5 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source_size, target (its source's), taken, and the
    columns ``carry`` of the input.

    ``size`` counts words (null text: 0). Sources in code point order, null last, weigh
    ``weights`` in turn. A source's target, rounded down to whole words, is made of whole
    repetitions of all its documents and a fractional one: its documents in the order of
    their seeded draw, taken whole until the target is met, the last of them in part. So a
    source takes exactly its target and no document over ``max_epochs`` times its size.

    The fractional repetition finds its last draw without sorting a source: the sizes are
    summed by source and ``LEVEL_BITS`` bits of the draw, three levels deep; only the
    documents of the last cell (2^-36 of a source) are ordered one by one. Rows with equal
    ids share a draw and are ordered by size, then taken in turn; repeated rows of one size
    are alike, so their order cannot matter to the totals. An empty table gives none.
    """
    sized = docs.select(
        F.col(id_col),
        F.col(source_col).alias("__s"),
        word_count(F.col(text_col)).alias("size"),
        draw(id_col, seed).alias("__draw"),
        *[F.col(c).alias(f"__carried_{k}") for k, c in enumerate(carry)],
    )
    carried = [F.col(f"__carried_{k}") for k in range(len(carry))]
    sized = materialize(sized, "sizes")
    sources = sized.groupBy("__s").agg(F.sum("size").alias("size"))
    sources = source_ranks(sources, "__s")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    sources = materialize(water_fill(sources, budget_share, max_epochs), "targets")
    need = F.floor("target")
    sources = sources.select(
        F.col("__s"),
        F.col("size").alias("source_size"),
        "target",
        F.when(F.col("size") > 0, F.floor(need / F.col("size"))).otherwise(0).alias("__whole"),
        F.when(F.col("size") > 0, need % F.col("size")).otherwise(0).alias("__rest"),
    )

    # the cell of each level in which the fractional repetition ends, and what is left for it
    edge = sources.select(F.col("__s").alias("__e"), F.col("__rest").alias("__left"), F.lit(0).cast("long").alias("__cell"))
    inside = sized
    for level in (1, 2, 3):
        shift = 60 - LEVEL_BITS * level
        cell = F.shiftright("__draw", shift)
        cells = inside.groupBy("__s", cell.alias("__c")).agg(F.sum("size").alias("__n"))
        running = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("__upto", F.sum("__n").over(running))
        hit = cells.join(edge, F.col("__s").eqNullSafe(F.col("__e"))).where("__upto > __left")
        edge = materialize(
            hit.groupBy(F.col("__s").alias("__e")).agg(
                F.min(F.struct("__c", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("l"))).alias("m")
            ).select("__e", F.col("m.l").alias("__left"), F.col("m.__c").alias("__cell")),
            "edge",
        )
        at = edge.select(F.col("__e"), F.col("__cell"))
        inside = sized.join(at, F.col("__s").eqNullSafe(F.col("__e")) & (cell == F.col("__cell"))).drop("__e", "__cell")

    order = Window.partitionBy("__s").orderBy("__draw", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    last = inside.withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.join(edge, F.col("__s").eqNullSafe(F.col("__e"))).select(
        F.col(id_col), "__s", "size", "__draw",
        F.greatest(F.lit(0), F.least("size", F.col("__left") - F.col("__before"))).alias("__extra"),
        *carried,
    )
    rest = sized.join(edge, F.col("__s").eqNullSafe(F.col("__e")), "left")
    mine = F.shiftright("__draw", 60 - 3 * LEVEL_BITS)
    rest = rest.where(F.col("__cell").isNull() | (mine != F.col("__cell"))).select(
        F.col(id_col), "__s", "size", "__draw",
        F.when(mine < F.col("__cell"), F.col("size")).otherwise(0).alias("__extra"),
        *carried,
    )
    both = rest.union(last).join(sources.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")))
    return both.select(
        F.col(id_col),
        F.col("size"),
        F.col("source_size"),
        F.col("target"),
        (F.col("__whole") * F.col("size") + F.col("__extra")).cast("long").alias("taken"),
        *[c.alias(name) for c, name in zip(carried, carry, strict=True)],
    )
