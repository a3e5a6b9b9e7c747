"""Filter interaction audit on sorted posting lists.

Every part of the corpus keeps, for each filter, the sorted list of its failing documents,
cut into id ranges. What a filter removes after others is a difference of its list and the
union of theirs; unions and differences come from galloping merges of the lists of a range,
and the sizes of all ranges are added up. No order of filters is ever run over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import materialize, spread_join

WORD = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that read one text: A short, B repetitive, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> tuple[DataFrame, str]:
    """(part, id, mask, n) of all rows, and the filters' names in the order of the mask's bits.

    n rows share part, id and mask, so no id is more than 32 rows of a part. The last filter,
    E, is having the text of a smaller id; rows of one id never make each other fail, and
    rows with a null id neither fail it nor make others fail.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    filters = text_filters(F.col("__t"))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())]
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("__t"))
    flagged = read.select("part", "id", sum(bits[1:], bits[0]).alias("mask"), F.xxhash64("__t").alias("h"), F.md5("__t").alias("m"))
    rows = materialize(flagged.groupBy("part", "id", "mask", "h", "m").agg(F.count("*").alias("n")), "flags")
    first = rows.where("id is not null").groupBy("h", "m").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copied = first.where("last > first").drop("last")
    marked = spread_join(rows, copied, ["h", "m"], "id", "left")
    mask = F.col("mask") + F.when(F.col("id") > F.col("first"), F.lit(1 << len(bits))).otherwise(F.lit(0))
    out = marked.select("part", "id", mask.alias("mask"), "n").groupBy("part", "id", "mask").agg(F.sum("n").alias("n"))
    return out, "".join(filters) + "E"


def failing_lists(rows: DataFrame, lists: int) -> DataFrame:
    """Posting lists by part and id range: (part, ids, copies, lists).

    ``rows`` are (part, id, mask, n). ids are the range's ascending ids with any bit set
    (nulls first; an id with several masks stands there once for each), copies how many rows
    each of them is, and lists[k] the ascending positions of those with bit k. A range is
    what an Arrow batch holds of one part, so no list outgrows a batch.
    """
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.StringType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("copies", T.ArrayType(T.LongType())),
            T.StructField("lists", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, mask = b.column(0), b.column(2).to_numpy()
            codes = part.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else [0]
            for i, j in zip(cuts, cuts[1:]):
                found = [np.flatnonzero(mask[i:j] >> k & 1).astype(np.int32) for k in range(lists)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.slice(i, 1),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(1).slice(i, j - i)),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(3).slice(i, j - i)),
                        pa.array([found], pa.list_(pa.list_(pa.int32()))),
                    ],
                    schema.names,
                )

    # a range partition holds many ids: one part's ids go to several tasks, none is a hot key
    dealt = rows.where("mask > 0").repartitionByRange("part", "id", "mask").sortWithinPartitions("part", "id", "mask")
    return dealt.select("part", "id", "mask", "n").mapInArrow(run, schema)


def in_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the elements of ascending ``a`` that are in ascending ``b``.

    The shorter list gallops through the longer one, from match to match.
    """
    if len(a) > len(b):
        out = np.zeros(len(a), bool)
        at = np.searchsorted(a, b)
        inside = at < len(a)
        at, b = at[inside], b[inside]
        out[at[a[at] == b]] = True
        return out
    at = np.searchsorted(b, a)
    out = at < len(b)
    out[out] = b[at[out]] == a[out]
    return out


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Union of ascending lists: the longest takes in the others, shortest last, each galloping
    over the runs between its own elements, which are copied whole."""
    lists = sorted(lists, key=len, reverse=True)
    out = lists[0] if lists else np.empty(0, np.int32)
    for x in lists[1:]:
        new = x[~in_list(x, out)]
        out = np.insert(out, np.searchsorted(out, new), new)
    return out


def overlap_sizes(lists: DataFrame, filters: int, marks: int) -> DataFrame:
    """(part, filter, before, gone, removed, mark_0 ..): for each filter and each set ``before``
    of others (a bit mask), how many rows it removes after them, how many of those stand in
    each of the lists behind the filters', and how many are gone then."""
    names = ["part", "filter", "before", "gone", "removed", *(f"mark_{k}" for k in range(marks))]
    cases = [(f, s) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                copies = np.array(r["copies"], np.int64)
                own = [np.array(x, np.int32) for x in r["lists"]]
                unions = [union([own[f] for f in range(filters) if s >> f & 1]) for s in range(1 << filters)]
                rows = []
                for f, s in cases:
                    rest = own[f][~in_list(own[f], unions[s])]
                    hits = [int(copies[rest[in_list(rest, x)]].sum()) for x in own[filters:]]
                    rows.append((r["part"], f, s, int(copies[unions[s | 1 << f]].sum()), int(copies[rest].sum()), *hits))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=kind)

    kind = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32())] + [(c, pa.int64()) for c in names[3:]])
    sizes = lists.mapInArrow(run, "part string, filter int, before int, " + ", ".join(f"{c} long" for c in names[3:]))
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names[3:]])


def filter_interactions(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    marks: tuple[tuple[str, str], ...] = (("good_lost", "quality"), ("toxic_lost", "toxic")),
) -> DataFrame:
    """One row per part, order of the five filters and step: what the step's filter removes.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, a column for
    each of ``marks`` (removed rows whose id has that label 1 in any row of ``labels``) and
    shapley (removed, summed over all orders). All count rows of the part; parts where nothing
    fails have zeros.

    Null texts are empty texts, which fail A; a null part is the empty string. Texts are read
    whole, one in memory at a time. Repeated rows count as often as they occur, and no row
    makes one of its own id fail E; rows with a null id have no label. Of ties in the text the
    smallest id passes. Other columns are not read, whatever their names; an empty table
    gives no row, an empty label table zeros.
    """
    rows, names = failures(docs, id_col, text_col, part_col)
    k = len(names)
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"__{name}") for name, c in marks]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags)
    bits = [F.coalesce(f"__{name}", F.lit(0)) * (1 << k + j) for j, (name, _) in enumerate(marks)]
    marked = rows.join(known, "id", "left").select("part", "id", (F.col("mask") + F.when(F.col("mask") > 0, sum(bits, F.lit(0))).otherwise(0)).alias("mask"), "n")
    marked = materialize(marked, "failures")
    sizes = overlap_sizes(materialize(failing_lists(marked, k + len(marks)), "lists"), k, len(marks))

    cases = F.explode(F.sequence(F.lit(0), F.lit((k << k) - 1)))
    parts = marked.groupBy("part").agg(F.sum("n").alias("docs")).select("part", "docs", cases.alias("case"))
    cells = parts.select("part", "docs", F.shiftright("case", k).alias("filter"), F.col("case").bitwiseAND((1 << k) - 1).alias("before"))
    cells = cells.where(F.expr("bit_get(before, filter) = 0")).join(sizes, ["part", "filter", "before"], "left").na.fill(0)
    own = Window.partitionBy("part", "filter")  # the 16 sets of other filters
    turns = [factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1")) for s in range(1 << k - 1)]
    weight = F.element_at(F.array(*[F.lit(turns[(1 << j) - 1]) for j in range(k)]), F.bit_count("before") + 1)
    cells = cells.select(
        "part", "filter", "before", (F.col("docs") - F.col("gone")).alias("kept"), "removed",
        (F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(own) - F.col("removed")).alias("redundant"),
        F.sum(F.when(F.bit_count("before") == k - 1, F.col("removed"))).over(own).alias("unique_fails"),
        *[F.col(f"mark_{j}").alias(name) for j, (name, _) in enumerate(marks)],
        F.sum(F.col("removed") * weight).over(own).alias("shapley"),
    )
    steps = [
        ("".join(names[f] for f in order), step + 1, f, sum(1 << g for g in order[:step]))
        for order in permutations(range(k))
        for step, f in enumerate(order)
    ]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    return cells.join(F.broadcast(orders), ["filter", "before"]).select(  # 600 fixed rows
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[name for name, _ in marks], "shapley"
    )
