"""Source divergence audit by Gustavson row accumulation.

A term-major index holds, for each language and term, the sources that use the term and
their shares. For each source (a row) of a block of terms, the index lists of its terms are
scattered into one dense accumulator with a cell per peer; no pair of postings is ever a
row. Peers without a term have a baseline share above zero there, which is corrected from
sorted shares. The blocks' accumulators are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _kernels as K
from ._common import materialize

#: Bytes that separate terms: every ASCII character that is no letter.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = True
NO_LETTER[[*range(65, 91), *range(97, 123)]] = False
#: Text a task reads before it adds up, and rows it holds before it hands them on.
CHUNK_BYTES, HELD_ROWS = 1 << 21, 1 << 18
#: Postings of a block of terms; more where the language's pairs of sources outnumber them.
BLOCK_POSTINGS = 1 << 14
SCALE = 1_000_000_000


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a chunk of texts, A-Z lower-cased, and the row of each."""
    start, end, row = K.word_spans(raw, off, NO_LETTER)
    letters = K.LOWER[raw[~NO_LETTER[raw]]]  # terms are all that is no separator, end to end
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))
    return terms.cast(pa.string()).dictionary_encode() if offsets[-1] < 1 << 31 else terms.dictionary_encode(), row


def term_counts(docs: DataFrame, text_col: str, lang: Column, source: Column) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that have it."""

    def add(rows: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(rows).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return out.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            for i, j in K.chunks(off, CHUNK_BYTES):
                terms, row = terms_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                codes, kinds = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
                group = (b.column(1).slice(i, j - i).dictionary_encode(), b.column(2).slice(i, j - i).dictionary_encode())
                lang_of, source_of = (g.indices.to_numpy().astype(np.int64) for g in group)
                once, n = np.unique(row * kinds + codes, return_counts=True)  # document and term
                part = lang_of * len(group[1].dictionary) + source_of
                cell, at = np.unique(part[once // kinds] * kinds + once % kinds, return_inverse=True)
                total = np.zeros(len(cell), np.int64)
                np.add.at(total, at, n)
                parts = cell // kinds
                cols = (
                    group[0].dictionary.take(pa.array(parts // len(group[1].dictionary))),
                    group[1].dictionary.take(pa.array(parts % len(group[1].dictionary))),
                    terms.dictionary.cast(pa.string()).take(pa.array(cell % kinds)),
                    pa.array(total),
                    pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64)),
                )
                held.append(pa.table(cols, ["lang", "source", "term", "n", "docs"]))
                size += len(cell)
                if size > HELD_ROWS:
                    held = [add(held)]
                    size = held[0].num_rows
                    if size > HELD_ROWS // 2:
                        yield from held[0].combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from add(held).combine_chunks().to_batches()

    cols = docs.select(F.col(text_col).alias("t"), lang.alias("lang"), source.alias("source"))
    rows = cols.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, terms: Column | str, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)) in whole numbers."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    up, down = F.lit(SCALE) * (wide(count) + F.lit(smooth)), wide(total) + F.lit(smooth) * wide(terms)
    return F.call_function("div", up, F.when(down > 0, down)) + F.lit(1).cast("long")


def scatter(row: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Matrix of a block: cell (g, h) is what the block adds to the distance of rows g and h,
    less the baseline of all terms; (g, h) and (h, g) are to be added up.

    Postings are (row, term, p), sorted by row; zero is every row's share where it has none.
    """
    rows = len(zero)
    out = np.zeros((rows, rows), np.int64)
    order = np.argsort(term, kind="stable")  # the term-major index
    index_row, index_p = row[order], p[order]
    _, first, length = np.unique(term[order], return_index=True, return_counts=True)
    at = np.unique(term, return_inverse=True)[1]
    cuts = np.searchsorted(row, np.arange(rows + 1))
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        acc = out[g]
        mine = slice(cuts[g], cuts[g + 1])
        # every peer as if it had none of the row's terms: sums of |p - zero| from sorted shares
        ordered = np.sort(p[mine])
        below = np.searchsorted(ordered, zero)
        total = np.append(0, np.cumsum(ordered))
        gap = np.abs(zero - zero[g])
        acc += zero * below - total[below] + (total[-1] - total[below]) - zero * (len(ordered) - below) - len(ordered) * gap
        # correction, once for each two rows, where a peer has the term
        t = at[mine]
        hit = K.ragged(first[t], length[t])
        own = np.repeat(p[mine], length[t])
        peer, theirs = index_row[hit], index_p[hit]
        later = peer > g
        own, peer, theirs = own[later], peer[later], theirs[later]
        np.add.at(acc, peer, np.abs(own - theirs) - np.abs(own - zero[peer]) - np.abs(theirs - zero[g]) + gap[peer])
    return out


def pair_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of every two sources of a language.

    ``postings`` are (lang, source, term, p), ``groups`` (lang, source, terms, zero, blocks).
    """
    out_schema = "lang string, source string, item string, value long"

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        names, zero = right["source"].combine_chunks(), right["zero"].to_numpy()
        if left.num_rows:
            row = pa.compute.index_in(left["source"], names).to_numpy().astype(np.int64)
            order = np.argsort(row, kind="stable")
            term = left["term"].combine_chunks().dictionary_encode()
            term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
            acc = scatter(row[order], term[order].astype(np.int64), left["p"].to_numpy()[order], zero)
        else:
            acc = np.zeros((len(zero), len(zero)), np.int64)
        acc = acc + acc.T
        if key[1].as_py() == 0:  # the baseline of all terms, once
            acc += int(right["terms"][0].as_py()) * np.abs(zero[:, None] - zero[None, :])
        g, h = np.nonzero(~np.eye(len(zero), dtype=bool))
        lang = pa.repeat(key[0], len(g)).cast(pa.string())
        return pa.table([lang, names.take(pa.array(g)), names.take(pa.array(h)), pa.array(acc[g, h])], ["lang", "source", "item", "value"])

    blocks = groups.select("lang", "blocks").distinct()
    dealt = postings.join(blocks, "lang").select("lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "source", "term", "p")
    sent = groups.select("lang", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "source", "terms", "zero")
    found = dealt.groupBy("lang", "block").cogroup(sent.groupBy("lang", "block")).applyInArrow(run, out_schema)
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 30,
    smooth: int = 5,
    top: int = 50,
) -> DataFrame:
    """How each source's use of terms departs from its peers and from its language.

    Terms are runs of letters and non-ASCII characters with A-Z lower-cased; a language keeps
    those in at least ``least_docs`` of its documents. Shares are whole numbers of 1 / SCALE,
    ``smooth`` being added to every count. Rows: (lang, source, part, item, value, rank). Part
    ``pair`` has for each source every other source of the language with the summed absolute
    differences of their shares; part ``term`` the ``top`` terms that the source uses and
    whose share there exceeds the language's, with the excess. Ranks start at 1 by value,
    largest first, ties by item in byte order.

    Null text, lang and source are the empty string; documents without terms still make their
    source a group. Repeated rows count each time; texts of any length are read whole, one
    chunk of at least a text in memory; other columns are not read, whatever their names; an
    empty table gives none. A task holds one block of terms (some BLOCK_POSTINGS postings, or
    as many as the language has pairs of sources) and a square of the language's sources.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = materialize(term_counts(docs, text_col, empty(lang_col), empty(source_col)), "terms")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    vocabulary = materialize(vocabulary.where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    kept = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total")
    kept = materialize(kept, "kept")

    occurring = docs.groupBy(empty(lang_col).alias("lang"), empty(source_col).alias("source")).agg(F.count("*").alias("rows"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("postings"), F.count_distinct("source").alias("sources"))
    block = F.greatest(F.lit(BLOCK_POSTINGS), F.col("sources") * F.col("sources"))
    sizes = sizes.select("lang", (1 + F.floor(F.col("postings") / block)).alias("blocks"))
    groups = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sizes, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "terms", "lang_n"]).na.fill(1, ["blocks"])
    zero = F.coalesce(share(F.lit(0), "group_n", "terms", smooth), F.lit(0)).cast("long")
    groups = materialize(groups.drop("rows").withColumn("zero", zero), "groups")

    p = share("n", "group_n", "terms", smooth)
    q = share("total", "lang_n", "terms", smooth)
    weighted = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), (p - q).alias("excess"))
    pairs = pair_distances(weighted, groups).withColumn("part", F.lit("pair"))
    terms = weighted.where("excess > 0").select("lang", "source", F.col("term").alias("item"), F.col("excess").alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    )
    return ranked.select("lang", "source", "part", "item", "value", "rank")
