"""Language identification as inference of a mixture of languages per document.

Languages are distributions over hashed byte trigrams, learned from labelled rows. A
document's trigrams come from a mixture of a few of them: expectation-maximisation estimates
the proportions, and a language joins the set only if the likelihood it adds exceeds a
penalty per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K

CELLS = 1 << 14
UNKNOWN = "und"
_U = np.uint64

#: ASCII letters (lower-cased) and multi-byte characters speak for a language; the rest is blank.
_LETTER = K.LOWER.copy()
_LETTER[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Counters (texts x cells) a chunk may take to count its trigrams; beyond, they are sorted.
DENSE = 1 << 23


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every byte trigram within a row that is not all blank."""
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = _LETTER[raw].astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (row[:-2] == row[2:]) & (code != 0x202020)
    cell = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return row[:-2][ok], cell.astype(np.int64)


def language_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, cell, n) over all rows of ``docs`` with a language; tasks add up, Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            for i, j in K.chunks(off):
                row, cell = trigrams(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                names = sorted(set(langs[i:j]))
                code = np.array([names.index(x) for x in langs[i:j]])
                n = np.bincount(code[row] * CELLS + cell, minlength=len(names) * CELLS).reshape(len(names), CELLS)
                for k, x in enumerate(names):
                    sums[x] = sums[x] + n[k] if x in sums else n[k]
        for x, s in sums.items():
            cell = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(s[cell])], ["lang", "cell", "n"]
            )

    cols = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    return cols.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str, lang_col: str, prior: float = 0.5) -> tuple[list[str], np.ndarray, int]:
    """Languages (sorted), their smoothed trigram distributions (CELLS numbers each) and
    the one with most text."""
    rows = language_counts(docs, text_col, lang_col).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.full((len(langs), CELLS), prior)
    if langs:
        counts[np.searchsorted(langs, rows["lang"].to_numpy(str)), rows["cell"].to_numpy()] += rows["n"].to_numpy()
    total = counts.sum(axis=1, keepdims=True)
    return langs, counts / total, int(total.argmax()) if langs else -1


def infer(begin: np.ndarray, n: np.ndarray, cell: np.ndarray, theta: np.ndarray, penalty: float, rounds: int) -> tuple:
    """Proportions of every language and the posterior of the best single one, by document.

    begin: first entry of each document; n, cell: count and cell of an entry. Starts from the
    likeliest single language; the language with the steepest likelihood joins and EM
    re-estimates the proportions; it stays if the log-likelihood gains more than
    ``penalty * ln(trigrams)``. Documents that gain nothing leave the loop.
    """
    log = np.log(theta)
    size = np.diff(np.append(begin, len(n)))
    total = np.add.reduceat(n, begin).astype(float)
    single = np.add.reduceat(n[:, None] * log[:, cell].T, begin, axis=0)
    best = single.argmax(axis=1)
    posterior = 1 / np.exp(single - single.max(axis=1, keepdims=True)).sum(axis=1)
    share = np.zeros((len(begin), len(theta)))
    share[np.arange(len(begin)), best] = 1.0
    likelihood = single.max(axis=1)
    active = np.arange(len(begin))
    for _ in range(len(theta) - 1):
        at = K.ragged(begin[active], size[active])
        p, c = theta[:, cell[at]].T, n[at].astype(float)
        doc = np.repeat(np.arange(len(active)), size[active])
        first = np.cumsum(size[active]) - size[active]
        pi = share[active]
        mixed = (p * pi[doc]).sum(axis=1)
        steep = np.add.reduceat((c / mixed)[:, None] * p, first, axis=0)
        steep[pi > 0] = -1
        new = steep.argmax(axis=1)
        pi = pi * 0.8
        pi[np.arange(len(active)), new] = 0.2
        for _ in range(rounds):
            part = p * pi[doc]
            part *= (c / part.sum(axis=1))[:, None]
            pi = np.add.reduceat(part, first, axis=0) / total[active][:, None]
        gained = np.add.reduceat(c * np.log((p * pi[doc]).sum(axis=1)), first)
        stay = gained - likelihood[active] > penalty * np.log(total[active] + 1)
        share[active[stay]], likelihood[active[stay]] = pi[stay], gained[stay]
        active = active[stay]
        if not len(active):
            break
    return share, posterior


def identify_languages(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    penalty: float = 4.0,
    rounds: int = 8,
) -> DataFrame:
    """One row per document: id, lang_pred, score, languages, proportions.

    The model learns from text and non-null language of the rows ``learn_from`` marks; a
    prediction reads the text alone. lang_pred is the language with the largest proportion,
    score that proportion times the posterior of the likeliest single language. A text that
    has letters but under three bytes takes the language with most text; one that is null or
    has no letter is ``und`` with score 0 and no languages, as is every text when
    nothing was learned. Repeated rows and null ids are answered like any other; extra
    columns are ignored; an empty table gives none.
    """
    langs, theta, common = language_model(docs.where(learn_from), text_col, lang_col)
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.ArrayType(T.StringType())),
            T.StructField("proportions", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(langs, dtype=object)
        for b in batches:
            raw, off = K.text_bytes(b.column(1))
            for i, j in K.chunks(off, K.CHUNK_BYTES // 2):
                n = j - i
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                letters = np.bincount(np.repeat(np.arange(n), np.diff(at))[_ASCII_LETTER[part]], minlength=n) > 0
                for k in np.flatnonzero(~letters).tolist():
                    letters[k] = any(c.isalpha() for c in part[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
                row, cell = trigrams(part, at)
                if n * CELLS > DENSE:  # many short texts
                    entry, times = np.unique(row * CELLS + cell, return_counts=True)
                else:
                    dense = np.bincount(row * CELLS + cell, minlength=n * CELLS)
                    entry = np.flatnonzero(dense)
                    times = dense[entry]
                doc = entry // CELLS
                some = np.unique(doc)
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                sets, shares = [[] for _ in range(n)], [[] for _ in range(n)]
                for k in np.flatnonzero(letters & ~np.isin(np.arange(n), some)).tolist() if langs else ():
                    pred[k], score[k] = langs[common], 1 / len(langs)  # letters, but not three bytes
                    sets[k], shares[k] = [langs[common]], [1.0]
                if len(some) and langs:
                    share, posterior = infer(np.searchsorted(doc, some), times, entry % CELLS, theta, penalty, rounds)
                    top = share.argmax(axis=1)
                    for k, s, m, q in zip(some.tolist(), share, top.tolist(), posterior.tolist(), strict=True):
                        if letters[k]:
                            chosen = np.flatnonzero(s > 0)
                            pred[k], score[k] = langs[m], min(1.0, float(s[m]) * q)
                            sets[k], shares[k] = names[chosen].tolist(), s[chosen].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, n),
                        pa.array(pred, pa.string()),
                        pa.array(score),
                        pa.array(sets, pa.list_(pa.string())),
                        pa.array(shares, pa.list_(pa.float64())),
                    ],
                    schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col).alias("__t")).mapInArrow(run, schema)
