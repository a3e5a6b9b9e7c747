"""Toxic passages as maximum-scoring segments over token log-odds.

Tokens get log-odds between toxic and other labelled texts under a Dirichlet prior, drawn to
the near end of a likelihood-ratio interval, less a drift, so that ordinary text scores below zero. A linear-time scan finds every
maximal scoring segment of a text (Ruzzo and Tompa, 1999); a segment's significance follows
the extreme-value distribution of such scores (Karlin and Altschul, 1990), and a text's
strongest evidence is calibrated to a probability on the labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._common import materialize

#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 1 << 18
#: Uses, of all in the corpus, that the prior leaves to words it has not seen.
UNSEEN = 1 << 16
#: Tokens are runs of ASCII letters, digits and multi-byte characters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bins of a text's evidence, in nats, for the calibration.
BIN, LOWEST, HIGHEST = 0.25, -20.0, 60.0


def token_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, word) of every token; a word is its 64-bit hash."""
    start, end, row = K.word_spans(raw, off, _SEPARATOR)
    return start, end, row, K.span_hash(raw, start, end, lower=True).view(np.int64)


def word_counts_by_label(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(word, n0, n1): uses of every word in clean and in toxic texts of all labelled rows.

    A task adds up to HELD_WORDS words before handing them on; Spark sums.
    """

    def add(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, at = np.unique(word, return_inverse=True)
        return kinds, np.stack([np.bincount(at, weights=x, minlength=len(kinds)) for x in n]).astype(np.int64)

    def batch(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n[0]), pa.array(n[1])], ["word", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.empty(0, np.int64), np.empty((2, 0), np.int64)
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            label = b.column(1).to_numpy()
            for i, j in K.chunks(off):
                _, _, row, found = token_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                y = label[i:j][row]
                word, n = add(np.append(word, found), np.append(n, np.stack([y == 0, y == 1]), axis=1))
                if len(word) > HELD_WORDS:
                    yield batch(word, n)
                    word, n = word[:0], n[:, :0]
        yield batch(word, n)

    cols = labelled.select(F.col(text_col).alias("t"), (F.col(label_col) > 0).cast("int").alias("y")).where("y is not null")
    rows = cols.mapInArrow(run, "word long, n0 long, n1 long")
    return rows.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def with_prior(n0, n1, total: np.ndarray, strength: float) -> tuple:
    """(y0, y1, rest0, rest1): a word's uses and all other uses in clean and in toxic texts,
    each with a Dirichlet prior proportional to the corpus. Takes numbers, arrays or columns."""
    prior = (n0 + n1) * (strength / float(total.sum() + UNSEEN))
    y0, y1 = n0 + prior, n1 + prior
    return y0, y1, float(total[0] + strength) - y0, float(total[1] + strength) - y1


def passes(y0: Column, y1: Column, rest0: Column, rest1: Column, margin: float) -> Column:
    """Whether the likelihood-ratio interval of ``margin`` standard errors around a word's
    log-odds leaves out 0: twice the log-likelihood lost by the shares of all other uses."""
    n, rest = y0 + y1, rest0 + rest1
    lost = y0 * F.log(y0 * rest / (n * rest0)) + y1 * F.log(y1 * rest / (n * rest1))
    return 2 * lost > margin**2


def log_odds(n0: np.ndarray, n1: np.ndarray, total: np.ndarray, strength: float, margin: float, drift: float) -> np.ndarray:
    """Score of each word: the end nearer 0 of the likelihood-ratio interval of ``margin``
    standard errors around its log-odds under the prior, or 0 if the interval has 0, less ``drift``.

    Given its n uses, those in toxic texts are binomial. The interval narrows with every use,
    also of a word never seen in one kind of text.
    """
    y0, y1, rest0, rest1 = with_prior(n0.astype(float), n1.astype(float), total, strength)
    even = np.log(rest1 / rest0)  # the logit at which the log-odds are 0
    top = np.log(y1 / y0)
    loglik = lambda t: y1 * t - (y0 + y1) * np.logaddexp(0, t)
    least = loglik(top) - margin**2 / 2
    inside, outside = top, even
    for _ in range(60):
        mid = (inside + outside) / 2
        in_it = loglik(mid) >= least
        inside, outside = np.where(in_it, mid, inside), np.where(in_it, outside, mid)
    return np.where(loglik(even) >= least, 0.0, inside - even) - drift


def extreme_value_rate(scores: np.ndarray, background: np.ndarray) -> float:
    """The positive root of sum p exp(rate * s) = 1 under the background's token frequencies.

    The last score stands for all words without evidence.
    """
    if not (scores > 0).any() or background.sum() == 0:
        return 1.0
    p = (background + 1e-9) / (background + 1e-9).sum()
    low, high = 1e-6, 1.0
    value = lambda r: float((p * np.exp(np.minimum(r * scores, 500))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def maximal_segments(before: list[float], after: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments over positive steps k from before[k] to after[k] of the
    running total: (first step, last step).

    A stack of disjoint candidates, each with the place of the nearest one below that begins
    at a smaller total. A search follows these places, so a candidate it passes over is not
    looked at again by later ones, and the time is linear.
    """
    stack: list[tuple[int, int, int]] = []  # first, last, place of the nearest lower beginning
    for k in range(len(before)):
        first, j = k, len(stack) - 1
        while True:
            while j >= 0 and before[stack[j][0]] >= before[first]:
                j = stack[j][2]
            if j < 0 or after[stack[j][1]] >= after[k]:
                break
            first, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((first, k, j))
    return [(first, last) for first, last, _ in stack]


def toxic_passages(
    docs: DataFrame,
    words: np.ndarray,
    scores: np.ndarray,
    rate: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    significance: float = 0.01,
) -> DataFrame:
    """One row per document: id, n_tokens, evidence, passages (start, end, score, p_value).

    ``words`` are sorted; their scores are in their order, then the score of any other word.
    Passages are all maximal segments with p_value <= ``significance``, as byte offsets.
    evidence is rate * score - ln(tokens) of the best segment; a text with no positive token
    has the lowest evidence. Null and empty texts have none.
    """
    passage = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
        + [T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType())]
    )
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("evidence", T.DoubleType()),
            T.StructField("passages", T.ArrayType(passage)),
        ]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.text_bytes(b.column(1))
            for i, j in K.chunks(off):
                n, at = j - i, off[i : j + 1] - off[i]
                start, end, row, word = token_hashes(raw[off[i] : off[j]], at)
                slot = np.searchsorted(words, word)
                slot[np.append(words, 0)[slot] != word] = len(words)
                s = scores[slot]
                after = np.cumsum(s)
                count = K.row_counts(row, n)
                evidence, found = np.full(n, LOWEST), [[] for _ in range(n)]
                steps = np.flatnonzero(s > 0)
                cuts = np.searchsorted(row[steps], np.arange(n + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = steps[cuts[k] : cuts[k + 1]]
                    up = after[mine]
                    segments = maximal_segments((up - s[mine]).tolist(), up.tolist())
                    size = math.log(int(count[k]))
                    best = LOWEST
                    for first, last in segments:
                        score = float(up[last] - up[first] + s[mine[first]])
                        x = rate * score - size
                        best = max(best, x)
                        p = -math.expm1(-math.exp(min(-x, 700.0)))
                        if p <= significance:
                            found[k].append((int(start[mine[first]] - at[k]), int(end[mine[last]] - at[k]), score, p))
                    evidence[k] = min(best, HIGHEST)
                passages = [[dict(zip(("start", "end", "score", "p_value"), x, strict=True)) for x in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(count.astype(np.int64)), pa.array(evidence), pa.array(passages, kind)], schema.names
                )

    return docs.select(F.col(id_col), F.col(text_col).alias("__t")).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of P(label | x) on binned counts, by Newton's method.

    The classes weigh in by their counts; a small ridge keeps separable data finite.
    """
    centre, spread = float((x * n).sum() / n.sum()), 5.0
    z = (x - centre) / spread
    w = np.zeros(2)
    a = np.stack([z, np.ones_like(z)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
        ridge = np.array([0.05, 0.01])
        step = np.linalg.solve((a * (n * p * (1 - p))) @ a.T + np.diag(ridge), a @ (y - n * p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    slope = max(w[0] / spread, 0.0)
    return slope, float(w[1] - slope * centre)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    strength: float = 30000.0,
    margin: float = 3.0,
    drift: float = 1.0,
) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted, n_tokens, evidence, passages.

    Learns from the rows that ``learn_from`` (a condition on the id) marks and that ``labels`` names (of several
    labels for an id the largest; null labels say nothing). A score reads the text alone;
    null and empty texts have the score of no evidence. With no label of either kind every
    score is the share of label 1, or 0. Repeated rows and null ids are scored like any
    other; extra columns are ignored; an empty table gives none.
    """
    marked = labels.groupBy(F.col(id_col).alias("__i")).agg(F.max(label_col).alias("__y")).where("__i is not null and __y is not null")
    # clashing column names cannot meet: only the needed columns are kept
    basis = docs.where(learn_from).select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t"))
    # the labels grow with the texts: joined the same way at every size, never broadcast
    counts = materialize(word_counts_by_label(basis.join(marked.hint("merge"), "__i"), "__t", "__y"), "words")
    sums = counts.agg(F.sum("n0"), F.sum("n1")).first()
    total = np.array([x or 0 for x in sums], float)
    scored = passes(*with_prior(F.col("n0"), F.col("n1"), total, strength), margin)
    found = counts.where(scored).orderBy("word").toArrow()  # only words with evidence leave Spark, as three numbers
    words, n0, n1 = (found[c].to_numpy() for c in ("word", "n0", "n1"))
    scores = np.append(log_odds(n0, n1, total, strength, margin, drift), -drift)
    # a word never seen in clean text is not impossible there: half a use
    rate = extreme_value_rate(scores, np.append(n0 + 0.5, total[0] - n0.sum()))

    scan = materialize(toxic_passages(docs, words, scores, rate, id_col, text_col), "passages")
    known = scan.where(learn_from).select(F.col(id_col).alias("__i"), F.round(F.col("evidence") / BIN).cast("int").alias("bin"))
    rows = known.join(marked, "__i").groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col("__y") > 0).cast("long")).alias("y")).collect()
    slope, offset = 0.0, -30.0
    if rows:
        x, n, y = (np.array([r[c] for r in rows], float) for c in ("bin", "n", "y"))
        slope, offset = fit_logistic(x * BIN, n, y) if 0 < y.sum() < n.sum() else (0.0, 30.0 if y.sum() else -30.0)
    score = 1 / (1 + F.exp(-(F.col("evidence") * F.lit(slope) + F.lit(offset))))
    return scan.withColumn("score", score).select(
        id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "evidence", "passages"
    )
