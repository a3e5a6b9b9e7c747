"""Deleted interpolation: a bigram model mixed by context-frequency buckets, as Spark stages.

P(w | h) = a_b ML(w | h) + c_b ML(w) + u_b / (V + 1), b the bucket of the context's count.
The mixture weights come from expectation-maximisation on held-out counts: one fold of the
training documents is deleted from the maximum-likelihood counts, and the weights are those
that make it likeliest. Counts live in buckets by hash of the n-gram; nothing that grows
with the corpus reaches the driver or is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._blocks import MESSAGE, block_of, by_bucket, group_starts, messages, sizes

_U = np.uint64
#: Keys of the two marks that are no words.
END, START = _U(0xA5A5A5A5A5A5A5A5), _U(0x5A5A5A5A5A5A5A5A)
#: Bins of a probability: half octaves down to 2^-31; the last one is probability 0.
BINS = 63
CONTEXT_BUCKETS = 32


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, their steps stored byte by byte: the high bytes are mostly zero."""
    step = np.diff(keys, prepend=_U(0))
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def pack_counts(*counts: np.ndarray) -> bytes:
    x = np.concatenate(counts).astype("<u8")
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    """Two rows of n counts."""
    raw = np.frombuffer(pa.decompress(data, 16 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(2, -1)


class Tokens:
    """The tokens of a block: words and one end per text, with their contexts."""

    def __init__(self, table: pa.Table):
        self.train, self.deleted = (table[c].to_numpy().astype(bool) for c in ("train", "deleted"))
        raw, off = K.text_bytes(table["t"])
        n = table.num_rows
        words, rows = [], []
        for i, j in K.chunks(off):
            part = raw[off[i] : off[j]]
            start, end, row = K.word_spans(part, off[i : j + 1] - off[i])
            words.append(K.span_hash(part, start, end, lower=True))
            rows.append(row + i)
        words, rows = (np.concatenate(words), np.concatenate(rows)) if words else (np.empty(0, _U), np.empty(0, np.int64))
        count = K.row_counts(rows, n) + 1
        self.begin = np.cumsum(count) - count
        self.count = count
        self.token = np.full(count.sum(), END, _U)
        hole = np.ones(len(self.token), bool)
        hole[self.begin + count - 1] = False
        self.token[hole] = words
        self.row = np.repeat(np.arange(n), count)
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.begin] = START
        self.gram = K.mix(context * _U(0x9E3779B97F4A7C15) + self.token) >> _U(8)
        self.word_keys, self.word_of = np.unique(self.token, return_inverse=True)
        self.gram_keys, self.gram_of = np.unique(self.gram, return_inverse=True)

    def own(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Training and deleted counts of each distinct key in this block."""
        t, d = self.train[self.row], self.deleted[self.row]
        return np.bincount(of[t], minlength=n), np.bincount(of[d], minlength=n)

    def totals(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word totals, gram totals, corpus sums) from the buckets' answers."""
        found = {(r["kind"], r["bucket"]): r for r in replies.to_pylist() if r["kind"] in (2, 3)}
        out = []
        for kind, keys in ((2, self.word_keys), (3, self.gram_keys)):
            total = np.zeros((2, len(keys)), np.int64)
            for bucket, p in by_bucket(bucket_of(keys, kind, buckets)):
                total[:, p] = unpack_counts(found[kind, bucket]["a"], len(p))
            out.append(total)
        sums = sum(np.frombuffer(r["b"], np.int64) for (kind, _), r in found.items() if kind == 2)
        return out[0], out[1], sums


def bucket_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    return K.mix(keys + _U(kind)) % _U(buckets)


def bins(p: np.ndarray) -> np.ndarray:
    """Half-octave bin of probabilities; 0 has the last bin."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(-2 * np.log2(p), BINS - 1), BINS).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1.0).astype(np.int64), CONTEXT_BUCKETS - 1)


def learn_weights(bucket: np.ndarray, bin2: np.ndarray, bin1: np.ndarray, n: np.ndarray, words: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by context bucket, by EM on binned counts.

    Buckets with no held-out count take the weights of all buckets together. One count each
    is added, so that no weight is 0.
    """

    def value(b: np.ndarray) -> np.ndarray:
        return np.where(b == BINS, 0.0, 2.0 ** (-(b + 0.5) / 2))

    p = np.stack([value(bin2), value(bin1), np.full(len(n), 1.0 / (words + 1))])

    def em(mine: np.ndarray, start: np.ndarray) -> np.ndarray:
        w, q, c = start, p[:, mine], n[mine]
        for _ in range(rounds):
            part = w[:, None] * q
            w = (part / part.sum(axis=0) * c).sum(axis=1) + 1.0
            w /= w.sum()
        return w

    every = em(np.ones(len(n), bool), np.full(3, 1 / 3)) if len(n) else np.full(3, 1 / 3)
    out = np.tile(every, (CONTEXT_BUCKETS, 1))
    for b in np.unique(bucket).tolist():
        out[b] = em(bucket == b, every)
    return out


def score_documents(
    docs: DataFrame,
    train: Column,
    deleted: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` marks the rows whose counts make the model, ``deleted`` those of them that are
    held out to learn the weights (the final counts include them). Tokens are the words of
    the text with A-Z lower-cased, then one end; null and empty texts are the end alone.
    base_score is add-one unigram, score the mixture's; both are log10 of the whole text.
    With no training rows every token has the uniform probability 1. Repeated ids and rows
    with a null id are scored like any other and spread by their texts; texts of any length
    are read whole; other columns are not read, whatever their names; an empty table gives none.
    """
    blocks, buckets = sizes(docs, text_col)
    texts = docs.select(
        block_of(id_col, text_col, blocks).alias("block"),
        F.col(id_col).alias("i"),
        F.col(text_col).alias("t"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(train & deleted, F.lit(False)).alias("deleted"),
    )

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        tokens, me, rows = Tokens(table), key[0].as_py(), []
        for kind, keys, of in ((0, tokens.word_keys, tokens.word_of), (1, tokens.gram_keys, tokens.gram_of)):
            c, d = tokens.own(of, len(keys))
            parts = dict(by_bucket(bucket_of(keys, kind + 2, buckets)))
            for bucket in range(buckets) if kind == 0 else parts:  # every bucket tells every block its sums
                p = parts.get(bucket, np.empty(0, np.int64))
                rows.append((bucket, me, kind, len(p), pack_keys(keys[p]), pack_counts(c[p], d[p]), None))
        return messages(rows)

    def answer(table: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            rows = [r for r in table.to_pylist() if r["kind"] == kind]
            if not rows:
                continue
            cuts = np.cumsum([r["n"] for r in rows])[:-1]
            keys = np.concatenate([unpack_keys(r["a"], r["n"]) for r in rows])
            counts = np.concatenate([unpack_counts(r["b"], r["n"]) for r in rows], axis=1)
            order = np.argsort(keys, kind="stable")
            lead = group_starts(keys[order])
            total = np.add.reduceat(counts[:, order], lead, axis=1) if len(lead) else counts
            back = np.empty_like(counts)
            back[:, order] = np.repeat(total, np.diff(np.append(lead, len(keys))), axis=1)
            # training and deleted tokens, and distinct training words, of this bucket
            sums = np.array([total[0].sum(), total[1].sum(), (total[0] > 0).sum()], np.int64).tobytes()
            for r, x in zip(rows, np.split(back, cuts, axis=1), strict=True):
                out.append((r["bucket"], r["block"], kind + 2, r["n"], pack_counts(*x), sums if kind == 0 else None, None))
        return messages(out)

    def estimates(tokens: Tokens, replies: pa.Table, without: bool) -> tuple[np.ndarray, ...]:
        """(bigram ML, unigram ML, context bucket) of every token, and the corpus sums."""
        word, gram, sums = tokens.totals(replies, buckets)
        minus = 1 if without else 0
        w = (word[0] - minus * word[1])[tokens.word_of]
        g = (gram[0] - minus * gram[1])[tokens.gram_of]
        total = sums[0] - minus * sums[1]
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[tokens.begin] = w[tokens.begin + tokens.count - 1]  # texts begin as often as they end
        return g / np.maximum(h, 1), w / max(total, 1), context_bucket(h), sums

    def held_out(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        cells = np.zeros((2, 0), np.int64)
        sums = np.zeros(3, np.int64)
        if left.num_rows:
            tokens = Tokens(left)
            p2, p1, b, sums = estimates(tokens, replies, True)
            mine = tokens.deleted[tokens.row]
            cell = (b[mine] * (BINS + 1) + bins(p2[mine])) * (BINS + 1) + bins(p1[mine])
            cells = np.stack(np.unique(cell, return_counts=True))
        return pa.table(
            [pa.array(cells[0]), pa.array(cells[1]), pa.array(np.full(cells.shape[1], int(sums[2])))], ["cell", "n", "words"]
        )

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
        words = int(table["words"][0].as_py())
        w = learn_weights(cell // (BINS + 1) ** 2, cell // (BINS + 1) % (BINS + 1), cell % (BINS + 1), n, words)
        return messages([(0, 0, 4, CONTEXT_BUCKETS, w.tobytes(), None, None)])

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )

    def score(key: tuple, left: pa.Table, replies: pa.Table) -> pa.Table:
        tokens = Tokens(left)
        word, _, sums = tokens.totals(replies, buckets)
        p2, p1, b, _ = estimates(tokens, replies, False)
        weights = [np.frombuffer(r["a"]).reshape(-1, 3) for r in replies.to_pylist() if r["kind"] == 4]
        w = (weights[0] if weights else np.full((CONTEXT_BUCKETS, 3), 1 / 3))[b]
        w[b == 0, 0] = 0.0  # a context never seen: the bigram estimate has no say
        if sums[0] == 0:
            w[:, 1] = 0.0
        w /= w.sum(axis=1, keepdims=True)
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (sums[2] + 1)
        c = word[0][tokens.word_of]
        add = lambda x: np.add.reduceat(x, tokens.begin)
        cols = [left["i"], pa.array(tokens.count), pa.array(add((c > 0).astype(np.int64)))]
        cols += [pa.array(np.full(left.num_rows, sums[0])), pa.array(add(np.log10((c + 1) / (sums[0] + sums[2] + 1))))]
        return pa.table(cols + [pa.array(add(np.log10(p)))], schema.names)

    asked = texts.groupBy("block").applyInArrow(ask, MESSAGE)
    answers = asked.groupBy("bucket").applyInArrow(answer, MESSAGE)
    cells = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(held_out, "cell long, n long, words long")
    summed = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
    weights = summed.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(weigh, MESSAGE)  # CONTEXT_BUCKETS * 4096 rows at most
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = weights.select("bucket", every.alias("block"), "kind", "n", "a", "b", "c")
    replies = answers.union(sent)
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
