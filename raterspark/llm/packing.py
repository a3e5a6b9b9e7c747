"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every partition packs its own pieces best-fit and emits the
nearly full bins; underfull bins become items, meet in groups of bounded size and are packed
best-fit again, round after round. No task ever holds more than a partition's pieces or
``group_bins`` underfull bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._common import materialize

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:-")] = True


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    Equal lengths keep their order, so the result depends on the items alone. Open bins are
    kept by residual; a bit mask over residuals finds the tightest one that still fits.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fitting = mask >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                mask ^= 1 << left
        else:
            left, at = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = at, fills[at]
        fills[at] += need
        left -= need
        if left:
            open_bins[left].append(at)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


class WordTokenizer:
    """Token ids of texts through a cache of word parts, for a tokenizer that drops white space.

    Valid for tokenizers whose splitting never joins characters across white space, nor a
    letter or digit with a following one of ``.,!?;:-``, and that lower-case A-Z; chunks
    holding ``<|`` (special tokens) are hashed with their case. The cache is bounded.
    """

    LIMIT = 1_000_000
    RECENT = 50_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.recent: dict[int, int] = {}
        self.at, self.count, self.pool = (np.empty(0, t) for t in (np.int64, np.int64, np.uint32))

    def slots(self, keys: np.ndarray, texts: Callable[[np.ndarray], Iterable[bytes]]) -> np.ndarray:
        """Cache slots of ascending keys; parts not met before are encoded and remembered."""
        if len(self.at) + len(keys) > self.LIMIT:
            self.clear()
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        found = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        out = np.empty(len(keys), np.int64)
        out[found] = self.slot[at[found]]
        miss = np.flatnonzero(~found)
        out[miss] = [self.recent.get(k, -1) for k in keys[miss].tolist()]
        new = miss[out[miss] < 0]
        if len(new):
            ids = [self.encode(x.decode("utf-8"), add_special_tokens=False).ids for x in texts(new)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            used = len(self.pool)
            self.pool = np.append(self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())))
            out[new] = np.arange(len(self.at), len(self.at) + len(new))
            self.at = np.append(self.at, used + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.recent.update(zip(keys[new].tolist(), out[new].tolist(), strict=True))
            if len(self.recent) > self.RECENT:
                k = np.append(self.known, np.fromiter(self.recent, np.uint64, len(self.recent)))
                v = np.append(self.slot, np.fromiter(self.recent.values(), np.int64, len(self.recent)))
                order = np.argsort(k, kind="stable")
                self.known, self.slot, self.recent = k[order], v[order], {}
        return out

    def __call__(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the offsets of the texts."""
        n = len(off) - 1
        start, end, row = K.word_spans(raw, off)
        if len(raw) > 1:
            letter = _ALNUM[raw]
            two = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            letter[1:] |= two
            cut = np.flatnonzero(letter[:-1] & _STOP[raw[1:]]) + 1
            cut = cut[~np.isin(cut, off)]
            inside = np.searchsorted(start, cut, "right") - 1
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
            row = np.sort(np.concatenate([row, row[inside]]))
        data = raw.tobytes()
        lower = b"<|" not in data
        keys, first, inverse = np.unique(K.span_hash(raw, start, end, lower), return_index=True, return_inverse=True)
        first_start, first_end = start[first], end[first]

        def texts(which: np.ndarray) -> Iterator[bytes]:
            for s, e in zip(first_start[which].tolist(), first_end[which].tolist(), strict=True):
                yield data[s:e].lower() if lower else data[s:e]

        slot = self.slots(keys, texts)[inverse]
        count = self.count[slot]
        per_text = np.bincount(row, weights=count, minlength=n).astype(np.int64) + 1
        out_off = np.concatenate([[0], np.cumsum(per_text)])
        flat = np.full(out_off[-1], end_id, np.uint32)
        hole = np.ones(len(flat), bool)
        hole[out_off[1:] - 1] = False
        flat[hole] = self.pool[K.ragged(self.at[slot], count)]
        return flat, out_off


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, whose cache serves all its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str, out: str = "n_tokens") -> DataFrame:
    """``docs`` without its text and with the number of the text's token ids (null text: 0)."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path)
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            size = np.empty(b.num_rows, np.int64)
            for i, j in K.chunks(off, 1 << 20):
                _, at = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i], 0)
                size[i:j] = np.diff(at) - 1  # without the end that closes every text
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(size)], schema.names)

    return docs.select(text_col, *[f.name for f in rest]).mapInArrow(run, schema)


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int
) -> DataFrame:
    """Pieces of all documents, packed best-fit within their partition (bin, offset, fill)."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "bin", "offset", "fill")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path)
        ids, cols = [], []
        for b in batches:
            raw, off = K.text_bytes(b.column(1))
            for i, j in K.chunks(off, 1 << 20):
                flat, at = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                size = np.diff(at)
                parts = -(-size // capacity)
                row = np.repeat(np.arange(j - i), parts)
                piece = K.ragged(np.zeros(j - i, np.int64), parts)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                little = flat.astype("<u4", copy=False)
                begin = at[row] + start
                crc = [zlib.crc32(little[s : s + n]) for s, n in zip(begin.tolist(), length.tolist(), strict=True)]
                ids.append(b.column(0).slice(i, j - i).take(pa.array(row)))
                cols.append(np.stack([piece, start, length, np.array(crc, np.int64)]))
        if not cols:
            return
        piece, start, length, crc = np.concatenate(cols, axis=1)
        bins, offset, fills = best_fit(length, capacity)
        first_bin = TaskContext.get().partitionId() << 32
        arrays = [pa.chunked_array(ids).combine_chunks(), pa.array(piece.astype(np.int32))]
        arrays += [pa.array(x) for x in (start, length, crc, bins + first_bin, offset, fills[bins])]
        table = pa.Table.from_arrays(arrays, schema.names)
        yield from table.to_batches(50_000)

    return docs.select(F.col(id_col), F.col(text_col).alias("__t")).mapInArrow(run, schema)


def merge_bins(bins: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """Pack underfull bins (bin, fill) best-fit as items, in ``groups`` groups.

    Returns (bin, to_bin, shift, to_fill): the bin each one goes into and where it begins.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("fill", "descending"), ("bin", "ascending")])
        to, shift, fills = best_fit(group["fill"].to_numpy(), capacity)
        base = (round_no << 56) | (key[0].as_py() << 32)
        return pa.table([group["bin"], pa.array(to + base), pa.array(shift), pa.array(fills[to])], ["bin", "to_bin", "shift", "to_fill"])

    keyed = bins.select(F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(groups)).alias("g"), "bin", "fill")
    return keyed.groupBy("g").applyInArrow(run, "bin long, to_bin long, shift long, to_fill long")


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    nearly_full: float = 0.995,
    group_bins: int = 40_000,
) -> DataFrame:
    """Place every document's tokens into sequences of at most ``capacity`` tokens.

    One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Only texts
    over ``capacity`` tokens are cut. A null or empty text is the end token alone. Rows with
    a null or repeated id are packed like any other; an empty table gives none.

    Bins filled to ``nearly_full`` are emitted by the round that fills them; the others go
    on in groups of at most about ``group_bins`` until one group is left or a round saves
    less than 1 % of them.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    placed = pieces.withColumnsRenamed({"bin": "sequence_id"})
    least = int(nearly_full * capacity)
    bins = pieces.where(F.col("fill") < least).groupBy("bin").agg(F.first("fill").alias("fill"))
    n, round_no = bins.count(), 1
    while n > 1:
        groups = -(-n // group_bins)
        moved = materialize(merge_bins(bins, groups, round_no, capacity), "bins")
        placed = placed.join(moved.withColumnRenamed("bin", "sequence_id"), "sequence_id", "left").select(
            *[c for c in placed.columns if c not in ("sequence_id", "offset")],
            F.coalesce("to_bin", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
        bins = moved.where(F.col("to_fill") < least).select(F.col("to_bin").alias("bin"), F.col("to_fill").alias("fill")).distinct()
        before, n, round_no = n, bins.count(), round_no + 1
        if groups == 1 or n > 0.99 * before:
            break
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
