"""Removal of byte strings that already occurred earlier in the corpus.

Prefix doubling on a sparse set of positions. Names of the 1, 2, 4, ... 64 byte strings at
every position are formed inside a task from pairs of names of half the length. Every
100-byte string is represented by one of its inner positions, the one whose 32-byte name is
smallest (a *seed*); equal strings have equal seeds at equal offsets. Spark then sorts the
ranks at growing lengths:

1. the 32-byte names at the seeds: seeds whose name is unique in the corpus drop out;
2. the (32-byte name, whole stretch) pairs, a stretch being all bytes of all 100-byte
   strings that a seed represents: of equal stretches only the earliest goes on, the others
   are removed whole;
3. the 100-byte names, past the threshold, of the few strings whose seed is shared by
   different stretches: all but the earliest of equal strings are removed.

No step keeps a row per byte, and a key that occurs anywhere in a block is sent once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._blocks import MESSAGE, block_of, by_bucket, group_starts, messages, sizes, squeeze, unsqueeze

SEED_BYTES = 32
_U = np.uint64
_MULTIPLIERS = [int(x) | 1 for x in np.random.default_rng(77).integers(1, 1 << 63, 8, dtype=np.uint64)]
_POSITION = _U((1 << 26) - 1)


def names(raw: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Names of all strings of 1, 2, 4, ... ``top`` bytes: a name pairs two of half the length."""
    out, size, k = {1: K._BYTE_VALUE[raw]}, 1, 0
    while size < top:
        x = out[size]
        y = x[:-size] * _U(_MULTIPLIERS[k])
        y += x[size:]
        y ^= y >> _U(29)
        y *= _U(0xBF58476D1CE4E5B9)
        size, k = 2 * size, k + 1
        out[size] = y
    return out


def name_at(ladder: dict[int, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` bytes at some positions, from two overlapping names."""
    half = 1 << (length.bit_length() - 1)
    x = ladder[half]
    return K.mix(x[at] * _U(_MULTIPLIERS[7]) + x[at + (length - half)])


def seeds(raw: np.ndarray, off: np.ndarray, length: int) -> tuple:
    """Seeds of a chunk: (ladder, row, seed, first, last): a seed represents the strings of
    ``length`` bytes that begin at first..last (positions in the chunk)."""
    n = len(raw)
    empty = np.empty(0, np.int64)
    if n < length:
        return {}, empty, empty, empty, empty
    ladder = names(raw, 1 << (length.bit_length() - 1))
    value = ladder[SEED_BYTES] & ~_POSITION
    value |= np.arange(len(value), dtype=_U) & _POSITION
    window, size = length - SEED_BYTES + 1, 1
    least = value
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    seed = (least & _POSITION).astype(np.int64)
    at = np.arange(len(seed))
    if n > int(_POSITION):  # a chunk of one very long text: positions are kept modulo 2^26
        seed += at & ~np.int64(_POSITION)
        seed[seed < at] += int(_POSITION) + 1
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    valid = np.flatnonzero(at + length <= off[row + 1])
    if not len(valid):
        return ladder, empty, empty, empty, empty
    begin = group_starts(seed[valid], row[valid])
    first, last = valid[begin], valid[np.append(begin[1:], len(valid)) - 1]
    return ladder, row[first], seed[first], first, last


class Block:
    """The seeds of a block's documents in order of (id, position), and its texts."""

    def __init__(self, table: pa.Table, length: int, seeds_too: bool = True):
        ids = table["i"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        if len(set(ids)) < len(ids):  # rows of equal id: in the order of their texts
            texts = table["t"].to_pylist()
            order.sort(key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] or ""))
        table = table.take(pa.array(order, pa.int64()))
        self.ids, self.carried = table["i"], [table[c] for c in table.column_names if c.startswith("carried_")]
        self.key = np.array([-(1 << 63) if ids[k] is None else ids[k] for k in order], np.int64)
        self.raw, self.off = K.text_bytes(table["t"])
        self.length = length
        if seeds_too:
            self._find()

    def _find(self) -> None:
        parts = []
        for i, j in K.chunks(self.off, 1 << 17):
            lo = self.off[i]
            raw, off = self.raw[lo : self.off[j]], self.off[i : j + 1] - lo
            ladder, row, seed, first, last = seeds(raw, off, self.length)
            if not len(row):
                continue
            a = K.mix(ladder[SEED_BYTES][seed])
            ends = name_at(ladder, np.stack([first, last]), self.length)
            shape = ((seed - first) << 8 | (last - first)).astype(_U)
            b = K.mix(ends[0] * _U(_MULTIPLIERS[6]) + ends[1] + K.mix(shape)) | _U(1)
            parts.append((a, b, row + i, first + lo, last + lo))
        none = np.empty(0, np.int64)
        self.a, self.b, self.row, self.first, self.last = (
            (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none.astype(_U), none.astype(_U), none, none, none)
        )
        order = np.lexsort((self.b, self.a))  # stable: equal stretches stay in order of position
        a, b = self.a[order], self.b[order]
        lead = group_starts(a, b)
        one_a = group_starts(a[lead])
        kinds = np.diff(np.append(one_a, len(lead)))
        self.mixed = np.sort(order[lead[np.repeat(kinds > 1, kinds)]])  # seeds shared in the block
        self.single = np.sort(order[lead[one_a[kinds == 1]]])
        self.marker = np.sort(order[lead[one_a[kinds > 1]]])
        copies = np.ones(len(a), bool)
        copies[lead] = False
        self.copies = order[copies]

    def sent(self, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, seeds, whether a marker) of what the block asks the buckets."""
        ask = np.concatenate([self.single, self.marker])
        marker = np.arange(len(ask)) >= len(self.single)
        return [(k, ask[p], marker[p]) for k, p in by_bucket((self.a[ask] >> _U(32)) % _U(buckets))]

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of all strings that some seeds (ascending) represent."""
        out_at, out_name = [np.empty(0, np.int64)], [np.empty(0, _U)]
        for i, j in K.chunks(self.off, 1 << 17):
            mine = which[np.searchsorted(self.row[which], i) : np.searchsorted(self.row[which], j)]
            if len(mine):
                lo = self.off[i]
                at = K.ragged(self.first[mine], self.last[mine] - self.first[mine] + 1)
                ladder = names(self.raw[lo : self.off[j]], 1 << (self.length.bit_length() - 1))
                out_at.append(at)
                out_name.append(name_at(ladder, at - lo, self.length))
        return np.concatenate(out_at), np.concatenate(out_name)


def removed_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    keep_text: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and on request
    kept_text and the columns ``carry`` of the input.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller id,
    or in the same text before. Strings are judged on the input and never cross texts. Null
    and empty texts have no bytes; a null id comes before all others, rows of equal id in one
    fixed order (of the block that their text hashes to, then of the texts). ``kept_text`` is
    the remaining bytes as text, a character cut apart by a removal being dropped. Texts of any
    length are read whole; other columns are ignored; an empty table gives none.
    """
    blocks, buckets = sizes(docs, text_col)
    texts = docs.select(
        block_of(id_col, text_col, blocks).alias("block"), F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"),
        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)],
    )

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block, me = Block(table, length), key[0].as_py()
        rows = []
        for bucket, s, marker in block.sent(buckets):
            b = np.where(marker, _U(0), block.b[s])
            rows.append((bucket, me, 0, len(s), block.a[s].astype(np.uint32).tobytes(), b.tobytes(), squeeze(block.key[block.row[s]])))
        return messages(rows)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        if not rows:
            return messages([])
        n = [r["n"] for r in rows]
        a = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in rows])
        b = np.concatenate([np.frombuffer(r["b"], _U) for r in rows])
        doc = np.concatenate([unsqueeze(r["c"], r["n"]) for r in rows])
        order = np.lexsort((doc, b, a))
        a, b = a[order], b[order]
        lead = group_starts(a, b)
        one_a = group_starts(a[lead])
        kinds = np.diff(np.append(one_a, len(lead)))
        has_marker = b[lead[one_a]] == 0
        shared = np.repeat((kinds > 1) | has_marker, kinds)  # by (a, b) group
        code = np.ones(len(a), np.uint8)  # an earlier equal stretch exists
        code[lead] = np.where(shared, 2, 0)  # the earliest one: its strings are compared next, or unique
        code[b == 0] = 0
        out = np.empty(len(a), np.uint8)
        out[order] = code
        return messages(
            [
                (r["bucket"], r["block"], 1, r["n"], pa.compress(x.tobytes(), "zstd", asbytes=True), None, None)
                for r, x in zip(rows, np.split(out, np.cumsum(n)[:-1]), strict=True)
            ]
        )

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        block, me = Block(left, length), key[0].as_py()
        codes = {r["bucket"]: np.frombuffer(pa.decompress(r["a"], r["n"], "zstd", asbytes=True), np.uint8) for r in right.to_pylist()}
        gone, open_ = [block.copies], [block.mixed]
        for bucket, s, _ in block.sent(buckets):
            gone.append(s[codes[bucket] == 1])
            open_.append(s[codes[bucket] == 2])
        gone = np.concatenate(gone)
        at, name = block.strings(np.sort(np.concatenate(open_)))
        order = np.argsort(name, kind="stable")
        lead = np.zeros(len(at), bool)
        lead[order[group_starts(name[order])]] = True
        start = np.concatenate([block.first[gone], at[~lead]])
        end = np.concatenate([block.last[gone], at[~lead]]) + length
        _, start, end = K.merge_spans(np.zeros(len(start), np.int64), start, end)
        rows = [(me % buckets, me, 2, len(start), squeeze(start), squeeze(end), None)]
        at, name = at[lead], name[lead]
        doc = block.key[np.searchsorted(block.off, at, "right") - 1]
        for bucket, p in by_bucket((name >> _U(32)) % _U(buckets)):
            rows.append((bucket, me, 3, len(p), name[p].tobytes(), squeeze(doc[p]), squeeze(at[p])))
        return messages(rows)

    def resolve(table: pa.Table) -> pa.Table:
        given = table.sort_by("block").to_pylist()  # rows of equal id in the same order as before
        rows = [r for r in given if r["kind"] == 3]
        out = [tuple(r.values()) for r in given if r["kind"] == 2]
        if rows:
            name = np.concatenate([np.frombuffer(r["a"], _U) for r in rows])
            doc = np.concatenate([unsqueeze(r["b"], r["n"]) for r in rows])
            order = np.lexsort((doc, name))
            later = np.ones(len(name), bool)
            later[order[group_starts(name[order])]] = False
            for r, x in zip(rows, np.split(later, np.cumsum([r["n"] for r in rows])[:-1]), strict=True):
                if x.any():
                    at = unsqueeze(r["c"], r["n"])[x]
                    _, start, end = K.merge_spans(np.zeros(len(at), np.int64), at, at + length)
                    out.append((r["bucket"], r["block"], 2, len(start), squeeze(start), squeeze(end), None))
        return messages(out)

    schema = T.StructType(
        [T.StructField(id_col, T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType())]
        + [T.StructField("kept_text", T.StringType())] * keep_text
        + [docs.schema[c] for c in carry]
    )

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, length, seeds_too=False)
        spans = [(unsqueeze(r["a"], r["n"]), unsqueeze(r["b"], r["n"])) for r in right.to_pylist()]
        start = np.concatenate([np.empty(0, np.int64), *(s for s, _ in spans)])
        end = np.concatenate([np.empty(0, np.int64), *(e for _, e in spans)])
        # spans were merged over the whole block: cut them again at the texts they touch
        row = np.searchsorted(block.off, start, "right") - 1
        upto = np.searchsorted(block.off, end, "left") - 1
        count = upto - row + 1
        each = K.ragged(row, count)
        start = np.maximum(np.repeat(start, count), block.off[each])
        end = np.minimum(np.repeat(end, count), block.off[each + 1])
        some = end > start
        row, start, end = K.merge_spans(each[some], start[some], end[some])
        n = len(block.key)
        cuts = np.searchsorted(row, np.arange(n + 1))
        data = memoryview(np.ascontiguousarray(block.raw))
        sha, kept = [], []
        for k in range(n):
            h, at, parts = hashlib.sha256(), int(block.off[k]), []
            for s, e in zip(start[cuts[k] : cuts[k + 1]].tolist(), end[cuts[k] : cuts[k + 1]].tolist(), strict=True):
                parts.append(data[at:s])
                at = e
            parts.append(data[at : int(block.off[k + 1])])
            for p in parts:
                h.update(p)
            sha.append(h.hexdigest())
            if keep_text:
                kept.append(b"".join(parts).decode("utf-8", "ignore"))
        cols = [block.ids, pa.array(np.diff(block.off)), pa.array(np.bincount(row, weights=end - start, minlength=n).astype(np.int64))]
        cols += [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(sha, pa.string())]
        return pa.table(cols + [pa.array(kept, pa.string())] * keep_text + block.carried, schema.names)

    asked = texts.groupBy("block").applyInArrow(ask, MESSAGE)
    codes = asked.groupBy("bucket").applyInArrow(answer, MESSAGE)
    compared = texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(compare, MESSAGE)
    spans = compared.groupBy("bucket").applyInArrow(resolve, MESSAGE)
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)
