"""Vectorised text kernels that run inside Spark tasks on Arrow string columns.

A task sees its texts as one byte buffer plus offsets. The kernels work on *chunks* of
whole documents (about ``CHUNK_BYTES`` each), so memory follows the chunk and the longest
single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

#: Space and the control characters 9-13 separate words; every other byte is in a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Byte -> byte with A-Z lower-cased and every other byte kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE_LOWER = _BYTE_VALUE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of whole documents of about ``limit`` bytes, at least one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j
    pa.default_memory_pool().release_unused()  # a worker lives on: give back what the batch held


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(
    raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that are no separators; runs never cross rows."""
    if not len(raw):
        z = np.empty(0, np.int64)
        return z, z, z
    word = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    n = len(raw)
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            grown = np.full(size, base, _U)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    total = np.zeros(n + 1, _U)
    np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[raw] * _powers[0][:n], out=total[1:])
    return mix((total[end] - total[start]) * _powers[1][start])


def shingle_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (array shorter by width - 1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    h = np.zeros(n, _U)
    for k in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + words[k : k + n]
        h ^= h >> _U(32)
    return mix(h)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    """How often each of the rows 0..n-1 occurs."""
    return np.bincount(rows, minlength=n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def merge_spans(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of half-open spans per row; touching spans become one."""
    if not len(rows):
        return rows, start, end
    order = np.lexsort((start, rows))
    rows, start, end = rows[order], start[order], end[order]
    shift = int(end.max()) + 2
    key = rows.astype(np.int64) * shift
    reach = np.maximum.accumulate(key + end)
    first = np.ones(len(rows), bool)
    first[1:] = (key + start)[1:] > reach[:-1]
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(rows)) - 1
    return rows[begin], start[begin], reach[last] - key[begin]
