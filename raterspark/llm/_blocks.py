"""Blocks of documents that exchange packed keys through buckets.

A *block* is the documents whose id and text hash to it (some megabytes of text), so rows that
share an id, or have none, spread over the blocks. Blocks send
their distinct keys, packed as binary columns, to *buckets* (a hash of the key); a bucket
sees each key once per block that has it, however hot the key, and answers the blocks. Both
counts grow with the text, so the size of either does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_volume

BLOCK_CHARS = 8_000_000
BUCKET_CHARS = 12_000_000

#: What travels between blocks and buckets: kind tells the reader how to read a, b, c.
MESSAGE = "bucket long, block long, kind int, n long, a binary, b binary, c binary"
_NAMES = ["bucket", "block", "kind", "n", "a", "b", "c"]
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def sizes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Numbers of blocks and buckets for the text of ``docs``."""
    chars = text_volume(docs, text_col)
    return max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // BUCKET_CHARS))


def block_of(id_col: str, text_col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks))


def messages(rows: list[tuple]) -> pa.Table:
    """Message table of (bucket, block, kind, n, a, b, c) tuples."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def squeeze(x: np.ndarray) -> bytes:
    """Array of 64-bit integers that hardly change from one to the next, compressed."""
    step = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return pa.compress(step.tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True) if n else b""
    return np.cumsum(np.frombuffer(raw, np.int64))


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices in their order) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys in arrays sorted by them."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
