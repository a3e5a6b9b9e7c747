"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are numbered, normalised, quantised to int8 and cut into tiles. Every pair of tiles
meets in one task, where an integer product bounds all cosines of the pair from above. Only
the vectors of pairs whose bound reaches the threshold are fetched in double precision, and
only those pairs are computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, spread_join
from ._graph import connected_components, spanning_forest


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q, scales s and error norms e with |unit - s q| <= e for each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return codes, scale, error


def possible_pairs(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Mask of the pairs whose cosine can reach ``threshold``.

    With x = s q + r and |r| <= e: x.y = s t q.p + x.r' + r.(t p) and |x| = 1, |t p| <= 1 + f,
    so x.y <= s t q.p + f + e (1 + f). The integer products are exact in float32 while
    127 * 127 * dim < 2^24, beyond that they are taken in double precision.
    """
    q, s, e = a
    p, t, f = b
    kind = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64
    product = (q.astype(kind) @ p.astype(kind).T).astype(np.float64)
    bound = product * (s[:, None] * t[None, :]) + f[None, :] + e[:, None] * (1 + f[None, :])
    return bound >= threshold - 1e-9


#: Rows of one tile compared with rows of another at a time.
BLOCK = 1024


def blocks_of(n: int, m: int, same: bool) -> Iterator[tuple[int, int]]:
    """Corners of the blocks of a tile product; of a tile with itself the upper ones."""
    return ((i, j) for i in range(0, n, BLOCK) for j in range(i if same else 0, m, BLOCK))


def masked(a: tuple, b: tuple, i: int, j: int, same: bool, threshold: float) -> np.ndarray:
    may = possible_pairs(tuple(x[i : i + BLOCK] for x in a), tuple(x[j : j + BLOCK] for x in b), threshold)
    return may & np.triu(np.ones(may.shape, bool), 1) if same and i == j else may


def involved(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both tiles that are in a possible pair."""
    in_a, in_b = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
    for i, j in blocks_of(len(in_a), len(in_b), same):
        may = masked(a, b, i, j, same, threshold)
        in_a[i : i + BLOCK] |= may.any(axis=1)
        in_b[j : j + BLOCK] |= may.any(axis=0)
    return in_a, in_b


def tile_links(ids: tuple, unit: tuple, coded: tuple, same: bool, threshold: float) -> tuple[np.ndarray, ...]:
    """Link counts of both tiles' vectors, and a spanning forest of their links (as ids)."""
    (ia, ib), (ua, ub), (ca, cb) = ids, unit, coded
    count_a, count_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j in blocks_of(len(ia), len(ib), same):
        may = masked(ca, cb, i, j, same, threshold)
        rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        exact = ua[i : i + BLOCK][rows] @ ub[j : j + BLOCK][cols].T
        hit = (exact >= threshold) & may[np.ix_(rows, cols)]
        count_a[i + rows] += hit.sum(axis=1)
        count_b[j + cols] += hit.sum(axis=0)
        r, c = np.nonzero(hit)
        u, v = spanning_forest(np.concatenate([u, ia[i + rows[r]]]), np.concatenate([v, ib[j + cols[c]]]))
    return count_a, count_b, u, v


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link and their unit vectors in double precision, by dimension checked."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out_rows, out = [], []
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        m = flat[starts[rows][:, None] + np.arange(dim)]
        big = np.abs(m).max(axis=1)
        ok = np.isfinite(big) & (big > 0) & np.isfinite(m).all(axis=1)
        rows, m = rows[ok], m[ok] / big[ok, None]
        out_rows.append(rows)
        out.append((dim, m / np.linalg.norm(m, axis=1, keepdims=True)))
    return out_rows, out


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def coded_tiles(numbered: DataFrame, tiles: int) -> DataFrame:
    """(dim, tile, n, rows, codes, scale, error): linkable vectors of each tile, quantised."""
    schema = "dim int, tile long, n long, rows binary, codes binary, scale binary, error binary"
    names = ["dim", "tile", "n", "rows", "codes", "scale", "error"]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        number = group["row"].to_numpy()
        out = []
        for at, (dim, unit) in zip(*_vectors(_column(group, "v")), strict=True):
            order = np.argsort(number[at], kind="stable")
            codes, scale, error = quantise(unit[order])
            out.append((dim, key[0].as_py(), len(at), number[at][order].tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes()))
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    keyed = numbered.where("id is not null").withColumn("tile", _tile(tiles))
    return keyed.groupBy("tile").applyInArrow(run, schema)


def _tile(tiles: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(tiles))


def possible_rows(coded: DataFrame, tiles: int, threshold: float) -> DataFrame:
    """(dim, a, b, row): rows of tiles a and b that are in a possible pair of the two."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        by_tile, (dim, a, b) = {}, (k.as_py() for k in key)
        for r in group.to_pylist():
            rows = np.frombuffer(r["rows"], np.int64)
            codes = np.frombuffer(r["codes"], np.int8).reshape(len(rows), dim)
            by_tile[r["tile"]] = (rows, (codes, np.frombuffer(r["scale"]), np.frombuffer(r["error"])))
        found = np.empty(0, np.int64)
        if a in by_tile and b in by_tile:
            (ra, ca), (rb, cb) = by_tile[a], by_tile[b]
            in_a, in_b = involved(ca, cb, a == b, threshold)
            found = ra[in_a | in_b] if a == b else np.concatenate([ra[in_a], rb[in_b]])
        same = lambda x, t: pa.array(np.full(len(found), x), t)
        return pa.table([same(dim, pa.int32()), same(a, pa.int64()), same(b, pa.int64()), pa.array(found)], ["dim", "a", "b", "row"])

    others = coded.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("other"), "*")
    sent = others.select("dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "rows", "codes", "scale", "error")
    return sent.groupBy("dim", "a", "b").applyInArrow(run, "dim int, a long, b long, row long")


def exact_links(possible: DataFrame, numbered: DataFrame, tiles: int, threshold: float) -> DataFrame:
    """(u, v, links, edge) by row: links of a row within two tiles, and spanning edges."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        dim, a, b = (k.as_py() for k in key)
        number, tile = group["row"].to_numpy(), group["tile"].to_numpy()
        order = np.lexsort((number, tile))
        group, number, tile = group.take(pa.array(order)), number[order], tile[order]
        (_, unit), = (x for x in _vectors(_column(group, "v"))[1])
        mine, theirs = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        coded = quantise(unit)
        sides = [tuple(x[w] for x in coded) for w in (mine, theirs)]
        ca, cb, u, v = tile_links((number[mine], number[theirs]), (unit[mine], unit[theirs]), sides, a == b, threshold)
        hit_a, hit_b = ca > 0, cb > 0
        n = int(hit_a.sum() + hit_b.sum())
        cols = [
            np.concatenate([number[mine][hit_a], number[theirs][hit_b], u]),
            np.concatenate([np.full(n, -1), v]),
            np.concatenate([ca[hit_a], cb[hit_b], np.zeros(len(u), np.int64)]),
        ]
        return pa.table([*[pa.array(c, pa.int64()) for c in cols], pa.array(np.arange(n + len(u)) >= n)], ["u", "v", "links", "edge"])

    fetched = possible.join(numbered.select("row", "v").withColumn("tile", _tile(tiles)), "row")
    return fetched.groupBy("dim", "a", "b").applyInArrow(run, "u long, v long, links long, edge boolean")


def linked_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tile_rows: int = 4096,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Links join vectors with cosine >= ``threshold`` (in double precision); vectors of
    different dimension never link. Vectors that are null, empty, zero or hold null, NaN or
    infinite components link with nothing, as do rows with a null id (component null, kept
    true). Rows of equal id are vectors of their own, each with its links; an id's component
    is that of all its rows. Other columns are not read, whatever their names; vectors of any
    length are read whole; an empty table gives none.

    Each of the about N / ``tile_rows`` tiles is sent as int8 codes to every tile it meets; a
    task holds two tiles and a block of products. Of the pairs of tiles, only vectors in a
    possible pair travel in double precision. A group in which all pairs link costs its
    products, but only counts and a spanning forest leave the task.
    """
    numbered = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    numbered = materialize(numbered.withColumn("row", F.monotonically_increasing_id()), "vectors")
    tiles = max(1, -(-numbered.count() // tile_rows))
    coded = materialize(coded_tiles(numbered, tiles), "tiles")
    possible = materialize(possible_rows(coded, tiles, threshold), "possible")
    found = materialize(exact_links(possible, numbered, tiles, threshold), "links")
    counts = found.where("not edge").groupBy("u").agg(F.sum("links").alias("links"))
    ids = numbered.select("row", "id")
    edges = found.where("edge").select("u", "v").join(ids.toDF("u", "iu"), "u").join(ids.toDF("v", "iv"), "v")
    components = connected_components(edges.select(F.col("iu").alias("u"), F.col("iv").alias("v")))

    out = ids.join(counts.withColumnRenamed("u", "row"), "row", "left")
    out = spread_join(out, components.withColumnRenamed("node", "id"), ["id"], "row", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )
