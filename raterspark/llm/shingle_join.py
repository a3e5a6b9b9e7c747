"""N-gram Jaccard join: prefix filtering on rare-first shingles, verified once per pair.

1. Documents with equal shingle sets form a class with a number; one row per class goes on.
2. Shingles are ordered rare-first by a fixed-size count sketch of the whole corpus. Any
   total order gives exact results; a rarer-first one only gives fewer candidates.
3. The prefixes of all classes are sent, packed, to buckets by shingle. Shingles in one
   prefix only drop out. Round one compares the members of a shingle's group with the
   group's smallest id only, so a group of n near copies gives n pairs, not n^2.
4. Round two compares members whose classes round one left in different components: all
   their pairs under the length, positional and suffix filters. Large groups are split into
   a grid. Pairs already connected need no comparison, so no link between components is lost.
5. Surviving pairs are verified once, on the full sets: round two leaves out what round one
   has asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _kernels as K
from ._blocks import BUCKET_CHARS, by_bucket, group_starts, squeeze, unsqueeze
from ._common import materialize, spread_join, text_volume
from ._graph import connected_components

_U = np.uint64
SKETCH_BITS = 20
SKETCH_PARTS = 32
SIGNATURE = 64
#: Members of a shingle's group that one task of round two compares with each other.
GROUP_ROWS = 4096
#: Cells of the bitmap that spares texts without a candidate pair the way to verification.
FILTER_BITS = 25
#: Shingles of one class's partners that one verification task reads.
VERIFY_SHINGLES = 1 << 17


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle), sorted and distinct: word runs of ``width``, or the whole of a shorter text."""
    start, end, row = K.word_spans(raw, off)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, _U)
    h = K.span_hash(raw, start, end, lower=True)
    full = K.shingle_hash(h, width)
    inside = row[width - 1 :] == row[: len(full)] if len(full) else np.empty(0, bool)
    rows, values = [row[: len(full)][inside]], [full[inside]]
    n_words = K.row_counts(row, len(off) - 1)
    for short in range(1, width):
        first = np.searchsorted(row, np.flatnonzero(n_words == short))
        rows.append(row[first])
        x = np.full(len(first), short, _U)
        for k in range(short):
            x = K.mix(x * _U(0x9E3779B97F4A7C15) + h[first + k])
        values.append(x)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    lead = group_starts(row, value)
    return row[lead], value[lead]


def _sum_parts(df: DataFrame) -> DataFrame:
    """Add up the packed counters (part, group, data) of each part and group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in table["data"])
        data = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pa.table({"part": [key[0].as_py()], "data": [data]}, pa.schema([("part", pa.int64()), ("data", pa.binary())]))

    return df.groupBy("part", "g").applyInArrow(run, "part long, data binary")


def shingle_sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Document frequencies of shingles, summed over 2^SKETCH_BITS cells of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            raw, off = K.text_bytes(b.column(0))
            for i, j in K.chunks(off):
                _, value = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                total += np.bincount((value & _U((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            parts = [x.tobytes() for x in np.split(total, SKETCH_PARTS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_PARTS), pa.int64()), pa.array([task // 256] * SKETCH_PARTS, pa.int64()), pa.array(parts, pa.binary())],
                ["part", "g", "data"],
            )

    parts = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "part long, g long, data binary")
    total = _sum_parts(_sum_parts(parts).withColumn("g", F.lit(0).cast("long")))
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    size = len(sketch) // SKETCH_PARTS
    for r in total.collect():  # SKETCH_PARTS rows, 4 MB in all whatever the corpus
        sketch[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["data"], np.uint32)
    return sketch


def described(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(id, h, n, k1, k2, sign, prefix): text hash, set size and key, suffix signature and probe prefix."""
    sketch = shingle_sketch(docs, text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = K.text_bytes(b.column(1))
            for i, j in K.chunks(off):
                n = j - i
                row, value = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                size = K.row_counts(row, n)
                begin = np.cumsum(size) - size
                keys = set_keys(row, value, n)
                cell = np.bincount(row * SIGNATURE + (value >> _U(58)).astype(np.int64), minlength=n * SIGNATURE)
                sign = np.minimum(cell, 65535).astype(np.uint16).reshape(n, SIGNATURE)
                count = sketch[(value & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.int64)
                value = value[np.argsort((row << 32) + count, kind="stable")]
                prefix = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                cut = np.split(value[K.ragged(begin, prefix)], np.cumsum(prefix)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), b.column(2).slice(i, n), pa.array(size.astype(np.int64))]
                    + [pa.array(k) for k in keys]
                    + [pa.array([x.tobytes() for x in part], pa.binary()) for part in (sign, cut)],
                    ["id", "h", "n", "k1", "k2", "sign", "prefix"],
                )

    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), text_hash(text_col).alias("h"))
    return cols.mapInArrow(run, "id long, h binary, n long, k1 long, k2 long, sign binary, prefix binary")


def text_hash(text_col: str) -> Column:
    """128 bits that tell texts apart (null: the empty text)."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection of sets of sizes a and b that makes a link."""
    return -(-num * (a + b) // (num + den))


_ENTRY = "bucket long, kind int, n long, token binary, id binary, pos binary, size binary"
_ENTRY_NAMES = ["bucket", "kind", "n", "token", "id", "pos", "size"]


def _packed(bucket: int, kind: int, token: np.ndarray, *rest: np.ndarray) -> tuple:
    return (bucket, kind, len(token), token.tobytes(), *(squeeze(x) for x in rest))


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _ENTRY_NAMES)


def prefix_entries(classes: DataFrame, buckets: int) -> DataFrame:
    """Prefixes packed by bucket of their shingles: (token, id, position, size) arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            prefix = [np.frombuffer(x, _U) for x in b.column(2).to_pylist()]
            if not prefix:
                continue
            length = np.array([len(x) for x in prefix])
            token = np.concatenate(prefix)
            pos = K.ragged(np.zeros(len(length), np.int64), length)
            at = np.repeat(np.arange(len(length)), length)
            rows = []
            for bucket, p in by_bucket(K.mix(token) % _U(buckets)):
                rows.append(_packed(bucket, 0, token[p], ids[at[p]], pos[p], sizes[at[p]]))
            yield _entries(rows)

    return classes.select("id", "n", "prefix").mapInArrow(run, _ENTRY)


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    rows = table.select(_ENTRY_NAMES[2:]).to_pylist()
    token = np.concatenate([np.empty(0, _U), *(np.frombuffer(r["token"], _U) for r in rows)])
    none = np.empty(0, np.int64)
    return token, *(np.concatenate([none, *(unsqueeze(r[c], r["n"]) for r in rows)]) for c in _ENTRY_NAMES[4:])


def _compatible(ia, sa, pa_, ib, sb, pb, num: int, den: int) -> np.ndarray:
    """Length, index-prefix and positional filters for pairs met at one shingle."""
    small_a = (sa < sb) | ((sa == sb) & (ia < ib))
    low, high = np.minimum(sa, sb), np.maximum(sa, sb)
    need = least_overlap(sa, sb, num, den)
    pos_low = np.where(small_a, pa_, pb)
    index = low - least_overlap(low, low, num, den)
    return (den * low >= num * high) & (pos_low <= index) & (np.minimum(sa - pa_, sb - pb) >= need)


def round_one(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Kind 1: entries of shingles in two prefixes or more. Kind 2: pairs with the smallest id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        token, ids, pos, size = _unpack(table)
        order = np.lexsort((ids, token))
        token, ids, pos, size = token[order], ids[order], pos[order], size[order]
        lead = group_starts(token)
        count = np.diff(np.append(lead, len(token)))
        lead, count = lead[count > 1], count[count > 1]
        at = K.ragged(lead, count)
        first = np.repeat(lead, count)
        ok = _compatible(ids[first], size[first], pos[first], ids[at], size[at], pos[at], num, den) & (ids[first] != ids[at])
        pairs = np.unique(np.stack([ids[first][ok], ids[at][ok]]), axis=1)
        bucket = key[0].as_py()
        rows = [_packed(bucket, 1, *(x[at] for x in (token, ids, pos, size)))] if len(at) else []
        if pairs.shape[1]:
            rows.append((bucket, 2, pairs.shape[1], None, pairs[0].tobytes(), pairs[1].astype(np.int64).tobytes(), None))
        return pa.Table.from_batches([_entries(rows)])

    return entries.groupBy("bucket").applyInArrow(run, _ENTRY)


def _pair_rows(packed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["x", "y"])

    return packed.select("id", "pos").mapInArrow(run, "x long, y long")


def round_two(entries: DataFrame, components: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of different components that pass the filters at a common shingle.

    A shingle's group of over GROUP_ROWS members is dealt to a grid of tasks, each comparing
    two parts of it.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, ids, pos, size = _unpack(pa.Table.from_batches([b]))
            if len(token):
                lead = group_starts(token)
                count = np.diff(np.append(lead, len(token)))
                grid = np.repeat(-(-count // GROUP_ROWS), count)
                cols = [token.view(np.int64), ids, pos.astype(np.int32), size.astype(np.int32), grid.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "id", "pos", "size", "grid"])

    rows = entries.mapInArrow(unpack, "token long, id long, pos int, size int, grid int")
    known = rows.join(components.withColumnRenamed("node", "id"), "id", "left")
    known = known.withColumn("component", F.coalesce("component", "id"))
    # only shingles whose members lie in different components can give a new link
    split = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    split = split.where("lo <> hi").select("token")
    known = known.join(split, "token", "left_semi")
    part = F.pmod(F.xxhash64("id"), F.col("grid"))
    other = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    dealt = known.withColumn("part", part.cast("int")).select("*", other.alias("other")).select(
        "token", "id", "pos", "size", "component", "part", "grid",
        F.least("part", "other").alias("g"), F.greatest("part", "other").alias("h"),
    )
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("token", "g", "h"), F.lit(buckets)))

    def compare(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("token", "id", "pos", "size", "component", "part", "g", "h")}
        order = np.lexsort((col["part"], col["h"], col["g"], col["token"]))
        col = {c: v[order] for c, v in col.items()}
        lead = group_starts(col["token"], col["g"], col["h"])
        ends = np.append(lead[1:], len(order))
        xs, ys, held = [], [], 0

        def settle() -> None:
            nonlocal held
            u = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)]), axis=1)
            xs[:], ys[:] = [u[0]], [u[1]]
            held = u.shape[1]

        for s, e in zip(lead.tolist(), ends.tolist(), strict=True):
            if col["component"][s] == col["component"][e - 1] and not (col["component"][s:e] != col["component"][s]).any():
                continue
            crossed = col["g"][s] != col["h"][s]
            for i in range(s, e, 512):
                a = np.arange(i, min(i + 512, e))[:, None]
                b = np.arange(i, e)[None, :]
                ok = (a < b) & (col["component"][a] != col["component"][b])
                if crossed:
                    ok &= col["part"][a] != col["part"][b]
                r, c = np.nonzero(ok)
                r, c = r + i, c + i
                sa, sb = col["size"][r].astype(np.int64), col["size"][c].astype(np.int64)
                ok = _compatible(col["id"][r], sa, col["pos"][r], col["id"][c], sb, col["pos"][c], num, den)
                x, y = col["id"][r[ok]], col["id"][c[ok]]
                xs.append(np.minimum(x, y))
                ys.append(np.maximum(x, y))
                held += len(x)
                if held > 2_000_000:
                    settle()
        if xs:
            settle()
        return pa.table({"x": pa.array(xs[0] if xs else [], pa.int64()), "y": pa.array(ys[0] if ys else [], pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(compare, "x long, y long")


def suffix_filter(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y, dx, dy, kx, ky, ny): pairs whose sets can be near enough, with a document and the
    first key of both sets and the size of the second.

    Dropped are pairs that differ too much by their sizes in SIGNATURE ranges of the hash:

    |x - y| + |y - x| is at least the sum of the size differences in disjoint ranges.
    """
    sides = classes.select("id", "n", "sign", "doc", "k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sx, sy = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, SIGNATURE).astype(np.int64) for c in (4, 5))
            a, c = b.column(2).to_numpy(), b.column(3).to_numpy()
            most = a + c - 2 * least_overlap(a, c, num, den)
            capped = (sx == 65535).any(axis=1) | (sy == 65535).any(axis=1)
            yield b.select(["x", "y", "dx", "dy", "kx", "ky", "ny"]).filter(pa.array((np.abs(sx - sy).sum(axis=1) <= most) | capped))

    # pairs grow with the texts: joined the same way at every size, never broadcast
    both = (
        pairs.join(sides.toDF("x", "nx", "gx", "dx", "kx").hint("merge"), "x")
        .join(sides.toDF("y", "ny", "gy", "dy", "ky").hint("merge"), "y")
        .select("x", "y", "nx", "ny", "gx", "gy", "dx", "dy", "kx", "ky")
    )
    return both.mapInArrow(run, "x long, y long, dx long, dy long, kx long, ky long, ny long")


def set_keys(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit keys of each row's set, equal for equal sets (empty sets: 0)."""
    size = K.row_counts(row, n)
    some = size > 0
    keys = np.zeros((2, n), _U)
    for k, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
        if some.any():
            keys[k, some] = np.add.reduceat(K.mix(value ^ _U(salt)), (np.cumsum(size) - size)[some])
    return keys.view(np.int64)


def _marked(wanted: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of the wanted ids: 2^FILTER_BITS bits, whatever their number."""
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(cell, F.lit(64)).cast("int"))
    words = wanted.groupBy(F.shiftright(cell, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bitmap


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """Links (u, v) among the pairs (x, y, dx, dy, kx, ky, ny) of classes, by the full sets of both,
    which are read from the texts of documents dx and dy."""
    pairs = materialize(pairs, "pairs")
    bitmap = _marked(pairs.select(F.col("dx").alias("id")).union(pairs.select(F.col("dy").alias("id"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(2).to_numpy()
            b = b.filter(pa.array((bitmap[cell >> 6] >> (cell & 63)) & 1 == 1))
            raw, off = K.text_bytes(b.column(1))
            for i, j in K.chunks(off):
                row, value = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)
                cut = np.split(value, np.searchsorted(row, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(set_keys(row, value, j - i)[0]), pa.array([x.tobytes() for x in cut], pa.binary())],
                    ["id", "k1", "members"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    texts = texts.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)))
    members = texts.mapInArrow(sets, "id long, k1 long, members binary").dropDuplicates(["id", "k1"])
    members = materialize(members, "sets")
    # partners of a class are read in parts of about VERIFY_SHINGLES, at least one partner
    parts = pairs.groupBy("x", "dx", "kx").agg(F.ceil(F.sum("ny") / VERIFY_SHINGLES).cast("int").alias("parts"))
    left = pairs.join(parts.select("x", "parts"), "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int"))
    left = left.join(members.toDF("dy", "ky", "members").hint("merge"), ["dy", "ky"]).select("x", "part", "y", "members")
    right = parts.join(members.toDF("dx", "kx", "own").hint("merge"), ["dx", "kx"]).select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "own")

    def check(key: tuple, theirs: pa.Table, own: pa.Table) -> pa.Table:
        x = np.frombuffer(own["own"][0].as_py(), _U)
        ys = theirs["y"].to_numpy()
        ok = np.zeros(len(ys), bool)
        for k, m in enumerate(theirs["members"]):
            y = np.frombuffer(m.as_buffer(), _U)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            ok[k] = int((x[at] == y).sum()) * (num + den) >= num * (len(x) + len(y))
        return pa.table([pa.array(ys[ok], pa.int64()), pa.array(np.full(ok.sum(), key[0].as_py()), pa.int64())], ["u", "v"])

    right = right.toDF("own_x", "own_part", "own")
    return left.groupBy("x", "part").cogroup(right.groupBy("own_x", "own_part")).applyInArrow(check, "u long, v long")


_SET = ["k1", "k2", "n"]


def linked_classes(
    docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described rows, classes, links): classes (id, doc, copies, k1, k2, n, sign, prefix) are the
    distinct sets that have shingles, of rows with an id; doc is the smallest of these ids, and
    id a number in the order of doc, so that near copies meet their earliest one in round one;
    links (u, v) are class numbers, enough of them to connect all that link."""
    buckets = max(1, -(-text_volume(docs, text_col) // BUCKET_CHARS))
    rows = materialize(described(docs, id_col, text_col, width, num, den), "described")
    keys = rows.where("id is not null and n > 0").groupBy(*_SET).agg(F.min("id").alias("doc"), F.count("*").alias("copies"))
    keys = keys.repartitionByRange("doc", "k1").sortWithinPartitions("doc", "k1", "k2")
    keys = materialize(keys.withColumn("id", F.monotonically_increasing_id()), "keys")
    one = rows.drop("h").withColumnRenamed("id", "doc").join(keys, ["doc", *_SET]).dropDuplicates(["doc", *_SET])
    classes = materialize(one, "classes")

    def links(pairs: DataFrame) -> DataFrame:
        near = suffix_filter(pairs, classes, num, den)
        return materialize(verified(near, docs, id_col, text_col, width, num, den), "links")

    met = materialize(round_one(prefix_entries(classes, buckets), num, den), "met")
    asked = materialize(_pair_rows(met.where("kind = 2")).distinct(), "asked")
    first = links(asked)
    components = materialize(connected_components(first), "components")
    more = round_two(met.where("kind = 1"), components, buckets, num, den).distinct()
    second = links(more.join(asked, ["x", "y"], "left_anti"))
    return rows, classes, first.union(second)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    A-Z is lower-cased; words are runs without space and control characters 9-13; a set holds
    the distinct runs of ``width`` words, or all words as one run in a shorter text. Two
    documents link when den * |intersection| >= num * |union|. component_id is the smallest
    id reachable by links, the document's own included. Null, empty and wordless texts have
    no shingle and link with nothing; so do rows with a null id (component null). Of rows with
    equal id every distinct set is compared, and what one of them links with, all reach.
    Texts of any length are read whole; extra columns are ignored, whatever their names; an
    empty table gives none.
    """
    rows, classes, links = linked_classes(docs, id_col, text_col, width, num, den)
    # an id with several sets connects their classes
    sets = rows.where("id is not null and n > 0").select("id", F.struct(*_SET).alias("s"))
    several = sets.groupBy("id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("id")
    numbers = classes.select(F.col("id").alias("class"), *_SET)
    member = rows.where("n > 0").join(several, "id", "left_semi").select("id", *_SET).distinct().join(numbers, _SET).select("id", "class")
    member = materialize(member, "several")
    own = spread_join(member, member.groupBy("id").agg(F.min("class").alias("least")), ["id"], "class")
    links = links.union(own.where("class <> least").select(F.col("least").alias("u"), F.col("class").alias("v")))

    components = materialize(connected_components(links), "components").withColumnRenamed("node", "id")
    least = classes.join(components, "id").groupBy("component").agg(F.min("doc").alias("root"))
    roots = components.join(least, "component").select("id", "root")
    # classes held once and linked with nothing need no look-up; of the others any may be hot
    found = classes.join(roots, "id", "left").where("copies > 1 or root is not null").select(*_SET, F.coalesce("root", "doc").alias("root"))
    out = rows.select("id", *_SET).withColumn("deal", F.xxhash64("id", F.spark_partition_id()))
    out = spread_join(out, found, _SET, "deal", "left")
    known = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), known.alias("component_id"))


def one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """One row of ``docs`` for each group of texts that links connect: of its smallest id.

    Rows are told apart by id and text: exact copies under one id are one row of a group, and
    different texts under one id are groups of their own unless they link. Rows without a
    shingle and rows with a null id all stay.
    """
    rows, classes, links = linked_classes(docs, id_col, text_col, width, num, den)
    components = connected_components(links).withColumnRenamed("node", "id")
    group = classes.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = group.groupBy("component").agg(F.min(F.struct("doc", *_SET)).alias("s")).select(F.col("s.doc").alias("id"), "s.k1", "s.k2", "s.n")
    first = rows.join(kept, ["id", *_SET]).groupBy("id", *_SET).agg(F.min("h").alias("h"))
    stay = first.select("id", "h", F.lit(False).alias("all")).union(
        rows.where("id is not null and n = 0").select("id", "h", F.lit(True)).distinct()
    ).toDF("__i", "__h", "__all")
    keyed = docs.withColumns({"__i": F.col(id_col).cast("long"), "__h": text_hash(text_col)})
    # the join leaves the rows of an id and text side by side
    copy = F.row_number().over(Window.partitionBy("__i", "__h").orderBy("__h"))
    met = keyed.join(stay, ["__i", "__h"]).withColumn("__k", copy).where("__all or __k = 1")
    return met.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
