"""Record linkage: fuzzy (edit-distance) join, name conformance, overrides, waterfall.

The fuzzy join is exact. It works on distinct keys: their signatures are joined, candidates
are verified with ``levenshtein``, and the pairs are joined back to the rows, so repeated keys
are compared once. Keys are never truncated. Nothing runs while the plan is built, and the
plan does not depend on sizes; Spark's adaptive execution chooses broadcasts. Signature rows
carry a 64-bit key id, never the key text; rows are told apart by SHA-256 of their key.

Pairs whose shorter key has at least ``_least_anchored`` characters share anchors (after
ED-Join; Xiao, Wang, Lin, PVLDB 2008): substrings taken by their hash, wherever they stand.
Each side emits its first anchors, in the order of their hashes, up to k+1 that no two edits
can share: k edits leave one of them, and of two keys the one whose anchors end earlier has
one left that the other emits too. So a key gives some tens of rows whatever its length. An
anchor that many keys hold (boilerplate) is left out; keys that then have too few (thin keys)
meet the others by all they have, and each other by anchors taken from all their substrings,
shared ones last.

Shorter pairs use partition-based signatures (Li, Deng, Wang, Feng, "Pass-Join", PVLDB 2011).
Each key on the segmented side is cut into k+1 segments; a key within k edits contains one of
them unchanged, with at most i edits before segment i and at most k-i after it, so only shifts
within both bounds are probed. The probe side emits the hashes of exactly those substrings, the
join is an equi-join on (length, segment, hash). Keys shorter than k+1 cannot be segmented;
they meet keys of at most twice that length by length bucket (``strategy='band'`` does that
for all keys: for short keys only, as each bucket is compared whole).

A segment that many keys share gives many candidates and no information. Keys
with such a segment are cut into 2(k+1) segments instead and stand under the k+1 of them that
the fewest keys share: k edits break at most k of these, so the guarantee is the same, and
of the kept segments one is still intact with at most as many edits before it as kept
segments, and the rest after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterspark.sources.io import materialize


def _keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct non-NULL keys with a 64-bit id (a hash above 31 bits of length) and the length.

    The keys are dealt by id, so joins on it do not move the texts again. Texts are aggregate
    outputs and the id is never NULL, so filters and join constraints stay above the distinct
    step and never drag the key expression (for example text folding) into the scan filter,
    and every use of the keys reads the same exchange. Signature rows carry the id, never the
    key text, so a long key is not copied into each of its signature rows. Two keys sharing an
    id only add candidates, which the verification removes.
    """
    k = F.col(key)
    key_id = F.shiftleft(F.xxhash64(k), 31).bitwiseOR(F.coalesce(F.length(k), F.lit(0)).cast("long"))
    found = df.select(key_id.alias(f"{name}_id"), k.alias(name)).groupBy(f"{name}_id").agg(F.collect_set(name).alias(name))
    found = found.select(F.explode(name).alias(name), f"{name}_id")
    return found.withColumn(f"{name}_len", F.length(name))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Columns worked out once: as exploded values they are not copied into what uses them."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


#: Pieces for each of the k edits that a pair's texts are compared by before their distance.
PIECES_FOR_ONE = 8


def _missing_pieces(k: int) -> Column:
    """How many pieces of the left key are not in the right one within k edits' reach of their
    place. An edit changes one piece at most, so more than k missing ones mean more edits."""
    a, b = F.col("_lk").cast("binary"), F.col("_rk").cast("binary")
    pieces = F.least(F.lit(PIECES_FOR_ONE * (k + 1)), F.floor(F.octet_length("_lk") / (4 * APART)).cast("int"))
    each = F.floor(F.octet_length("_lk") / F.greatest(pieces, F.lit(1))).cast("int")
    reach = F.lit(4 * k)  # an edit moves what follows by a character, of at most four bytes

    def missing(j: Column) -> Column:
        piece = F.substring(a, j * each + 1, each - APART)
        return ~F.contains(F.substring(b, F.greatest(j * each + 1 - reach, F.lit(1)), each + 2 * reach), piece)

    numbers = F.when(pieces > 0, F.sequence(F.lit(0), pieces - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(numbers, missing))


def _common(a: str, b: str, cut: Callable[[Column, Column], Column]) -> Column:
    """Characters that two texts share at the end that ``cut`` takes, by halving."""
    most = F.least(F.length(a), F.length(b))
    begin = F.struct(F.lit(0).alias("least"), most.alias("most"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["least"] + acc["most"]) / 2).cast("int")
        same = cut(F.col(a), mid) == cut(F.col(b), mid)
        return F.struct(F.when(same, mid).otherwise(acc["least"]).alias("least"), F.when(same, acc["most"]).otherwise(mid - 1).alias("most"))

    turns = F.sequence(F.lit(1), F.ceil(F.log2(most + 2)).cast("int") + 1)
    return F.aggregate(turns, begin, lambda acc, i: F.when(acc["least"] == acc["most"], acc).otherwise(halve(acc, i)))["least"]


def _verify(pairs: DataFrame, lk: DataFrame, rk: DataFrame, k: int) -> DataFrame:
    """(left key, right key, distance) of the candidate ids that are within ``k`` edits.

    ``levenshtein`` takes time with the square of the length, so pairs that miss too many
    pieces are left out before, and it gets what stands between the common ends.
    """
    found = pairs.join(lk.select("_lk", "_lk_id"), "_lk_id").join(rk.select("_rk", "_rk_id"), "_rk_id")
    found = found.select("_lk", "_rk").where(_missing_pieces(k) <= k)
    found = found.withColumn("_n", _common("_lk", "_rk", lambda t, n: F.substring(t, F.lit(1), n)))
    rest = {c: F.substring(F.col(f"_{c}k"), F.col("_n") + 1, F.length(f"_{c}k")) for c in "lr"}
    found = found.withColumns({f"_{c}": x for c, x in rest.items()})
    found = found.withColumn("_n", _common("_l", "_r", lambda t, n: F.substring(t, -n, n)))
    mid = [F.substring(F.col(c), F.lit(1), F.length(c) - F.col("_n")) for c in ("_l", "_r")]
    return _once(found, _dist=F.levenshtein(*mid, k)).select("_lk", "_rk", "_dist").where(F.col("_dist") >= 0)


def _band_pairs(lk: DataFrame, rk: DataFrame, k: int) -> DataFrame:
    w = k + 1
    lb = lk.withColumn("_b", F.floor(F.col("_lk_len") / w))
    rb = rk.withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_rk_len") / w) - 1, F.floor(F.col("_rk_len") / w) + 1))
    )
    j = lb.join(rb, "_b").where(F.abs(F.col("_lk_len") - F.col("_rk_len")) <= k)
    return j.select("_lk_id", "_rk_id")


def _with_bytes(keys: DataFrame, key: str, klen: str) -> DataFrame:
    """Add the key's bytes and an ASCII flag once per key (before any explosion)."""
    return keys.withColumn("_kb", F.col(key).cast("binary")).withColumn(
        "_ascii", F.octet_length(F.col(key)) == F.col(klen)
    )


def _piece_hash(key: str, start0: Column, length: Column) -> Column:
    """xxhash64 of ``key[start0 : start0 + length]`` (character positions) and the segment ``_i``.

    For an ASCII key, characters and bytes coincide and the piece is cut from the bytes
    (constant-time offset); otherwise from the string (the offset walks the UTF-8
    bytes). The hash of a string equals the hash of its bytes, so both paths agree.
    """
    pos = (start0 + 1).cast("int")
    ln = length.cast("int")
    i = F.col("_i").cast("int")
    return F.when(
        F.col("_ascii"), F.xxhash64(F.substring(F.col("_kb"), pos, ln), i)
    ).otherwise(F.xxhash64(F.substring(F.col(key), pos, ln), i))


def _signature(piece: Column) -> Column:
    """What a signature row is joined on: hash of a piece and the segmented key's length."""
    return F.xxhash64(piece, F.col("_slen").cast("int")).bitwiseAND(F.lit(2**SIGNATURE_BITS - 1)).alias("_sig")


#: Bits of a signature. Probe rows are most of what the join shuffles, so a signature is one
#: number of six bytes; two that agree by chance only add a candidate for the verification.
SIGNATURE_BITS = 48
#: Keys that may share a segment before it counts as boilerplate.
HOT_SEGMENT = 64


def _segments(keys: DataFrame, key: str, klen: str, n: int) -> DataFrame:
    """(key id, signature, piece hash) for each of ``n`` segments of every key."""
    base = F.floor(F.col(klen) / n)
    rem = F.col(klen) % n
    i = F.col("_i")
    seg_len = base + F.when(i >= F.lit(n) - rem, 1).otherwise(0)
    start = i * base + F.greatest(F.lit(0), i - (F.lit(n) - rem))
    seg = _with_bytes(keys, key, klen).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    seg = seg.withColumn("_slen", F.col(klen)).withColumn("_piece", _piece_hash(key, start, seg_len))
    return seg.select(f"{key}_id", _signature(F.col("_piece")), "_piece")


def _probe_substrings(keys: DataFrame, key: str, klen: str, k: int, n: int, lengths: DataFrame | None = None) -> DataFrame:
    """(key id, signature) of every substring of a probe key that can equal one of the ``n``
    segments of a key of length ``_slen`` within k edits (position-aware window). ``lengths``
    (_slen) names the lengths that occur, if the others are not to be probed."""
    rows = keys.withColumn("_slen", F.explode(F.sequence(F.greatest(F.col(klen) - k, F.lit(n)), F.col(klen) + k)))
    rows = rows.where(F.col("_slen") >= n)
    if lengths is not None:
        rows = rows.join(lengths, "_slen")
    rows = _with_bytes(rows, key, klen).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    base = F.floor(F.col("_slen") / n)
    rem = F.col("_slen") % n
    i = F.col("_i")
    rows = rows.withColumn("_seg_len", base + F.when(i >= F.lit(n) - rem, 1).otherwise(0))
    rows = rows.withColumn("_start", i * base + F.greatest(F.lit(0), i - (F.lit(n) - rem)))
    delta = F.col(klen) - F.col("_slen")
    # of the k + 1 segments kept, segment i is number least .. most; at most as many edits
    # as its number stand before it, and the rest of the k after it
    least, most = F.greatest(F.lit(0), i - F.lit(n - k - 1)), F.least(i, F.lit(k))
    lo = F.greatest(-most, delta - (F.lit(k) - least))
    hi = F.least(most, delta + (F.lit(k) - least))
    rows = rows.where(lo <= hi).withColumn("_d", F.explode(F.sequence(lo, hi)))
    q = F.col("_start") + F.col("_d")
    rows = rows.where((q >= 0) & (q + F.col("_seg_len") <= F.col(klen)))
    return rows.select(f"{key}_id", _signature(_piece_hash(key, q, F.col("_seg_len"))))


def _rarest(sig: DataFrame, key_id: str, keep: int) -> DataFrame:
    """Each key's ``keep`` signatures whose pieces the fewest keys share, of any length."""
    shared = sig.join(sig.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")), "_piece")
    by_key = Window.partitionBy(key_id).orderBy("_n", "_sig")  # 2(k+1) rows
    return shared.withColumn("_k", F.row_number().over(by_key)).where(F.col("_k") <= keep).select(*sig.columns)


def _candidates(segmented: DataFrame, seg_key: str, probes: DataFrame, probe_key: str, k: int) -> DataFrame:
    """Distinct (segmented id, probe id) pairs that share a signature."""
    n, seg_id, seg_len = k + 1, f"{seg_key}_id", f"{seg_key}_len"
    sig = _segments(segmented, seg_key, seg_len, n)
    # A shared opening counts over all lengths: each length alone may have few of its keys.
    hot = sig.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_SEGMENT).select("_piece")
    long_enough = F.col(seg_id).bitwiseAND(F.lit(2**31 - 1)) >= 2 * n  # the id holds the length
    hot_keys = sig.join(hot, "_piece", "left_semi").where(long_enough).select(seg_id).distinct()
    cold = sig.join(hot_keys, seg_id, "left_anti")
    deep = segmented.join(hot_keys, seg_id, "left_semi")
    rare = _rarest(_segments(deep, seg_key, seg_len, 2 * n), seg_id, n)
    # Without hot segments there are no lengths, and the second probes are never made.
    lengths = deep.select(F.col(seg_len).alias("_slen")).distinct()
    found = None
    for signatures, sub in (
        (cold, _probe_substrings(probes, probe_key, f"{probe_key}_len", k, n)),
        (rare, _probe_substrings(probes, probe_key, f"{probe_key}_len", k, 2 * n, lengths)),
    ):
        met = signatures.join(sub, "_sig").select(seg_id, f"{probe_key}_id")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def _segment_pairs(lk: DataFrame, rk: DataFrame, k: int, probe: str) -> DataFrame:
    n = k + 1
    if probe == "right":
        seg_side, seg_key, probe_side, probe_key = lk, "_lk", rk, "_rk"
    else:
        seg_side, seg_key, probe_side, probe_key = rk, "_rk", lk, "_lk"
    long_seg = seg_side.where(F.col(f"{seg_key}_len") >= n)
    short_seg = seg_side.where(F.col(f"{seg_key}_len") < n)
    # The probe side is small in bytes but each key fans out to many substring rows: a
    # fixed partition number keeps AQE from coalescing the keys before the explosion.
    slots = int(probe_side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probe_spread = probe_side.repartition(slots, f"{probe_key}_id")
    cand = _candidates(long_seg, seg_key, probe_spread, probe_key, k).select("_lk_id", "_rk_id")
    # Short keys: every key within k edits is at most 2k long, so the band join only
    # sees short probe keys.
    short_probe = probe_side.where(F.col(f"{probe_key}_len") < 2 * n)
    if probe == "right":
        short = _band_pairs(short_seg, short_probe, k)
    else:
        short = _band_pairs(short_probe, short_seg, k)
    return cand.unionByName(short)


#: Bytes of the shortest anchors. Longer keys have longer ones, up to eight times that.
ANCHOR_BYTES = 8
#: Anchors by hash for each of the k+1 that a key needs, at least; a key has up to twice as many.
ANCHORS_FOR_ONE = 3
#: Two substrings that start so many bytes and their length apart share no character.
APART = 3
#: Bits of an anchor's hash; the bits above are its rank among shared ones.
ANCHOR_BITS = 48


def _least_anchored(k: int) -> int:
    """Characters from which a key holds k+1 anchors that no two edits share."""
    return (k + 1) * (ANCHOR_BYTES + APART)


def _classed(keys: DataFrame, key: str, k: int) -> DataFrame:
    """(id, bytes, class) of the keys that are long enough; each class is twice as long as the
    one before. A pair meets in the class of its shorter key, so a key that is up to k longer
    than its class begins stands in the one before as well."""
    least = F.lit(_least_anchored(k))
    of = lambda n: F.floor(F.log2(F.greatest(n, least) / least)).cast("int")
    n = F.col(f"{key}_len")
    long = keys.where(n >= least).select(F.col(f"{key}_id").alias("_id"), F.col(key).cast("binary").alias("_kb"), n.alias("_n"))
    return long.withColumn("_c", F.explode(F.sequence(of(F.col("_n") - k), of(F.col("_n"))))).drop("_n")


def _class_bytes() -> Column:
    """Bytes of a class's anchors: a sixteenth to a fiftieth of its keys, so that edits can be
    told apart, and enough for few keys to share one."""
    doubled = F.least(F.greatest(F.col("_c") - 1, F.lit(0)), F.lit(3))
    return F.call_function("shiftleft", F.lit(ANCHOR_BYTES), doubled)


def _hash_limit(k: int, each: int) -> Column:
    """The hash below which a class's shortest keys have ``each * (k + 1)`` anchors."""
    share = F.lit(each * (k + 1) / _least_anchored(k)) / F.pow(F.lit(2.0), F.col("_c"))
    return (F.least(share, F.lit(1.0)) * F.lit(float(2**ANCHOR_BITS))).cast("long")


def _anchors(classed: DataFrame, limit: Column, *carry: str) -> DataFrame:
    """(id, hash, place) of the substrings whose hash is below the limit, and for each key and
    class a row of hash and place -1."""
    rows = classed.withColumn("_q", _class_bytes()).withColumn("_limit", limit)
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(-1), F.octet_length("_kb") - F.col("_q"))))
    h = F.xxhash64(F.substring(F.col("_kb"), F.col("_at") + 1, F.col("_q")), F.col("_c")).bitwiseAND(F.lit(2**ANCHOR_BITS - 1))
    rows = rows.withColumn("_h", F.when(F.col("_at") < 0, F.lit(-1).cast("long")).otherwise(h))
    return rows.where(F.col("_h") < F.col("_limit")).select("_id", "_h", "_at", *carry)


def _shared_anchors(sides: Sequence[DataFrame], limit: Column) -> DataFrame:
    """Each key's anchors that over HOT_SEGMENT keys hold, and those that very many do."""
    rows = None
    for classed in sides:
        own = _anchors(classed, limit).where(F.col("_h") >= 0).select("_id", "_h")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy("_h"))).where(F.col("_held") > HOT_SEGMENT)
    very = F.when(F.col("_held") > HOT_SEGMENT**2, F.col("_h"))
    return rows.groupBy("_id").agg(F.collect_set("_h").alias("_shared"), F.collect_set(very).alias("_very"))


def _first_anchors(classed: DataFrame, shared: DataFrame, k: int, limit: Column, drop_shared: bool) -> DataFrame:
    """For each key and class (id, class, anchors in order). They end with the one that makes
    k+1 which no two edits share; all of a key that has too few (thin) stay, with a -1."""
    none = F.array().cast("array<long>")
    rows = classed.join(shared, "_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("_shared", "_very")}).withColumn("_key", F.monotonically_increasing_id())
    rows = _anchors(rows, limit, "_key", "_c", "_shared", "_very")
    if drop_shared:
        rows = rows.where(~F.array_contains("_shared", F.col("_h")))
        rank = F.col("_h")
    else:
        held = F.array_contains("_shared", F.col("_h")).cast("long") + F.array_contains("_very", F.col("_h")).cast("long")
        rank = F.when(F.col("_h") < 0, F.col("_h")).otherwise(F.shiftleft(held, ANCHOR_BITS).bitwiseOR(F.col("_h")))
    rows = rows.select("_id", "_key", "_c", F.struct(rank.alias("_rank"), "_at").alias("_a"))
    keyed = rows.groupBy("_id", "_key", "_c").agg(F.sort_array(F.collect_list("_a")).alias("_all"))

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc["taken"], lambda t: F.abs(t - x["_at"]) < F.col("_q") + APART)
        more = F.struct(F.array_append(acc["taken"], x["_at"]).alias("taken"), x["_rank"].alias("last"))
        return F.when((F.size(acc["taken"]) > k) | (x["_at"] < 0) | near, acc).otherwise(more)

    begin = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(-1).cast("long").alias("last"))
    keyed = _once(keyed.withColumn("_q", _class_bytes()), _some=F.aggregate(F.slice("_all", 1, 32 * (k + 1)), begin, step))
    enough = lambda c: F.size(F.col(c)["taken"]) > k
    keyed = _once(keyed, _got=F.when(enough("_some"), F.col("_some")).otherwise(F.aggregate("_all", begin, step)))
    ends = F.filter("_all", lambda x: (x["_rank"] >= 0) & (x["_rank"] <= F.col("_got")["last"]))
    keyed = _once(keyed, _first=F.when(enough("_got"), ends).otherwise(F.col("_all")))
    return keyed.select("_id", "_c", "_first")


def _meet(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(left id, right id) of keys that hold one of their anchors at about the same place."""

    def held(firsts: DataFrame, side: str) -> DataFrame:
        rows = firsts.select(F.col("_id").alias(f"_{side}k_id"), F.explode("_first").alias("_a")).where(F.col("_a._rank") >= 0)
        h = F.col("_a._rank").bitwiseAND(F.lit(2**ANCHOR_BITS - 1)).alias("_h")
        return rows.groupBy(f"_{side}k_id", h).agg(F.min("_a._at").alias(f"_{side}from"), F.max("_a._at").alias(f"_{side}to"))

    length = lambda c: F.col(c).bitwiseAND(F.lit(2**31 - 1))
    bytes_off = 4 * k  # an edit moves what follows by a character, of at most four bytes
    near = (F.col("_lfrom") <= F.col("_rto") + bytes_off) & (F.col("_rfrom") <= F.col("_lto") + bytes_off)
    met = held(left, "l").join(held(right, "r"), "_h").where(near & (F.abs(length("_lk_id") - length("_rk_id")) <= k))
    return met.select("_lk_id", "_rk_id")


def _anchor_pairs(lk: DataFrame, rk: DataFrame, k: int) -> DataFrame:
    """Candidate ids of the pairs whose shorter key has ``_least_anchored`` characters."""
    sides = [_classed(lk, "_lk", k), _classed(rk, "_rk", k)]
    limit = _hash_limit(k, ANCHORS_FOR_ONE)
    shared = _shared_anchors(sides, limit)
    # dealt by id once: what the keys emit and which of them are thin come from the same rows
    firsts = [_first_anchors(c, shared, k, limit, drop_shared=True).repartition("_id") for c in sides]
    thin = []
    for classed, first in zip(sides, firsts):
        # compared as a whole, so that no filter and no part of it goes below the exchange
        few = first.select("_id", "_c", F.explode("_first").alias("_a")).where(F.col("_a") < F.struct(F.lit(0).cast("long"), F.lit(0)))
        few = few.groupBy("_id").agg(F.collect_set("_c").alias("_thin"))
        thin.append(classed.join(few, "_id").where(F.array_contains("_thin", F.col("_c"))).drop("_thin"))
    shared = _shared_anchors(thin, _hash_limit(k, 8 * ANCHORS_FOR_ONE))
    every = F.lit(2**ANCHOR_BITS)
    rest = [_first_anchors(c, shared, k, every, drop_shared=False) for c in thin]
    return _meet(*firsts, k).unionByName(_meet(*rest, k))


def fuzzy_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, max_dist: int,
    strategy: str = "segments", probe: str = "right",
) -> DataFrame:
    """Distinct (left key, right key, distance) pairs within ``max_dist`` edits.

    ``probe`` names the side whose short keys emit substring hashes, of the order of (k+1)^3
    rows per key: name the side with fewer. The other side emits k+1 segment hashes per key.
    """
    lk = _keys(left, left_key, "_lk")
    rk = _keys(right, right_key, "_rk")
    if strategy == "band":
        pairs = _band_pairs(lk, rk, max_dist)
    elif strategy == "segments":
        short = [x.where(F.col(f"{name}_len") < _least_anchored(max_dist) + max_dist) for x, name in ((lk, "_lk"), (rk, "_rk"))]
        pairs = _anchor_pairs(lk, rk, max_dist).unionByName(_segment_pairs(*short, max_dist, probe))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _verify(pairs.distinct(), lk, rk, max_dist)


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    max_dist: int,
    how: str = "left",
    distance_col: str = "dist",
    fan_out: str = "all",
    strategy: str = "segments",
    probe: str = "right",
    max_ratio: float | None = None,
) -> DataFrame:
    """Left (or inner) join on edit distance ``<= max_dist`` keeping the distance.

    ``max_ratio`` additionally requires ``dist <= max_ratio * max(len a, len b)``, so
    short keys cannot match almost anything (the absolute threshold alone allows it).

    ``fan_out='all'`` keeps every match (a left row may appear several times);
    ``'best'`` keeps the closest right key per left key (ties: smallest right key).
    Left rows with a NULL key or no match keep NULL right columns under ``how='left'``.
    """
    pairs = fuzzy_pairs(left, right, left_key, right_key, max_dist, strategy, probe)
    if max_ratio is not None:
        longest = F.greatest(F.length("_lk"), F.length("_rk"))
        pairs = pairs.where(F.col("_dist") <= F.lit(max_ratio) * longest)
    if fan_out == "best":
        pairs = pairs.groupBy("_lk").agg(
            F.min(F.struct("_dist", "_rk")).alias("_m")
        ).select("_lk", F.col("_m._rk").alias("_rk"), F.col("_m._dist").alias("_dist"))
    pairs = pairs.select(_key_hash("_lk").alias("_lh"), _key_hash("_rk").alias("_rh"), F.col("_dist").alias(distance_col))
    l_ = left.withColumn("_lrow", _key_hash(left_key)).join(pairs, F.col("_lrow") == F.col("_lh"), how)
    r_ = right.withColumn("_rrow", _key_hash(right_key))
    out = l_.join(r_, F.col("_rrow") == F.col("_rh"), "left" if how == "left" else "inner")
    return out.drop("_lh", "_rh", "_lrow", "_rrow")


def _key_hash(key: str) -> Column:
    """SHA-256 of a key, by which rows and pairs meet without moving the texts. A NULL key has
    the empty string, which is no key's, so it matches nothing, and Catalyst has no
    ``isnotnull(key)`` to infer and push (with the whole key expression) into the scan."""
    return F.coalesce(F.sha2(F.col(key).cast("binary"), 256), F.lit(""))


def fuzzy_semi(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, max_dist: int,
    strategy: str = "segments", probe: str = "right",
) -> DataFrame:
    """Rows of ``left`` whose key is within ``max_dist`` edits of some right key."""
    pairs = fuzzy_pairs(left, right, left_key, right_key, max_dist, strategy, probe)
    hit = pairs.select(_key_hash("_lk").alias("_lh")).distinct()
    return left.withColumn("_lrow", _key_hash(left_key)).join(hit, F.col("_lrow") == F.col("_lh"), "left_semi").drop("_lrow")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Replace ``value`` by the override for matching keys (left join + coalesce).

    ``overrides`` has columns (key, value) and must be unique on key.
    """
    o = overrides.select(F.col(key), F.col(value).alias("_ov"))
    return df.join(o, key, "left").withColumn(value, F.coalesce("_ov", value)).drop("_ov")


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Exact-value recode with a literal map; other values pass through."""
    if not mapping:
        return col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[col], col)


# Escapes whose letters are no text of the match; any other letter or digit after a
# backslash (\x41, \p{L}, \Q, back references ...) makes a pattern's literals unsure.
_CLASS_ESCAPE = "dDsSwWbBAzZnrtfhHvVR"
_UNSURE = rf"\\[A-Za-z0-9&&[^{_CLASS_ESCAPE}]]|\(\?[a-wyz]*x"


def required_literals(pattern: Column | str) -> Column:
    """Runs of ASCII letters and digits (lower-cased) that every match of a Java regular
    expression holds; an empty array where that cannot be told.

    Escapes, classes, groups and optional characters are cut out; a pattern with an
    alternation outside groups, or with anything left that is not understood, has none.
    """
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    cut = F.regexp_replace(p, r"(?s)\\.", "\u0001")
    cut = F.regexp_replace(cut, r"\[[^\[\]]*\]", "\u0001")
    for _ in range(4):  # groups in groups
        cut = F.regexp_replace(cut, r"\([^()]*\)", "\u0001")
    cut = F.regexp_replace(cut, r"(?s).(?:[?*]|\{[^{}]*\})[?+]?", "\u0001")
    unsure = p.rlike(_UNSURE) | cut.rlike(r"[\[\](){}|]")
    runs = F.regexp_extract_all(F.lower(cut), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(~unsure, runs).otherwise(F.array().cast("array<string>"))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given sizes."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        found = F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


#: Length of the pieces of a literal that patterns are filed under.
GRAM = 3


def pattern_matches(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(name, pattern columns) of all patterns that match a name, without a nested loop.

    Each pattern is filed under one piece (up to GRAM characters) of a literal that its
    matches must hold: the piece that the fewest patterns share, a longer one first. Names
    fetch the patterns filed under their own pieces by an equi-join, and only those are
    matched. Patterns without a sure literal are filed under the empty piece, which every
    name has.
    """
    pieces = F.flatten(F.transform(
        required_literals(pattern), lambda t: F.when(F.length(t) <= GRAM, F.array(t)).otherwise(_grams(t, [GRAM]))
    ))
    row = F.struct(*[F.col(c) for c in patterns.columns])
    wanted = patterns.select(row.alias("_row"), F.explode(F.when(F.size(pieces) > 0, F.array_distinct(pieces)).otherwise(F.array(F.lit("")))).alias("_piece"))
    shared = wanted.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_piece")))
    filed = shared.groupBy("_row").agg(F.min(F.struct("_n", -F.length("_piece"), "_piece")).alias("_r"))
    filed = filed.select(F.col("_r._piece").alias("_piece"), "_row.*")
    own = F.array_append(_grams(F.lower(F.col(name)), range(1, GRAM + 1)), F.lit(""))
    named = names.select(name, F.explode(own).alias("_piece"))
    return named.join(filed, "_piece").where(F.regexp_like(F.col(name), F.col(pattern))).drop("_piece")


def conform_names(
    df: DataFrame,
    name_col: str,
    dim: DataFrame,
    dim_name: str,
    dim_code: str,
    patterns: DataFrame | None = None,
    pattern_col: str = "pattern",
    fixes: Mapping[str, str] | None = None,
    drop_values: Sequence[str] = (),
    code_col: str = "code",
    keep_unmatched: bool = False,
) -> DataFrame:
    """Map free-text names to codes.

    Steps: trim; fix spellings with ``fixes`` (exact, literal map); exact match against
    ``dim`` on lower-case names; for names still unmatched, the first (smallest code)
    regular expression in ``patterns`` (columns ``dim_code``, ``pattern_col``) that
    matches. The regex step runs on the distinct unmatched names only, never on rows, and
    only on the patterns that :func:`pattern_matches` fetches for a name.
    Rows whose cleaned name is in ``drop_values`` and rows without a code are dropped
    (``keep_unmatched`` keeps the latter with a NULL code).
    """
    clean = recode(F.regexp_replace(F.col(name_col), r"^\s+|\s+$", ""), fixes or {})
    rows = df.withColumn("_name", clean)
    if drop_values:
        rows = rows.where(~F.coalesce(F.col("_name").isin(list(drop_values)), F.lit(False)))
    names = rows.select("_name").where(F.col("_name").isNotNull()).distinct()
    d = dim.select(F.lower(F.col(dim_name)).alias("_lname"), F.col(dim_code).alias("_dcode"))
    d = d.groupBy("_lname").agg(F.min("_dcode").alias("_dcode"))
    named = names.join(d, F.lower(F.col("_name")) == F.col("_lname"), "left").select("_name", "_dcode")
    found = named.where(F.col("_dcode").isNotNull())
    if patterns is not None:
        unmatched = named.where(F.col("_dcode").isNull()).select("_name")
        p = patterns.select(F.col(dim_code).alias("_pcode"), F.col(pattern_col).alias("_pat")).where("_pat is not null")
        by_regex = pattern_matches(unmatched, "_name", p, "_pat").select("_name", F.col("_pcode").alias("_dcode"))
        found = found.unionByName(by_regex)
    exact = found.groupBy("_name").agg(F.min("_dcode").alias("_dcode"))
    out = rows.join(exact, "_name", "left").withColumnRenamed("_dcode", code_col)
    if not keep_unmatched:
        out = out.where(F.col(code_col).isNotNull())
    return out.drop("_name")


def waterfall(
    base: DataFrame,
    key: Sequence[str] | str,
    value: str,
    sources: Sequence[tuple[str, DataFrame]],
    unknown: Sequence[str] = ("Unknown",),
    out_col: str = "value_final",
    source_col: str = "resolved_by",
    drop_unresolved: bool = True,
) -> DataFrame:
    """Fill an attribute through an ordered list of fallback sources.

    ``base`` has ``key`` and ``value``; each source is (name, DataFrame with the key
    columns and ``value``). A source is consulted only for rows still unknown (NULL or
    in ``unknown``). Sources are left-joined, so a source with several rows per key
    fans out (as the original did). Rows still unknown at the end are dropped unless
    ``drop_unresolved=False``.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def is_unknown(c: Column) -> Column:
        return c.isNull() | F.coalesce(c.isin(list(unknown)), F.lit(False))

    cur = base.withColumn(out_col, F.col(value)).withColumn(
        source_col, F.when(~is_unknown(F.col(value)), F.lit("base"))
    )
    for i, (name, src) in enumerate(sources):
        s = src.select(*keys, F.col(value).alias(f"_s{i}"))
        cur = cur.join(s, keys, "left")
        take = is_unknown(F.col(out_col)) & ~is_unknown(F.col(f"_s{i}"))
        cur = cur.withColumn(source_col, F.when(take, F.lit(name)).otherwise(F.col(source_col)))
        cur = cur.withColumn(out_col, F.when(take, F.col(f"_s{i}")).otherwise(F.col(out_col))).drop(f"_s{i}")
    if drop_unresolved:
        cur = cur.where(~is_unknown(F.col(out_col)))
    return cur


def staged_waterfall(
    base: DataFrame,
    key: str,
    value: str,
    steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]],
    unknown: Sequence[str] = ("Unknown",),
    out_col: str = "value_final",
    source_col: str = "resolved_by",
    drop_unresolved: bool = True,
) -> DataFrame:
    """:func:`waterfall` whose steps see only what is still unresolved.

    A step is (name, function): the function gets the unresolved rows and returns (key,
    value) rows for them, several for a key if it finds several (the rows fan out). Each
    step's outcome is written, so a dear step (a fuzzy join) works on the residue of the ones
    before it and runs once. A NULL key is found by no step.
    """

    def is_unknown(c: Column) -> Column:
        return c.isNull() | F.coalesce(c.isin(list(unknown)), F.lit(False))

    first = base.withColumn(out_col, F.col(value)).withColumn(source_col, F.lit("base"))
    done = first.where(~is_unknown(F.col(out_col)))
    rest = first.where(is_unknown(F.col(out_col)))
    for name, find in steps:
        found = find(rest.select(*base.columns)).select(F.col(key).alias("_key"), F.col(value).alias("_found"))
        stepped = rest.drop(out_col).join(found, rest[key] == F.col("_key"), "left").drop("_key")
        stepped = materialize(stepped.withColumnRenamed("_found", out_col).withColumn(source_col, F.lit(name)), "waterfall")
        done = done.unionByName(stepped.where(~is_unknown(F.col(out_col))))
        rest = stepped.where(is_unknown(F.col(out_col)))
    left = rest.withColumn(out_col, F.lit(None).cast(base.schema[value].dataType)).withColumn(source_col, F.lit(None).cast("string"))
    return done if drop_unresolved else done.unionByName(left)


def unresolved(base: DataFrame, resolved: DataFrame, key: str, restrict_to: DataFrame | None = None) -> DataFrame:
    """Rows of ``base`` whose key is absent from ``resolved`` (and present in
    ``restrict_to`` when given): the export of items left for manual coding."""
    out = base.join(resolved.select(key).distinct(), key, "left_anti")
    if restrict_to is not None:
        out = out.join(restrict_to.select(key).distinct(), key, "left_semi")
    return out


def unique_dimension(dim: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Make a dimension unique on ``key`` before joining it (first row in ``order``),
    instead of joining and then deleting known duplicate rows."""
    rest = [c for c in dim.columns if c != key]
    first = dim.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r")
    )
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
