import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tools.plan_report import executed_nodes

from raterspark.operators import linkage as lk


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _mutate(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        op = rnd.choice("ids")
        pos = rnd.randrange(len(s) + 1)
        if op == "i":
            s.insert(pos, rnd.choice("abcxyz "))
        elif s and pos < len(s):
            if op == "d":
                del s[pos]
            else:
                s[pos] = rnd.choice("abcxyz ")
    return "".join(s)


def _fixture(rnd, n_right=15, n_left=80, k=3):
    right = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 40))) for _ in range(n_right)]
    left = []
    for _ in range(n_left):
        if rnd.random() < 0.6:
            left.append(_mutate(rnd, rnd.choice(right), rnd.randint(0, k + 2)))
        else:
            left.append("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40))))
    left += [None, right[0]]
    return left, right


@pytest.mark.parametrize("strategy", ["band", "segments"])
@pytest.mark.parametrize("k", [1, 3])
def test_fuzzy_pairs_equal_brute_force(spark, strategy, k):
    rnd = random.Random(k * 10 + len(strategy))
    left, right = _fixture(rnd, k=k)
    ldf = spark.createDataFrame([(i, s) for i, s in enumerate(left)], "lid int, lkey string")
    rdf = spark.createDataFrame([(i, s) for i, s in enumerate(right)], "rid int, rkey string")
    got = rows(lk.fuzzy_pairs(ldf, rdf, "lkey", "rkey", k, strategy=strategy), "_lk", "_rk", "_dist")
    want = sorted({(a, b, _lev(a, b)) for a in left if a is not None for b in right if _lev(a, b) <= k})
    assert got == want


def test_fuzzy_probe_left_equals_right(spark):
    rnd = random.Random(99)
    left, right = _fixture(rnd, k=2)
    ldf = spark.createDataFrame([(s,) for s in left], "lkey string")
    rdf = spark.createDataFrame([(s,) for s in right], "rkey string")
    a = rows(lk.fuzzy_pairs(ldf, rdf, "lkey", "rkey", 2, strategy="segments", probe="right"))
    b = rows(lk.fuzzy_pairs(ldf, rdf, "lkey", "rkey", 2, strategy="segments", probe="left"))
    assert a == b


def test_fuzzy_wide_window_boilerplate_keys(spark):
    # Many keys share long openings, so the same signatures are shared by most of them.
    rnd = random.Random(5)
    right = ["licensed under the same terms " * 2 + "".join(rnd.choice("ab ") for _ in range(12)) for _ in range(25)]
    left = [_mutate(rnd, rnd.choice(right), rnd.randint(0, 9)) for _ in range(60)]
    ldf = spark.createDataFrame([(s,) for s in left], "lkey string")
    rdf = spark.createDataFrame([(s,) for s in right], "rkey string")
    want = sorted({(a, b, _lev(a, b)) for a in left for b in right if _lev(a, b) <= 6})
    for probe in ("left", "right"):
        assert rows(lk.fuzzy_pairs(ldf, rdf, "lkey", "rkey", 6, probe=probe), "_lk", "_rk", "_dist") == want


def test_fuzzy_join_threshold_null_and_fan_out(spark):
    base = "a" * 20
    left = spark.createDataFrame(
        [(1, base + "b" * 15), (2, base + "b" * 16), (3, None), (4, "zzzz")], "id int, k string"
    )
    right = spark.createDataFrame([(10, base), (11, "zzzy"), (12, "zzzx")], "rid int, rk string")
    out = rows(lk.fuzzy_join(left, right, "k", "rk", 15), "id", "rid", "dist")
    assert (1, 10, 15) in out           # distance 15 kept
    assert (2, None, None) in out       # 16 dropped -> unmatched
    assert (3, None, None) in out       # NULL key unmatched
    assert [r for r in out if r[0] == 4] == [(4, 11, 1), (4, 12, 1)]  # fan-out of 2
    best = rows(lk.fuzzy_join(left, right, "k", "rk", 15, fan_out="best"), "id", "rid")
    assert [r for r in best if r[0] == 4] == [(4, 12)]  # tie on distance: smallest key "zzzx"


def test_conform_names(spark):
    df = spark.createDataFrame(
        [(1, " France "), (2, "Frnace"), (3, "french republic"), (4, "Atlantis"), (5, "Kosovo"), (6, None)],
        "id int, name string",
    )
    dim = spark.createDataFrame([("France", "FRA"), ("Spain", "ESP")], "name string, code string")
    pats = spark.createDataFrame([("FRA", "(?i)^fren.*"), ("ESP", "(?i)^spa.*")], "code string, pattern string")
    out = lk.conform_names(df, "name", dim, "name", "code", pats, fixes={"Frnace": "France"}, drop_values=["Kosovo"],
                           code_col="iso")
    assert rows(out, "id", "iso") == [(1, "FRA"), (2, "FRA"), (3, "FRA")]
    keep = lk.conform_names(df, "name", dim, "name", "code", pats, drop_values=["Kosovo"], code_col="iso",
                            keep_unmatched=True)
    assert rows(keep, "id", "iso") == [(1, "FRA"), (2, None), (3, "FRA"), (4, None), (6, None)]


def test_waterfall_order_and_drop(spark):
    base = spark.createDataFrame([(1, "X"), (2, "Unknown"), (3, "Unknown"), (4, None)], "id int, v string")
    s1 = spark.createDataFrame([(2, "A"), (3, "Unknown"), (1, "Z")], "id int, v string")
    s2 = spark.createDataFrame([(3, "B"), (2, "C")], "id int, v string")
    out = rows(lk.waterfall(base, "id", "v", [("s1", s1), ("s2", s2)]), "id", "value_final", "resolved_by")
    assert out == [(1, "X", "base"), (2, "A", "s1"), (3, "B", "s2")]


def test_apply_overrides(spark):
    dim = spark.createDataFrame([("VEN", "Lower"), ("FRA", "High")], "code string, grp string")
    ov = spark.createDataFrame([("VEN", "Upper")], "code string, grp string")
    assert rows(lk.apply_overrides(dim, ov, "code", "grp")) == [("FRA", "High"), ("VEN", "Upper")]


def test_unique_dimension(spark):
    dim = spark.createDataFrame([("FRA", "Europe", 2), ("FRA", "Seven seas", 1), ("ESP", "Europe", 1)],
                                "iso string, continent string, rank int")
    out = rows(lk.unique_dimension(dim, "iso", ["rank"]), "iso", "continent")
    assert out == [("ESP", "Europe"), ("FRA", "Seven seas")]


def test_fuzzy_max_ratio(spark):
    left = spark.createDataFrame([(1, "ab"), (2, "abcdefghij")], "id int, k string")
    right = spark.createDataFrame([(9, "xy"), (8, "abcdefghix")], "rid int, rk string")
    out = rows(lk.fuzzy_join(left, right, "k", "rk", 15, max_ratio=0.5), "id", "rid")
    assert out == [(1, None), (2, 8)]


@pytest.mark.parametrize("strategy", ["band", "segments"])
def test_fuzzy_pairs_non_ascii_equal_brute_force(spark, strategy):
    rnd = random.Random(77)
    alphabet = "aéßxø "
    right = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 30))) for _ in range(12)]
    left = [_mutate(rnd, rnd.choice(right), rnd.randint(0, 4)) for _ in range(40)] + ["abc", right[1]]
    ldf = spark.createDataFrame([(s,) for s in left], "lkey string")
    rdf = spark.createDataFrame([(s,) for s in right], "rkey string")
    got = rows(lk.fuzzy_pairs(ldf, rdf, "lkey", "rkey", 2, strategy=strategy), "_lk", "_rk", "_dist")
    want = sorted({(a, b, _lev(a, b)) for a in left for b in right if _lev(a, b) <= 2})
    assert got == want


@pytest.mark.parametrize("strategy", ["band", "segments"])
def test_null_key_never_matches_empty_key(spark, strategy):
    left = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "id int, k string")
    right = spark.createDataFrame([(10, ""), (11, "abc")], "rid int, rk string")
    semi = sorted(r.id for r in lk.fuzzy_semi(left, right, "k", "rk", 1, strategy=strategy).collect())
    assert semi == [2, 3]
    best = rows(lk.fuzzy_join(left, right, "k", "rk", 1, fan_out="best", strategy=strategy), "id", "rid")
    assert best == [(1, None), (2, 10), (3, 11)]


PATTERNS = [
    "(?i)^nation[ _-]*3$", "^abc", "a?bc", "(ab|cd)e", "x|yz", "a{0,3}bc", "ab+c", r"\bfoo\b", r"\x41bc", r"a\.b", "[abc]de", "[a-z&&[^b]]q",
    "", ".", "(?x) a b # note", "((a)b)c*d", "Zürich", "(?i)ÉTÉ", "colou?r", "^(?!no)yes", "abcd{2}", "ab*?c", "e(?:f|g)?h", r"1\d+2", "[]x]",
    "north.*korea", "(?i)korea", r"\Qa.b\E", "a|", r"\p{Lu}ab",
]
NAMES = [
    "nation 3", "NATION_3", "nation13", "abc", "xabc", "bc", "abe", "cde", "x", "yz", "aaabc", "abbc", "a foo b", "Abc", "ABC", "a.b", "axb", "ade", "aq", "",
    "abcd", "bcd", "Zürich", "été", "ÉTÉ", "colour", "color", "yes", "no yes", "abcdd", "ac", "eh", "efh", "1992", "12", "North Korea", "northkorea", "Kab", "\u212aorea",
]


def test_required_literals_are_in_every_match(spark):
    import re

    df = spark.createDataFrame([(p,) for p in PATTERNS], "p string")
    found = {r.p: r.l for r in df.select("p", lk.required_literals("p").alias("l")).collect()}
    assert found["(?i)^nation[ _-]*3$"] == ["nation", "3"] and found["north.*korea"] == ["north", "korea"]
    for unsure in ("x|yz", r"\x41bc", "(?x) a b # note", r"\Qa.b\E", "[a-z&&[^b]]q", r"\p{Lu}ab"):
        assert found[unsure] == [], unsure
    assert found["abcd{2}"] == ["abc"] and found["a?bc"] == ["bc"] and found["ab+c"] == ["ab", "c"] and found["ab*?c"] == ["a", "c"]
    assert re.search(found["colou?r"][0], "color")


def test_pattern_matches_equals_the_nested_loop(spark):
    ok = [p for p in PATTERNS if p != "[]x]"]
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    patterns = spark.createDataFrame(list(enumerate(ok)), "code int, pat string")
    got = lk.pattern_matches(names, "name", patterns, "pat")
    want = names.join(patterns, F.expr("name RLIKE pat"))
    assert rows(got, "name", "code") == rows(want, "name", "code")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lk.pattern_matches(names, "name", patterns.limit(0), "pat").count() == 0


@pytest.mark.parametrize("probe", ["right", "left"])
def test_fuzzy_keys_with_a_shared_opening(spark, monkeypatch, probe):
    """A third of the keys share an opening: the pairs stay exact, and the candidates stay in
    proportion to the keys instead of growing with the square of the group."""
    monkeypatch.setattr(lk, "HOT_SEGMENT", 8)
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    opening = word(60)
    sides = [[(opening if i % 3 == 0 else word(60)) + word(60 + i % 4) for i in range(n)] for n in (240, 90)]
    for i in range(0, 90, 6):  # near copies across the sides, edits in the opening as well
        s = list(sides[1][i])
        for _ in range(rnd.randint(0, 4)):
            s[rnd.randrange(len(s))] = rnd.choice(["", "x", "yz"])
        sides[0][i * 2] = "".join(s)
    sides[0] += ["ab", "", opening, "abcdefghij"]
    sides[1] += ["abc", "", opening[:-2], "abcdefghij"]
    left = spark.createDataFrame([(s,) for s in sides[0]], "l string")
    right = spark.createDataFrame([(s,) for s in sides[1]], "r string")
    got = {(r._lk, r._rk): r._dist for r in lk.fuzzy_pairs(left, right, "l", "r", 4, probe=probe).collect()}
    want = {(a, b): d for a in set(sides[0]) for b in set(sides[1]) if abs(len(a) - len(b)) <= 4 and (d := _lev(a, b)) <= 4}
    assert got == want
    seg, pr = ("_lk", "_rk") if probe == "right" else ("_rk", "_lk")
    keys = {"_lk": lk._keys(left, "l", "_lk"), "_rk": lk._keys(right, "r", "_rk")}
    cand = lk._candidates(keys[seg].where(f"{seg}_len >= 5"), seg, keys[pr], pr, 4).count()
    assert cand < 300  # the openings alone would give 80 * 30


def test_staged_waterfall_sees_only_the_residue(spark):
    base = spark.createDataFrame([(1, "a"), (2, "Unknown"), (3, None), (4, "Unknown"), (5, "Unknown"), (None, None)], "k int, v string")
    seen = []

    def step(data):
        source = spark.createDataFrame(data, "k int, v string")

        def find(rest):
            seen.append(rows(rest, "k"))
            return source.join(rest.select("k").distinct(), "k", "left_semi")

        return find

    steps = [("one", step([(1, "zz"), (2, "b"), (2, "c"), (4, "Unknown"), (4, "d")])), ("two", step([(3, "e"), (4, "f")]))]
    out = lk.staged_waterfall(base, "k", "v", steps, drop_unresolved=False)
    assert rows(out, "k", "v_final" if "v_final" in out.columns else "value_final", "resolved_by") == sorted(
        [(1, "a", "base"), (2, "b", "one"), (2, "c", "one"), (4, "d", "one"), (3, "e", "two"), (4, "f", "two"), (5, None, None), (None, None, None)],
        key=lambda t: tuple((x is not None, x) for x in t),
    )
    assert seen == [[(None,), (2,), (3,), (4,), (5,)], [(None,), (3,), (4,), (5,)]]
    assert lk.staged_waterfall(base, "k", "v", steps[:1]).count() == 4


def test_signatures_are_one_small_number(spark):
    """A signature row is the key's id and six bytes; named lengths limit the probes."""
    left = lk._keys(spark.createDataFrame([("abcdefgh" * 5,), ("hgfedcba" * 6,)], "l string"), "l", "_lk")
    right = lk._keys(spark.createDataFrame([("abcdefgh" * 5,), ("x" * 200,)], "r string"), "r", "_rk")
    lengths = left.select(F.col("_lk_len").alias("_slen")).distinct()
    sub = lk._probe_substrings(right, "_rk", "_rk_len", 4, 5, lengths)
    assert sub.columns == ["_rk_id", "_sig"] and sub.where("_sig < 0 OR _sig >= 281474976710656").count() == 0
    assert sub.select("_rk_id").distinct().count() == 1  # nothing is near 200 characters
    assert rows(lk._candidates(left, "_lk", right, "_rk", 4).select(F.col("_lk_id") == F.col("_rk_id"))) == [(True,)]


def test_fuzzy_long_keys_of_all_classes_and_thin_keys(spark, monkeypatch):
    """Keys of many lengths, some mostly boilerplate, periodic, of one letter or not ASCII:
    the same pairs as comparing all of them."""
    monkeypatch.setattr(lk, "HOT_SEGMENT", 4)
    rnd = random.Random(12)
    word = lambda n, al="abcdefgh ": "".join(rnd.choice(al) for _ in range(n))
    page = word(900)
    sides = [[], []]
    for n in (30, 43, 44, 46, 47, 60, 87, 88, 90, 175, 177, 352, 355, 700, 1408, 2900):
        for al in ("abcdefgh ", "aéßñ "):
            base = word(n, al)
            sides[0].append(base)
            sides[1] += [_mutate(rnd, base, e) for e in (0, 2, 3, 5)]
    for i in range(12):  # over half of the text is shared, in other places
        own = word(300 + i)
        sides[0].append(page[:600] + own[:150] + page[600:] + own[150:])
        sides[1] += [_mutate(rnd, sides[0][-1], 3), page[:600] + word(300 + i)]
    for text in ("a" * 500, "ab" * 300, "é" * 400, page):
        sides[0].append(text)
        sides[1] += [text, text[:-2], text + "bab", _mutate(rnd, text, 3)]
    left = spark.createDataFrame([(s,) for s in sides[0]], "l string")
    right = spark.createDataFrame([(s,) for s in sides[1]], "r string")
    all_of_them = left.distinct().crossJoin(right.distinct()).select("l", "r", F.levenshtein("l", "r", 3).alias("d")).where("d >= 0")
    want = rows(all_of_them)
    assert len(want) > 100
    assert rows(lk.fuzzy_pairs(left, right, "l", "r", 3), "_lk", "_rk", "_dist") == want


def test_fuzzy_join_of_long_keys_moves_few_rows(spark):
    """Every side shuffles some tens of rows for a long key; substrings of all lengths that may
    match one were thousands for each right key."""
    rnd = random.Random(13)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(1500)) for _ in range(40)]
    left = spark.createDataFrame([(i, _mutate(rnd, t, 4)) for i, t in enumerate(texts)], "i int, l string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "j int, r string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables are not broadcast
    try:
        out = lk.fuzzy_join(left, right, "l", "r", 15)
        exchanges = [x for x in executed_nodes(out) if x.getClass().getSimpleName() == "ShuffleExchangeExec"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = sum(x.metrics().apply("shuffleRecordsWritten").value() for x in exchanges)
    assert moved < 80 * 400
    assert rows(out, "i", "j") == [(i, i) for i in range(40)]
