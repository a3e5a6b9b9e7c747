"""Property tests (hypothesis) against small pure-Python models of each rule, plus a few
golden values stated by the original outputs (bins, Gini values, the VEN override)."""

import re

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from raterspark.functions import text as tx
from raterspark.operators import consensus as cs
from raterspark.operators import linkage as lk
from raterspark.operators import summary as sm

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def _py_mode(values):
    vals = [v for v in values if v is not None]
    if not vals:
        return None
    order = []
    counts = {}
    for v in vals:
        if v not in counts:
            order.append(v)
        counts[v] = counts.get(v, 0) + 1
    best = max(counts.values())
    return next(v for v in order if counts[v] == best)


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "", None]), min_size=1, max_size=7), min_size=1, max_size=8))
def test_mode_first_matches_python(spark, groups):
    data = [(g, i, v) for g, vals in enumerate(groups) for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "id int, pos int, v string")
    got = dict(rows(cs.mode_first(df, ["id"], "v", ["pos"]), "id", "v_mode"))
    want = {g: _py_mode(vals) for g, vals in enumerate(groups) if _py_mode(vals) is not None}
    assert got == want


def _py_tokens(s):
    if s is None:
        return None
    return [t.strip() for t in re.split(r"\s*[;,]\s*", s) if t.strip() != ""]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab ;,\t", max_size=12)), min_size=1, max_size=10))
def test_tokens_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    got = {r.id: r.t for r in df.select("id", tx.tokens("s").alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _py_tokens(t)


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@SETTINGS
@given(
    st.lists(st.text(alphabet="abc", min_size=0, max_size=9), min_size=1, max_size=8),
    st.lists(st.text(alphabet="abc", min_size=0, max_size=9), min_size=1, max_size=8),
    st.integers(min_value=0, max_value=3),
)
def test_fuzzy_segments_equal_band_equal_python(spark, left, right, k):
    ldf = spark.createDataFrame([(s,) for s in left], "l string")
    rdf = spark.createDataFrame([(s,) for s in right], "r string")
    want = sorted({(a, b, _lev(a, b)) for a in left for b in right if _lev(a, b) <= k})
    for strategy in ("band", "segments"):
        got = rows(lk.fuzzy_pairs(ldf, rdf, "l", "r", k, strategy=strategy), "_lk", "_rk", "_dist")
        assert got == want, strategy


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=4), min_size=3, max_size=3))
def test_norm_gini_formula(spark, counts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([tuple(counts)], "a int, b int, c int")
    got = df.select(cs.norm_gini(F.col("a"), F.col("b"), F.col("c"))).collect()[0][0]
    total = sum(counts)
    if total == 0:
        assert got is None
    else:
        want = (1 - sum((c / total) ** 2 for c in counts)) / (1 - 1 / 3)
        assert got == pytest.approx(want)


def test_golden_bins_and_override(spark):
    # Values stated by the original country summary: 10.1 -> low, 37.7 -> very high.
    df = spark.createDataFrame([(10.1,), (37.7,)], "x double")
    labels = ["very low", "low", "medium", "high", "very high"]
    got = [r[0] for r in df.select(sm.bin_left_closed("x", [0, 10, 15, 25, 35, 100], labels)).collect()]
    assert got == ["low", "very high"]
    dim = spark.createDataFrame([("VEN", "Lower middle income")], "Code string, grp string")
    ov = spark.createDataFrame([("VEN", "Upper middle income")], "Code string, grp string")
    assert lk.apply_overrides(dim, ov, "Code", "grp").collect()[0].grp == "Upper middle income"


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["ann", "bob", "model"]), st.integers(0, 1)),
                min_size=1, max_size=25))
def test_rating_union_matches_python(spark, data):
    from raterspark.operators import agreement as ag

    rowsp = [(item, reader, flag, pos) for pos, (item, reader, flag) in enumerate(data)]
    df = spark.createDataFrame(rowsp, "id int, reader string, flag int, pos int")
    got = rows(ag.rating_union([df], "id", "reader", ["pos"]), "id", "reader", "flag")
    counts = {}
    for item, _, _, _ in rowsp:
        counts[item] = counts.get(item, 0) + 1
    first = {}
    for item, reader, flag, pos in sorted(rowsp, key=lambda r: r[3]):
        if counts[item] >= 2 and (item, reader) not in first:
            first[(item, reader)] = flag
    assert got == sorted((i, r, f) for (i, r), f in first.items())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3),
                          st.one_of(st.none(), st.sampled_from(["None", "", "A", "A, B", "B; A", "A|A", " C ,"]))),
                min_size=1, max_size=20))
def test_label_support_matches_python(spark, data):
    from raterspark.operators import agreement as ag

    rowsp = [(item, pos, ans) for pos, (item, ans) in enumerate(data)]
    df = spark.createDataFrame(rowsp, "id int, rep int, answer string")
    got = rows(ag.label_support(df, "id", ["rep"], "answer", 3, ("None", "", "Unknown")),
               "id", "label", "n_included", "n_reps")
    n_reps = {}
    for item, _, _ in rowsp:
        n_reps[item] = n_reps.get(item, 0) + 1
    named = {}
    for item, rep, ans in rowsp:
        if ans is None or ans in ("None", "", "Unknown"):
            continue
        for tok in {t.strip() for t in re.split(r"\s*[,;|]\s*", ans)} - {""}:
            named[(item, tok)] = named.get((item, tok), 0) + 1
    assert got == sorted((i, lab, n, n_reps[i]) for (i, lab), n in named.items())


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(2000, 2006), st.integers(1, 5)),
                min_size=1, max_size=15))
def test_complete_years_and_cumulative_match_python(spark, data):
    from raterspark.operators import reshape as rs

    counts = {}
    for g, y, n in data:
        counts[(g, y)] = counts.get((g, y), 0) + n
    df = spark.createDataFrame([(g, y, n) for (g, y), n in counts.items()], "g string, year int, n long")
    full = sm.cumulative(rs.complete_years(df, ["g"], "year", "n"), ["g"], "year", "n", "n_cum")
    got = rows(full, "g", "year", "n", "n_cum")
    lo, hi = min(y for _, y in counts), max(y for _, y in counts)
    want = []
    for g in sorted({g for g, _ in counts}):
        run = 0
        for y in range(lo, hi + 1):
            run += counts.get((g, y), 0)
            want.append((g, y, counts.get((g, y), 0), run))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(alphabet="ab ;,", max_size=10)),
                          st.one_of(st.none(), st.text(alphabet="ab ;,", max_size=10))), min_size=1, max_size=10))
def test_set_similarity_matches_python(spark, pairs):
    from raterspark.operators import agreement as ag

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    got = {r.id: (r.inter, r.uni, r.similarity) for r in ag.set_similarity(df, "id", "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        if a is None or b is None:
            assert got[i] == (None, None, None)
            continue
        sa, sb = set(_py_tokens(a)), set(_py_tokens(b))
        inter, uni = len(sa & sb), len(sa | sb)
        assert got[i][:2] == (inter, uni)
        assert got[i][2] == (inter / uni if uni else None)
