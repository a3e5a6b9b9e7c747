from conftest import rows
from pyspark.sql import functions as F

from raterspark.operators import reshape as rs
from raterspark.operators import summary as sm
from raterspark.operators.ordering import arrange, order_by_measure, quantiles, running_total


def test_top_k_keeps_ties(spark):
    data = [(i, 100 - i) for i in range(19)] + [(19, 50), (20, 50), (21, 10)]
    df = spark.createDataFrame(data, "id int, n int")
    out = sm.top_k_ties(df, "n", 20)
    assert out.count() == 21


def test_growth_zero_fill_and_monotone(spark):
    df = spark.createDataFrame([("a", 2000, 2), ("a", 2003, 1), ("b", 2001, 5), (None, 2002, 1)], "g string, year int, n long")
    full = rs.complete_years(df, ["g"], "year", "n")
    assert full.count() == 3 * 4
    cum = sm.cumulative(full, ["g"], "year", "n", "n_cum").collect()
    series = {}
    for r in sorted(cum, key=lambda r: (str(r.g), r.year)):
        series.setdefault(r.g, []).append(r.n_cum)
    for vals in series.values():
        assert vals == sorted(vals)
    assert series["a"] == [2, 2, 2, 3]


def test_complete_observed(spark):
    df = spark.createDataFrame([(2000, "x", "p", 1), (2001, "y", "q", 2)], "year int, g string, c string, n long")
    out = rs.complete_observed(df, ["year", "g", "c"], "n")
    assert out.count() == 8 and out.agg(F.sum("n")).collect()[0][0] == 3


def test_group_totals_grouping_sets(spark):
    df = spark.createDataFrame([("H", "CN", 3), ("H", "Rest", 2), ("L", "Rest", None)], "g string, h string, n long")
    assert rows(sm.group_totals(df, "g", "h", "n")) == [
        ("H", None, 5), ("H", "CN", 3), ("H", "Rest", 2), ("L", None, 0), ("L", "Rest", 0)]


def test_topic_share_within_distinct_and_denominator(spark):
    df = spark.createDataFrame([("g1", "t1", 1), ("g1", "t1", 1), ("g1", "t2", 2), ("g2", "t1", 3)], "g string, t string, item int")
    out = {(r.g, r.t): (r.n_items, r.n_total, r.share) for r in sm.topic_share_within(df, "item", "t", "g").collect()}
    assert out[("g1", "t1")] == (1, 2, 0.5)
    assert out[("g2", "t1")] == (1, 1, 1.0)
    shares = sm.topic_share(df, "item", "t").collect()
    assert all(r.share <= 1 for r in shares)


def test_explode_tokens_keeps_empty_and_null(spark):
    df = spark.createDataFrame([(1, "A; B , C"), (2, ""), (3, None)], "id int, s string")
    out = rows(rs.explode_tokens(df, "s", r";\s*|\s*,\s*"))
    assert out == [(1, "A"), (1, "B"), (1, "C"), (2, ""), (3, None)]


def test_flags_to_long_and_domain(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "id int, a int, b int")
    assert rows(rs.flags_to_long(df, ["a", "b"])) == [(1, "a"), (3, "a"), (3, "b")]
    dom = rs.with_domain(df.select("id"), "flag", [0, 1])
    assert dom.count() == 6


def test_full_outer_null_safe(spark):
    a = spark.createDataFrame([(1, 10), (None, 11)], "k int, a int")
    b = spark.createDataFrame([(None, 20), (2, 21)], "k int, b int")
    assert rows(rs.full_outer(a, b, ["k"]), "k", "a", "b") == [(None, 11, 20), (1, 10, None), (2, None, 21)]


def test_expand_years(spark):
    df = spark.createDataFrame(
        [(1, "2019", "2016; 2017"), (2, "2017 - 2021", None), (3, "2000 - 2001", ""), (4, "2010", "")],
        "id int, year string, rep string",
    )
    out = rows(rs.expand_years(df, "year", "rep", {"2017 - 2021": "2019"}), "id", "year")
    assert out == [(1, 2016), (1, 2017), (1, 2019), (2, 2019), (3, None), (4, 2010)]


def test_label_filter_literal_and_row_wise(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 1, 1), (4, 0, 0, None)], "id int, a int, b int, none int")
    assert rows(sm.label_filter(df, ["a", "b"], "none"), "id") == [(1,), (2,)]
    assert rows(sm.label_filter(df, ["a", "b"], "none", require_any_label=True), "id") == [(1,)]


def test_entity_counts(spark):
    df = spark.createDataFrame([("GB", 1), ("GB", 1), ("FR", 2)], "c string, item int")
    assert rows(sm.entity_counts(df, "c")) == [("FR", 1), ("GB", 2)]
    assert rows(sm.entity_counts(df, "c", "item", distinct_entities=True)) == [("FR", 1), ("GB", 1)]


def test_percent_label(spark):
    df = spark.createDataFrame([(0.374,), (None,)], "s double")
    assert [r[0] for r in df.select(sm.percent_label("s")).collect()] == ["37%", None]


def test_label_filter_null_flag_drops_all(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (2, None, 0, 0)], "id int, a int, b int, none int")
    assert sm.label_filter(df, ["a", "b"], "none").count() == 0


def test_order_by_measure_and_mean_se(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "lv string, n int")
    assert rows(order_by_measure(df, "lv", "n"), "lv", "level_rank") == [("a", 2), ("b", 1), ("c", 2)]
    vals = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0)], "g string, v double")
    out = {r.g: (r.mean, r.sd, r.n, r.se) for r in sm.mean_se(vals, ["g"], "v").collect()}
    assert out["g"][0] == 2.0 and out["g"][2] == 2 and abs(out["g"][3] - out["g"][1] / 2 ** 0.5) < 1e-12
    assert out["h"][1] is None and out["h"][3] is None  # sd of one value is missing


def test_dense_index_contiguous_and_sorted(spark):
    import random as _r

    rnd = _r.Random(4)
    vals = [f"r{rnd.randint(0, 300):04d}" for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "name string")
    got = sorted((r.name, r._idx) for r in rs.dense_index(df, "name").collect())
    want = list(zip(sorted(set(vals)), range(len(set(vals)))))
    assert got == want


def test_null_groups_keep_their_counts(spark):
    df = spark.createDataFrame([(None, 2001, 7), (None, 2003, 2), ("a", 2002, 1)], "g string, year int, n long")
    got = {(r.g, r.year): r.n for r in rs.complete_years(df, ["g"], "year", "n").collect()}
    assert got == {(None, 2001): 7, (None, 2002): 0, (None, 2003): 2, ("a", 2001): 0, ("a", 2002): 1, ("a", 2003): 0}
    got = {(r.year, r.g): r.n for r in rs.complete_observed(df, ["year", "g"], "n").collect()}
    assert got == {(2001, None): 7, (2002, None): 0, (2003, None): 2, (2001, "a"): 0, (2002, "a"): 1, (2003, "a"): 0}
    items = spark.createDataFrame([(1, "t", None), (2, "t", None), (3, "u", "g")], "item int, topic string, g string")
    totals = spark.createDataFrame([(None, 4), ("g", 2)], "g string, n_total int")
    out = sm.topic_share_within(items, "item", "topic", "g", totals).collect()
    assert {(r.g, r.topic): r.share for r in out} == {(None, "t"): 0.5, ("g", "u"): 0.5}


def test_top_k_when_all_rows_tie(spark):
    df = spark.range(50).selectExpr("id", "cast(5 as long) as n")
    assert {(r.n, r["rank"]) for r in sm.top_k_ties(df, "n", 3).collect()} == {(5, 1)}
    assert sm.top_k_ties(df, "n", 3).count() == 50
    few = spark.createDataFrame([(1, 9), (2, None), (3, 4)], "id int, n int")
    assert sorted((r.id, r["rank"]) for r in sm.top_k_ties(few, "n", 3).collect()) == [(1, 1), (2, 3), (3, 2)]


def test_fallback_rows_only_without_a_primary_row(spark):
    schema = "e string, v double"
    first = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], schema)
    second = spark.createDataFrame([("a", 100.0), ("b", 5.0), ("c", 7.0), (None, 2.0), (None, 4.0)], schema)
    third = spark.createDataFrame([("c", 9.0), ("d", 8.0), (None, 50.0)], schema)
    out = sm.first_source([first, second, third], "e", mean=F.avg("v"), n=F.count("*"))
    got = {r.e: (r["mean"], r.n, r.source_rank) for r in out.collect()}
    # b has a primary row, if without a value
    assert got == {"a": (2.0, 2, 1), "b": (None, 1, 1), "c": (7.0, 1, 2), None: (3.0, 2, 2), "d": (8.0, 1, 3)}
    assert sm.first_source([first.limit(0), first.limit(0)], "e", mean=F.avg("v")).count() == 0


def test_deferred_label_filter_equals_the_row_filter(spark):
    schema = "g string, a int, b int, none int"
    cases = [
        [("x", 1, 0, 0), ("x", 0, 0, 0), ("y", 0, 1, 1), (None, 0, 0, 0), ("z", 1, 1, None)],
        [("x", 1, 0, 0), ("y", None, 0, 0)],
        [("x", 0, 0, 0), ("y", 0, 0, 0)],
        [],
    ]
    for data in cases:
        df = spark.createDataFrame(data, schema)
        want = rows(sm.entity_counts(sm.label_filter(df, ["a", "b"], "none"), "g"), "g", "n")
        tallies = sm.label_tallies(df, ["a", "b"], "none", ["g"])
        assert rows(sm.labelled_entity_counts(tallies, "g"), "g", "n") == want


def test_arrange_several_keys_with_ties_and_missing(spark):
    import random as _r

    rnd = _r.Random(3)
    data = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, 0.5, 1.5]), rnd.choice(["u", "v", None]), k) for k in range(400)]
    df = spark.createDataFrame(data, "a int, b double, c string, k int").repartition(6)
    out = arrange(df, ["a", ("b", "desc"), "c", ("k", "desc")]).collect()
    last = lambda x, sign=1: (x is None, sign * x if isinstance(x, (int, float)) else x or "")
    want = sorted(data, key=lambda r: (last(r[0]), last(r[1], -1), last(r[2]), -r[3]))
    assert [tuple(r)[:4] for r in sorted(out, key=lambda r: r.position)] == want
    assert sorted(r.position for r in out) == list(range(1, 401))
    assert arrange(df.limit(0), ["a"]).count() == 0


def test_running_total_by_group(spark):
    data = [(g, v, w) for g in ("x", None, "y") for v, w in [(1, 5), (2, 0), (3, 7), (9, 2)]]
    df = spark.createDataFrame(data, "g string, v int, w long").repartition(5)
    got = {(r.g, r.v): r.before for r in running_total(df, [F.col("v").asc()], "w", ["g"]).collect()}
    assert got == {(g, v): b for g in ("x", None, "y") for v, b in [(1, 0), (2, 5), (3, 5), (9, 12)]}


def test_order_by_measure_missing_last_and_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 5), ("d", 9), ("e", None)], "lv string, n int")
    assert {r.lv: r.level_rank for r in order_by_measure(df, "lv", "n").collect()} == {"a": 2, "b": 3, "c": 2, "d": 1, "e": 3}


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    data = [("one", 3.0), ("none", None), ("none", None), ("two", 1.0), ("two", 2.0)]
    data += [("many", float(x)) for x in rng.choice(rng.normal(size=300), 2000)] + [(None, float(x)) for x in rng.integers(0, 4, 50)]
    data += [("many", None)] * 5
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    probs = {"lo": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r.g: [r[c] for c in probs] for r in quantiles(df, ["g"], "v", probs).collect()}
    assert got.pop("none") == [None] * 5
    for g, found in got.items():
        values = [v for h, v in data if h == g and v is not None]
        assert np.allclose(found, np.quantile(values, list(probs.values())), rtol=1e-12)
    assert set(got) == {"one", "two", "many", None}
