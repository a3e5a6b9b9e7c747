import itertools
import random

import pytest
from conftest import rows

from raterspark.operators import agreement as ag


def _random_long(rnd, n_items=40, raters=("ann", "bob", "cy", "dee", "eve", "model")):
    data = []
    for item in range(n_items):
        for r in rnd.sample(raters, rnd.randint(1, len(raters))):
            for var in ("v1", "v2"):
                resp = rnd.choice(["0", "1", None]) if rnd.random() < 0.2 else rnd.choice(["0", "1"])
                data.append((item, r, var, resp))
    return data


def _brute_pairs(data):
    by = {}
    for item, r, var, resp in data:
        by.setdefault((item, var), []).append((r, resp))
    out = {}
    for (item, var), lst in by.items():
        for (r1, a), (r2, b) in itertools.permutations(lst, 2):
            if not r1 < r2:
                continue
            k = (r1, r2, var)
            c = out.setdefault(k, [0, 0, 0, 0])
            c[0] += 1
            if a is None or b is None:
                c[3] += 1
            elif a == b:
                c[1] += 1
            else:
                c[2] += 1
    return sorted((k[0], k[1], k[2], *v) for k, v in out.items())


@pytest.mark.parametrize("block", [8, 2, 4])
def test_pair_counts_match_brute_force(spark, block):
    rnd = random.Random(block)
    data = _random_long(rnd)
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    got = rows(ag.pair_counts(df, "item", "reader", block=block),
               "reader_1", "reader_2", "variable", "n_both", "n_agree", "n_disagree", "n_na")
    assert got == _brute_pairs(data)


def test_overall_count_form_equals_pair_sum(spark):
    rnd = random.Random(11)
    data = _random_long(rnd, 60)
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    pairs = _brute_pairs(data)
    overall = {r.variable: (r.n_agree, r.n_disagree, r.n_na) for r in ag.agreement_overall(df, "item").collect()}
    for var in ("v1", "v2"):
        sel = [p for p in pairs if p[2] == var]
        assert overall[var] == (sum(p[4] for p in sel), sum(p[5] for p in sel), sum(p[6] for p in sel))
    assert overall[None] == tuple(sum(overall[v][i] for v in ("v1", "v2")) for i in range(3))


def test_rating_union_counts_before_dedupe(spark):
    human = spark.createDataFrame([(1, "ann", 1, 0), (1, "ann", 0, 1), (2, "ann", 1, 2)], "id int, reader string, x int, pos int")
    model = spark.createDataFrame([(1, "model", 1, 0)], "id int, reader string, x int, pos int")
    u = ag.rating_union([human, model], "id", "reader", ["pos"])
    # item 2 has one row only -> dropped; item 1 keeps the first ann row (pos 0).
    assert rows(u, "id", "reader", "x") == [(1, "ann", 1), (1, "model", 1)]


def test_mismatches(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1), (2, 1)], "id int, c int")
    assert rows(ag.mismatches(df, "id", ["c"])) == [(1, 2)]


def test_percent_agreement_and_type(spark):
    pairs = spark.createDataFrame(
        [("ann", "model", "v", 4, 3, 1, 0), ("ann", "bob", "v", 2, 0, 0, 2)],
        "reader_1 string, reader_2 string, variable string, n_both long, n_agree long, n_disagree long, n_na long",
    )
    out = {r.pair: (r.percent_agreement, r.pair_type) for r in ag.percent_agreement(pairs, "model").collect()}
    assert out["ann-model"] == (0.75, "Human-Model")
    assert out["ann-bob"] == (None, "Human-Human")


def test_jaccard_symmetric_in_unit_interval(spark):
    rnd = random.Random(5)
    words = ["a", "b", "c", "d"]
    data = [(i, "; ".join(rnd.sample(words, rnd.randint(0, 3))), ", ".join(rnd.sample(words, rnd.randint(0, 3)))) for i in range(50)]
    df = spark.createDataFrame(data, "id int, l string, r string")
    ab = {r.id: r.similarity for r in ag.set_similarity(df, "id", "l", "r").collect()}
    ba = {r.id: r.similarity for r in ag.set_similarity(df, "id", "r", "l").collect()}
    assert ab == ba
    assert all(v is None or 0 <= v <= 1 for v in ab.values())


def test_label_support_constant_denominator(spark):
    df = spark.createDataFrame(
        [(1, 0, "France, Spain"), (1, 1, "France; France"), (1, 2, "None"), (1, 3, None)],
        "id int, rep int, answer string",
    )
    got = rows(ag.label_support(df, "id", ["rep"], "answer", 3, ("None", "", "Unknown")),
               "id", "label", "n_included", "n_reps", "agreement_rate")
    assert got == [(1, "France", 2, 4, pytest.approx(2 / 3)), (1, "Spain", 1, 4, pytest.approx(1 / 3))]


def test_modal_agreement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "Unknown")], "id int, ans string")
    got = {r.id: (r.n_reps, r.modal_agreement, r.full_agreement) for r in ag.modal_agreement(df, "id", "ans", ("Unknown",)).collect()}
    assert got[1] == (3, pytest.approx(2 / 3), False)
    assert got[2] == (1, 1.0, True)


def test_pair_counts_thousands_of_raters_and_null_keys(spark):
    rnd = random.Random(21)
    names = [f"r{i:05d}" for i in range(12000)]
    data = [(item, r, "v", rnd.choice(["0", "1", None])) for item in (1, 2, None) for r in rnd.sample(names, 40)]
    data += [(item, r, None, "1") for item in (3, 4) for r in names[100:103]] + [(1, None, "v", "1")]
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    roster = spark.createDataFrame([(n,) for n in names], "reader string")
    got = ag.pair_counts(df, "item", "reader", roster=roster)
    want = _brute_pairs([d for d in data if d[1] is not None])
    key = lambda t: tuple((x is not None, x) for x in t)
    assert rows(got, "reader_1", "reader_2", "variable", "n_both", "n_agree", "n_disagree", "n_na") == sorted(want, key=key)


@pytest.mark.parametrize("block", [8, 2])
def test_pair_counts_with_repeated_ratings(spark, block):
    rnd = random.Random(block + 50)
    data = [(rnd.randint(1, 15), rnd.choice("abcdef"), "v", rnd.choice(["0", "1", "2", None])) for _ in range(150)]
    data += [(99, "a", "v", "1"), (99, "a", "v", "0"), (99, "b", "v", "1")]
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    cols = ("reader_1", "reader_2", "variable", "n_both", "n_agree", "n_disagree", "n_na")
    assert rows(ag.pair_counts(df, "item", "reader", block=block), *cols) == _brute_pairs(data)
    often = {}
    for d in data:
        often.setdefault(d[:3], []).append(d)
    once = [v[0] for v in often.values() if len(v) == 1]
    assert rows(ag.pair_counts(ag.single_ratings(df, "item", "reader"), "item", "reader", block=block), *cols) == _brute_pairs(once)


def test_repeated_rating_gives_one_pair_each(spark):
    df = spark.createDataFrame([(1, "A", "v", "1"), (1, "A", "v", "0"), (1, "B", "v", "1")],
                               "item int, reader string, variable string, response string")
    assert rows(ag.pair_counts(df, "item", "reader")) == [("A", "B", "v", 2, 1, 1, 0)]
    assert ag.pair_counts(ag.single_ratings(df, "item", "reader"), "item", "reader").count() == 0


def test_rating_union_without_dedupe_keeps_duplicates(spark):
    human = spark.createDataFrame([(1, "ann", 1, 0), (1, "ann", 0, 1), (2, "ann", 1, 2)], "id int, reader string, x int, pos int")
    u = ag.rating_union([human], "id", "reader", ["pos"], dedupe=False)
    # item 1 has two rows (kept, duplicates included); item 2 has one row (dropped)
    assert rows(u, "id", "reader", "x") == [(1, "ann", 0), (1, "ann", 1)]
