"""A hot key holding a third of all rows: results stay exact and the plans reduce it
before any exchange (partial aggregation), with no per-item pair rows."""

import random

from conftest import rows
from pyspark.sql import functions as F
from test_agreement import _brute_pairs

from raterspark.operators import agreement as ag
from raterspark.operators import consensus as cs


def _plan(df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_item_vote(spark):
    rnd = random.Random(1)
    data = [(0, i, rnd.choice(["a", "b", ""])) for i in range(3000)]          # hot item
    data += [(1 + i % 500, 10_000 + i, rnd.choice(["a", "b"])) for i in range(6000)]
    df = spark.createDataFrame(data, "id int, pos int, label string").repartition(8)
    s = cs.vote_summary(df, "id", "label", {"n_a": "a", "n_b": "b", "n_blank": ""}, ["pos"])
    hot = [r for r in s.collect() if r.id == 0][0]
    assert hot.n_a + hot.n_b + hot.n_blank == 3000
    plan = _plan(s)
    assert "partial_count" in plan  # map-side reduction before the first exchange


def test_hot_item_many_raters_pairs(spark):
    rnd = random.Random(2)
    raters = [f"r{i:02d}" for i in range(40)]
    data = [(0, r, "v", rnd.choice(["0", "1"])) for r in raters]               # one item, 40 raters
    data += [(i, r, "v", rnd.choice(["0", "1"])) for i in range(1, 30) for r in rnd.sample(raters, 3)]
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    pc = ag.pair_counts(df, "item", "reader", block=8)
    got = rows(pc, "reader_1", "reader_2", "variable", "n_both", "n_agree", "n_disagree", "n_na")
    assert got == _brute_pairs(data)
    plan = _plan(pc)
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def _ratings(spark, raters=5):
    rnd = random.Random(4)
    data = [(i, f"r{r}", rnd.choice([0, 1, None]), rnd.choice([0.0, 0.5]), rnd.random()) for i in range(300) for r in range(raters)]
    return spark.createDataFrame(data + data[:50] + [(None, "r1", 1, 0.5, 0.1)] * 3, "id int, reader string, x int, y double, pos double")


def test_rating_union_is_dealt_by_item_once(spark):
    """Both forms deal the rows by item over all parts (adaptive execution merged them into few
    large ones), and aggregates by item need no further exchange or join."""
    df = _ratings(spark)
    for dedupe in (True, False):
        u = ag.rating_union([df], "id", "reader", ["pos"], dedupe=dedupe)
        assert u.count() == (1500 if dedupe else 1550)  # rows without an item belong to none
        assert u.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = _plan(u.groupBy("id", "reader").count())
        assert "Join" not in plan and plan.count("Exchange") == (2 if dedupe else 1)


def test_parts_of_a_rating_union_follow_the_ratings(spark, monkeypatch):
    """More ratings are dealt over more parts, so a part stays as small as with few; a number
    of parts fixed by the session gave each of them a share that grew with the tables."""
    df = _ratings(spark)  # 1550 rows with an item, 3 without
    parts = lambda u: u.groupBy(F.spark_partition_id().alias("p")).count().collect()
    want = {d: rows(ag.rating_union([df], "id", "reader", ["pos"], dedupe=d)) for d in (True, False)}
    monkeypatch.setattr(ag, "RATINGS_PER_PART", 50, raising=False)
    assert -(-1550 // 50) == 31 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for dedupe in (True, False):
        u = ag.rating_union([df], "id", "reader", ["pos"], dedupe=dedupe)
        assert u.rdd.getNumPartitions() == 31
        assert max(r["count"] for r in parts(u)) < 150  # 8 parts held 190 on average
        assert rows(u) == want[dedupe]
        long = ag.long_ratings(u, "id", "reader", ["x", "y"])
        assert _plan(ag.agreement_overall(long, "id")).count("Exchange") == (3 if dedupe else 2)


def test_mismatches_counts_without_expanding(spark):
    df = _ratings(spark)
    got = ag.mismatches(df, "id", ["x", "y"])
    assert "Expand" not in _plan(got)
    by = {}
    for r in df.collect():
        seen = by.setdefault(r.id, (set(), set()))
        seen[0].add(r.x), seen[1].add(r.y)
    want = {k: (len(x), len(y)) for k, (x, y) in by.items() if len(x) > 1 or len(y) > 1}
    assert {r.id: (r.x, r.y) for r in got.collect()} == want
    assert [t for _, t in got.dtypes] == ["int", "bigint", "bigint"]


def test_one_block_of_raters_is_not_joined_with_itself(spark):
    data = [(r.id, r.reader, "x", None if r.x is None else str(r.x)) for r in _ratings(spark).collect()]
    df = spark.createDataFrame(data, "item int, reader string, variable string, response string")
    joins = lambda pc: _plan(pc).count("Join ")
    assert joins(ag.pair_counts(df, "item", "reader", block=8)) == 3  # the raters' names only
    assert joins(ag.pair_counts(df, "item", "reader", block=4)) > 3
    for block in (8, 4):
        got = rows(ag.pair_counts(df, "item", "reader", block=block), "reader_1", "reader_2", "variable", "n_both", "n_agree", "n_disagree", "n_na")
        assert got == _brute_pairs(data)
