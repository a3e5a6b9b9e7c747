"""Driver contract: entry() and every registered query run on the smallest tables."""

import importlib.util
import os

import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F
from tools.plan_report import node_names

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() >= 0
    assert "label_mode" in df.columns


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_with_a_scalable_plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert len(df.columns) == len(set(df.columns))
    names = node_names(df)
    # no row-at-a-time Python UDF, no Arrow UDF column
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert not names[node], node


def test_guard_sees_below_scalar_subqueries_and_caches(spark):
    ids = spark.range(20)
    crossed = ids.join(spark.range(5).withColumnRenamed("id", "other"), F.col("id") < F.col("other"))
    assert node_names(crossed)["BroadcastNestedLoopJoin"] == 1
    under = ids.withColumn("n", crossed.groupBy().agg(F.count("*").alias("n")).scalar()).groupBy("n").count()
    assert node_names(under)["BroadcastNestedLoopJoin"] == 1
    cached = crossed.cache()
    assert node_names(cached.groupBy("id").count())["BroadcastNestedLoopJoin"] == 1
    cached.unpersist()
