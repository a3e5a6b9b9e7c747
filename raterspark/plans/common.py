"""Shared helpers for the registered queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table. Column pruning and filters reach the Parquet scan; its splits
    follow spark.sql.files.maxPartitionBytes and minPartitionNum."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(col: Column | str) -> Column:
    """Round a double to 6 places (results are compared with an independent oracle)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6)


# Order of replicate rows within an order: (l_orderkey, l_linenumber, l_partkey,
# l_suppkey, l_extendedprice) is unique in lineitem, l_linenumber alone is not.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
