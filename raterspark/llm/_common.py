"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    A machine-local folder is installed only where that setting is unset and the session
    runs in one process (tests, notebooks); on a cluster an unset folder is an error.
    """
    found = ensure_checkpoint_dir(spark)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="rater-ckpt-"))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to a fresh folder in the shared folder and read it back.

    Cuts the lineage; a lost executor costs only re-reading, and no two applications meet.
    """
    path = f"{shared_folder(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks over which the rows of one key are dealt by spread_join.
WAYS = 16


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a lookup that holds one row per key, however many rows a key has.

    The rows of a key are dealt by column ``by`` over WAYS tasks and lookup rows are copied to
    each, so a key with a third of all rows does not meet in one task.
    """
    dealt = rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(WAYS)))
    copies = lookup.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))))
    return dealt.join(copies, [*keys, "_way"], how).drop("_way")


def fold(id_col: Column | str, n: int) -> Column:
    """crc32 of the id's text, modulo ``n`` (null id: crc32 of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_volume(docs: DataFrame, text_col: str) -> int:
    """Characters in all texts (one column scan), to size blocks and buckets."""
    return docs.agg(F.sum(F.length(F.col(text_col)).cast("long"))).first()[0] or 0
