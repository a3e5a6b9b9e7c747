"""Delta-maintained token counts by source, language and tokenizer version.

A rollup lives in a folder. Every batch of events (inserts, deletes, revised counts) adds
signed rows: to the ledger, by document and tokenizer version, and to the deltas, by group.
Totals are sums of committed deltas, so no batch rewrites what earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

GROUP = ["source", "lang", "tokenizer_version"]
#: op is insert, delete or revise; of several events for one document and version in a
#: batch the one with the largest seq counts.
EVENTS = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long, seq long"
_LEDGER = "doc_id long, source string, lang string, tokenizer_version string, sign int, n_tokens long"
_DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals in ``folder``, a path that all executors share.

    commit() is idempotent: a batch whose marker exists is not applied again; what a failed
    attempt left is overwritten, as readers see only batches with a marker, which is written
    last. Batches are committed one at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self) -> list[int]:
        """Batch numbers that count, in ascending order: one number per batch."""
        path = f"{self.folder}/commits"
        if not self._exists(path):
            return []
        return sorted(r[0] for r in self.spark.read.schema("id long").parquet(f"{path}/*").collect())

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch-{b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def entries(self) -> DataFrame:
        """Documents and versions that count now: (doc_id, source, lang, version, n_tokens)."""
        keys = ["doc_id", *GROUP]
        total = self._read("ledger", _LEDGER).groupBy(*keys).agg(F.sum("sign").alias("n"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n > 0").drop("n")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) of groups that hold documents."""
        out = self._read("deltas", _DELTAS).groupBy(*GROUP)
        return out.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Apply a batch; False if it was applied before.

        insert and revise replace the count the document has under that tokenizer version, if
        any (a revise of an unknown document inserts it); delete removes it, for every
        version if tokenizer_version is null; deleting an unknown document changes nothing.
        Null n_tokens counts as 0; events with a null doc_id, or with an op that is none of
        the three, are ignored; null source and lang are groups of their own.

        Of a batch's events for one document and version the one with the largest seq counts
        (null is smallest; of equal ones delete before insert before revise, then the larger
        count). A delete of every version meets the batch's own events too: those of its seq
        or smaller do not happen. Repeated events count once, other columns are ignored, and
        an empty batch is committed as such.
        """
        if self._exists(f"{self.folder}/commits/batch-{batch}"):
            return False
        last = Window.partitionBy("doc_id", "tokenizer_version").orderBy(F.desc_nulls_last("seq"), "op", F.desc("n_tokens"))
        events = events.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(EVENTS).fields])
        events = events.where("doc_id is not null and op in ('insert', 'delete', 'revise')")
        events = events.withColumn("seq", F.coalesce("seq", F.lit(-(1 << 63)).cast("long")))
        wiped = events.where("op = 'delete' and tokenizer_version is null").groupBy("doc_id").agg(F.max("seq").alias("wiped"))
        events = events.join(wiped, "doc_id", "left")
        events = events.where("wiped is null or seq > wiped or op = 'delete'").drop("wiped")
        events = events.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "seq")
        now = self.entries()
        hit = events.select(F.col("doc_id").alias("e_doc"), F.col("tokenizer_version").alias("e_version"), "op")
        same_version = F.col("e_version").isNull() & (F.col("op") == "delete") | F.col("e_version").eqNullSafe(now["tokenizer_version"])
        gone = now.join(hit, (now["doc_id"] == F.col("e_doc")) & same_version, "left_semi")
        gone = gone.select("doc_id", *GROUP, F.lit(-1).alias("sign"), (-F.col("n_tokens")).alias("n_tokens"))
        new = events.where("op <> 'delete'").select(
            "doc_id", *GROUP, F.lit(1).alias("sign"), F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")
        )
        path = f"{self.folder}/ledger/batch-{batch}"
        gone.unionByName(new).select("doc_id", *GROUP, "sign", "n_tokens").write.mode("overwrite").parquet(path)
        ledger = self.spark.read.schema(_LEDGER).parquet(path)
        deltas = ledger.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch-{batch}")
        self.spark.range(batch, batch + 1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch-{batch}")
        return True
