"""Incremental ingestion of model responses with Structured Streaming.

Responses of a remote batch job arrive as JSON-lines files, possibly hours apart. This
job picks up each new file once, runs the same extraction as the batch path
(:func:`raterspark.operators.requests.ingest_responses`) and appends the replicate rows
to a Parquet table. The file sink and the checkpoint make the output exactly-once: a
restarted job (or a lost executor) resumes from the last committed batch.

Per-item vote counts can be maintained next to it (:func:`start_vote_counts`): a
streaming aggregation of (item, label) -> count and first position, from which
:func:`raterspark.operators.consensus.vote_summary`-style results are read at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raterspark.operators.requests import answered, ingest_responses


def response_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of response lines (one ``value`` column) from a folder."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_ingest(
    spark: SparkSession,
    source_path: str,
    sink_path: str,
    checkpoint_path: str,
    key: str,
    block: str = "regex",
    missing_key_text: str | None = "None",
    clean: str = "list_marks",
    available_now: bool = True,
) -> StreamingQuery:
    """Append extracted replicate rows of every new response file to ``sink_path``.

    ``checkpoint_path`` must be on shared storage on a cluster. ``available_now``
    processes what is there and stops (batch-like scheduling); otherwise the query runs
    until stopped.
    """
    rows = ingest_responses(
        response_stream(spark, source_path), key, block=block, missing_key_text=missing_key_text, clean=clean
    )
    writer = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", sink_path).option("checkpointLocation", checkpoint_path)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_vote_counts(
    spark: SparkSession,
    source_path: str,
    checkpoint_path: str,
    key: str,
    query_name: str,
    table_path: str,
    label_col: str = "label_clean",
    available_now: bool = True,
) -> StreamingQuery:
    """Running (custom_id, label) -> n votes, first choice index, kept in state (complete
    mode; one row per item and label, bounded by items x distinct labels).

    Every trigger rewrites the current counts as a Parquet table at ``table_path``, from the
    executors; no count passes through the driver."""
    rows = answered(ingest_responses(response_stream(spark, source_path), key))
    counts = rows.groupBy("custom_id", label_col).agg(
        F.count(F.lit(1)).alias("n_votes"), F.min("choice_index").alias("first_choice")
    )

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    writer = counts.writeStream.foreachBatch(write_batch).queryName(query_name)
    writer = writer.outputMode("complete").option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def mode_from_counts(counts: DataFrame, label_col: str = "label_clean") -> DataFrame:
    """First-seen mode per item from the streamed counts (NULL labels ignored)."""
    c = counts.where(F.col(label_col).isNotNull())
    return c.groupBy("custom_id").agg(
        F.min_by(label_col, F.struct(-F.col("n_votes"), F.col("first_choice"))).alias("label_mode"),
        F.sum("n_votes").alias("n_votes"),
    )
