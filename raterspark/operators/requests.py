"""Model round trip at the data boundary: request build (C29) and response ingest.

The remote call itself (upload, batch create, poll, download) is not part of this
package; requests are written as JSON lines and responses are read back as JSON lines.
Both directions are column expressions over DataFrames (``to_json`` / ``from_json``),
so they run per partition with no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterspark.functions import text as tx

REQUEST_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("body", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("reasoning_effort", T.StringType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("temperature", T.IntegerType()),
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ]))),
        T.StructField("max_completion_tokens", T.IntegerType()),
    ])),
])

RESPONSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("model", T.StringType()),
            T.StructField("created", T.LongType()),
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("index", T.IntegerType()),
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
            ]))),
        ])),
    ])),
])


def fill_template(template: str, value: Column, marker: str = "{text}") -> Column:
    """Literal template with one ``marker`` replaced by a column value."""
    before, _, after = template.partition(marker)
    return F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after))


def build_requests(
    docs: DataFrame,
    id_col: str,
    text: Column,
    model: str,
    system_prompt: str,
    user_template: str,
    n: int = 5,
    temperature: int = 1,
    reasoning_effort: str = "medium",
    max_completion_tokens: int = 800,
    url: str = "/v1/chat/completions",
) -> DataFrame:
    """One JSON request per document: (custom_id, request) with ``request`` a JSON text
    of :data:`REQUEST_SCHEMA` shape. ``text`` is the composed document text
    (:func:`raterspark.functions.text.compose_text`)."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.lit(reasoning_effort).alias("reasoning_effort"),
        F.lit(n).alias("n"),
        F.lit(temperature).alias("temperature"),
        F.array(
            F.struct(F.lit("developer").alias("role"), F.lit(system_prompt).alias("content")),
            F.struct(F.lit("user").alias("role"), fill_template(user_template, text).alias("content")),
        ).alias("messages"),
        F.lit(max_completion_tokens).alias("max_completion_tokens"),
    )
    req = F.struct(
        F.col(id_col).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"),
        body.alias("body"),
    )
    return docs.select(F.col(id_col).cast("string").alias("custom_id"), F.to_json(req).alias("request"))


def parse_requests(requests: DataFrame, col: str = "request") -> DataFrame:
    """Parse request JSON back into typed columns (for checks and re-submission)."""
    r = F.from_json(F.col(col), REQUEST_SCHEMA)
    return requests.select(r.alias("r")).select(
        "r.custom_id", "r.method", "r.url", F.col("r.body.model").alias("model"),
        F.col("r.body.n").alias("n"), F.col("r.body.temperature").alias("temperature"),
        F.col("r.body.reasoning_effort").alias("reasoning_effort"),
        F.col("r.body.max_completion_tokens").alias("max_completion_tokens"),
        F.size("r.body.messages").alias("n_messages"),
        F.col("r.body.messages")[0]["content"].alias("system_content"),
        F.col("r.body.messages")[1]["content"].alias("user_content"),
    )


def flatten_responses(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON-lines responses -> one row per choice with parent metadata
    (``json_normalize`` with record path response.body.choices).

    Every line stays: a record without choices gives one row with record_status
    'no_choices', a line that is no JSON record one with 'malformed'; both keep the raw
    line. Other rows are 'ok' and their raw line is NULL.
    """
    with_raw = T.StructType([*RESPONSE_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    rec = F.from_json(F.col(col), with_raw, {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select(F.col(col).alias("line"), rec.alias("r"))
    choices = F.col("r.response.body.choices")
    status = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.lit("malformed"))
        .when(choices.isNull() | (F.size(choices) < 1), F.lit("no_choices"))
        .otherwise(F.lit("ok"))
    )
    return parsed.select(
        F.col("r.custom_id").alias("custom_id"),
        F.col("r.id").alias("id"),
        F.col("r.response.body.model").alias("model"),
        F.col("r.response.body.created").alias("created"),
        status.alias("record_status"),
        F.when(status != "ok", F.col("line")).alias("raw"),
        F.explode_outer(F.when(status == "ok", choices)).alias("c"),
    ).select(
        "custom_id", "id", "model", "created",
        F.col("c.index").alias("choice_index"), F.col("c.message.content").alias("message_content"),
        "record_status", "raw",
    )


def extract_label(
    content: Column,
    key: str,
    block: str = "regex",
    missing_key_text: str | None = "None",
    clean: str = "list_marks",
    quotes: str = "inside",
    no_block_text: str | None = "",
) -> Column:
    """Struct (label, parse_status) from a free-text answer, the text read once.

    ``block='regex'``: first non-greedy ``{...}``; ``block='balanced'``: first block with
    balanced braces outside quoted spans. The key's value is rendered as text
    (lists joined with ', '). A block without the key gives ``missing_key_text`` (the
    text ``None`` in the original regex variant, '' in the balanced one); an answer with
    no block gives ``no_block_text`` ('' by default: the original wrote a missing value
    to CSV and read it back as an empty string, which then counts as a blank vote). An
    unparsable block gives NULL. ``clean``: 'list_marks' removes brackets and quotes,
    'name_chars' keeps letters, comma, space and hyphen, 'none' keeps the value.
    """
    blk = tx.first_json_block(content) if block == "regex" else tx.first_balanced_block(content, quotes)

    def cleaned(found: Column) -> Column:
        value, status = found["value"], found["status"]
        if missing_key_text is not None:
            value = F.when(status == F.lit("no_key"), F.lit(missing_key_text)).otherwise(value)
        if no_block_text is not None:
            value = F.when(status == F.lit("no_block"), F.lit(no_block_text)).otherwise(value)
        if clean == "list_marks":
            value = tx.strip_list_marks(value)
        elif clean == "name_chars":
            value = tx.keep_name_chars(value)
        return F.struct(value.alias("label"), status.alias("parse_status"))

    return tx.bound(tx.json_key(blk, key), cleaned)


def ingest_responses(
    lines: DataFrame,
    key: str,
    col: str = "value",
    block: str = "regex",
    missing_key_text: str | None = "None",
    clean: str = "list_marks",
    label_col: str = "label_clean",
    no_block_text: str | None = "",
) -> DataFrame:
    """Response lines -> replicate table (custom_id, choice_index, message_content,
    label, model, parse_status). Never fails on malformed answers. A line without choices
    or that is no record gives one row with a NULL label and parse_status 'no_choices' or
    'malformed'; :func:`answered` leaves those out."""
    flat = flatten_responses(lines, col)
    found = extract_label(
        F.col("message_content"), key, block, missing_key_text, clean, no_block_text=no_block_text
    )
    read = flat.withColumn("_found", F.when(F.col("record_status") == "ok", found))
    return read.select(
        "custom_id", "choice_index", "message_content", F.col("_found.label").alias(label_col), "model",
        F.coalesce("_found.parse_status", "record_status").alias("parse_status"),
    )


def answered(replicates: DataFrame) -> DataFrame:
    """Rows of :func:`ingest_responses` that stand for an answer (for votes)."""
    return replicates.where(~F.col("parse_status").isin("no_choices", "malformed"))
