"""Queries through files: CSV rules, several models in one scan, sinks written twice.

Stand-in: the customers are the rows of a classification table of three models (key modulo
3). They are rendered as the CSV files of such a table, with the header in another order, a
decimal comma, ``NA``, blanks and quoted separators, written to the shared folder and read
back in one scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterspark.operators import requests as rq
from raterspark.operators.linkage import unique_dimension
from raterspark.operators.ordering import arrange
from raterspark.plans.common import LINE_ORDER, LINE_ORDER_SQL, table
from raterspark.plans.requests_q import MODEL, nested_response_lines
from raterspark.sources import io

HEADER = ["segment", "account balance", "c_custkey", "name"]
SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("account.balance", T.DoubleType()), T.StructField("segment", T.StringType()),
])


def _fields(spark, sf_dir) -> DataFrame:
    """The rendered fields, under the file's header names, and the model."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.translate(F.format_string("%.2f", "c_acctbal"), ".", ",")
    return c.select(
        F.when(k % 5 == 0, "NA").when(k % 5 == 1, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 7 == 0, "NA").when(k % 7 == 1, "").when(k % 7 == 2, "n/a").otherwise(number).alias("account balance"),
        k.cast("string").alias("c_custkey"),
        F.when(k % 4 == 0, F.concat(F.col("c_name"), F.lit('; "Ltd"'))).otherwise(F.col("c_name")).alias("name"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
    )


def _scratch(spark, name: str) -> str:
    return f"{io.run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _balance(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("account.balance", "balance")


def q_csv_models(spark, sf_dir):
    """Per-model CSV files in one scan, the model as a column, by R's rule (a blank
    text stays) and by the pandas rule (a blank text is missing)."""
    path = _scratch(spark, "classification")
    w = _fields(spark, sf_dir).write.mode("overwrite").partitionBy("model")
    w.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    schema = T.StructType([*SCHEMA.fields, T.StructField("model", T.StringType())])
    read = [
        io.read_r_csv(spark, path, schema, sep=";", decimal=",", blank_as_null=pandas, multi_line=False).withColumn("rule", F.lit(rule))
        for rule, pandas in (("r", False), ("pandas", True))
    ]
    return _balance(read[0].unionByName(read[1]))


def q_csv_text_column(spark, sf_dir):
    """CSV records in a text column, typed by header name; records of the wrong length
    are kept as they are."""
    f = _fields(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", *[quoted(c) if c in ("name", "account balance") else F.col(f"`{c}`") for c in HEADER])
    broken = F.when(F.col("c_custkey").cast("long") % 11 == 3, F.concat(line, F.lit(";extra"))).otherwise(line)
    broken = F.when(F.col("c_custkey").cast("long") % 11 == 4, F.lit("cut;short")).otherwise(broken)
    return _balance(io.parse_r_csv(f.select(broken.alias("line"), "model"), "line", HEADER, SCHEMA, sep=";", decimal=","))


def q_response_files(spark, sf_dir):
    """Response records written as JSON lines, scanned back and flattened."""
    path = _scratch(spark, "responses")
    io.write_requests(nested_response_lines(spark, sf_dir), path, "value")
    flat = rq.flatten_responses(io.read_response_lines(spark, path))
    return flat.groupBy("record_status", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("custom_id").alias("n_items"), F.sum("choice_index").alias("choice_sum")
    )


def q_per_model_tables(spark, sf_dir):
    """K1, K2: per-model tables written, two models written again with revised rows, all read
    once: a second write replaces its models and leaves the others."""
    path = _scratch(spark, "per_model")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("label"), F.lit(1).alias("edition"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("model")
    )
    io.write_models(c, path, fmt="csv")
    io.write_models(c.where("model <> 'm0'").where(k % 2 == 0).withColumn("edition", F.lit(2)), path, fmt="csv")
    return io.read_models(spark, path, c.schema, fmt="csv")


def q_arranged_ratings(spark, sf_dir):
    """O2: ratings by item, then rate (largest first), flag and line, missing values last, with
    their position in the whole table."""
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey")).alias("item"),
        F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("rate"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_orderkey", *LINE_ORDER,
    )
    out = arrange(li, ["item", ("rate", "desc"), "flag", "l_orderkey", *LINE_ORDER])
    return out.select("item", "rate", "flag", "l_orderkey", "l_linenumber", "position")


def q_unique_dimension(spark, sf_dir):
    """A dimension with several rows a key (customers of a nation) made unique before it
    is joined: every supplier once, with its nation's first customer by segment."""
    dim = unique_dimension(
        table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_nationkey", ["c_mktsegment", "c_custkey"]
    )
    s = table(spark, sf_dir, "supplier")
    return s.join(dim, s.s_nationkey == dim.c_nationkey, "left").select("s_suppkey", "s_nationkey", "c_mktsegment", "c_custkey")


QUERIES = {
    "csv_models": q_csv_models,
    "csv_text_column": q_csv_text_column,
    "response_files": q_response_files,
    "per_model_tables": q_per_model_tables,
    "arranged_ratings": q_arranged_ratings,
    "unique_dimension": q_unique_dimension,
}

_TYPED = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '; "Ltd"' ELSE c_name END AS name,
       CASE WHEN c_custkey % 7 > 2 THEN round(c_acctbal, 2) END AS balance,
       CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS segment,
       'm' || CAST(c_custkey % 3 AS VARCHAR) AS model
FROM customer"""

ORACLE = {
    "csv_models": f"""
WITH t AS ({_TYPED})
SELECT *, 'r' AS rule FROM t
UNION ALL SELECT * REPLACE (nullif(segment, '') AS segment), 'pandas' FROM t""",
    "csv_text_column": f"""
WITH t AS ({_TYPED}),
f AS (
  SELECT t.*, CASE WHEN t.c_custkey % 7 = 0 THEN 'NA' WHEN t.c_custkey % 7 = 1 THEN '' WHEN t.c_custkey % 7 = 2 THEN 'n/a'
                   ELSE replace(printf('%.2f', c.c_acctbal), '.', ',') END AS number
  FROM t JOIN customer c USING (c_custkey))
SELECT CASE WHEN c_custkey % 11 NOT IN (3, 4) THEN c_custkey END AS c_custkey,
       CASE WHEN c_custkey % 11 NOT IN (3, 4) THEN name END AS name,
       CASE WHEN c_custkey % 11 NOT IN (3, 4) THEN balance END AS balance,
       CASE WHEN c_custkey % 11 NOT IN (3, 4) THEN segment END AS segment, model,
       CASE c_custkey % 11
         WHEN 3 THEN coalesce(segment, 'NA') || ';"' || number || '";' || CAST(c_custkey AS VARCHAR) || ';"' || replace(name, '"', '""') || '";extra'
         WHEN 4 THEN 'cut;short' END AS corrupt_record
FROM f""",
    "response_files": f"""
WITH c AS (SELECT conv_id, turn, conv_id % 7 AS kind FROM conversations)
SELECT CASE kind WHEN 3 THEN 'malformed' WHEN 5 THEN 'no_choices' ELSE 'ok' END AS record_status,
       CASE WHEN kind <> 3 THEN '{MODEL}' END AS model, count(*) AS n,
       count(DISTINCT CASE WHEN kind <> 3 THEN conv_id END) AS n_items,
       CAST(sum(CASE WHEN kind NOT IN (3, 5) THEN turn END) AS BIGINT) AS choice_sum
FROM c GROUP BY ALL""",
    "per_model_tables": """
SELECT c_custkey, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS edition,
       'm' || CAST(c_custkey % 3 AS VARCHAR) AS model
FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""",
    "arranged_ratings": f"""
WITH r AS (
  SELECT CASE WHEN l_orderkey % 50 <> 7 THEN l_orderkey END AS item, CASE WHEN l_quantity < 40 THEN l_quantity END AS rate,
         CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, *
  FROM lineitem)
SELECT item, rate, flag, l_orderkey, l_linenumber,
       row_number() OVER (ORDER BY item NULLS LAST, rate DESC NULLS LAST, flag NULLS LAST, l_orderkey, {LINE_ORDER_SQL}) AS position
FROM r""",
    "unique_dimension": """
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS rn FROM customer)
SELECT s_suppkey, s_nationkey, c_mktsegment, c_custkey
FROM supplier LEFT JOIN (SELECT * FROM d WHERE rn = 1) d ON s_nationkey = c_nationkey""",
}
