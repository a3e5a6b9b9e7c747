"""Vote queries (single-label, gate, review list, multi-label, bands) on ``lineitem``.

Stand-in replicate table: an order is the item, each of its lines is one replicate
answer, the line order key is the replicate order. The answer is derived from
``l_returnflag`` with a missing answer (NULL) where ``l_discount`` is 0.1 and a blank
answer (``''``) for status-O lines with flag N. Class mapping: A = excluded,
R = included, '' = blank; N is a label outside the counted classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.operators import consensus
from raterspark.operators.reshape import cols_ending
from raterspark.plans.common import LINE_ORDER, LINE_ORDER_SQL, r6, table

VOTE_CLASSES = {"count_excluded": "A", "count_included": "R", "count_blank": ""}


def vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate rows (order, line order key, answer label) for the single-label vote."""
    li = table(spark, sf_dir, "lineitem")
    label = (
        F.when(F.col("l_discount") > 0.095, F.lit(None).cast("string"))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit(""))
        .otherwise(F.col("l_returnflag"))
    )
    return li.select("l_orderkey", *LINE_ORDER, label.alias("label"))


def _summary(spark, sf_dir):
    return consensus.vote_summary(
        vote_rows(spark, sf_dir), "l_orderkey", "label", VOTE_CLASSES, LINE_ORDER
    )


def q_vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen mode, class counts and normalised Gini per order."""
    s = _summary(spark, sf_dir)
    return s.select("l_orderkey", "label_mode", *VOTE_CLASSES, r6("gini_norm").alias("gini_norm"))


def q_vote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose vote is confident (gini < 0.5 and fewer than 2 blanks)."""
    g = consensus.vote_gate(_summary(spark, sf_dir))
    return g.select("l_orderkey", "label_mode", r6("gini_norm").alias("gini_norm"))


def q_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, reason) rows to check by hand."""
    return consensus.review_list(_summary(spark, sf_dir), "l_orderkey")


# Multi-label stand-in: an order line's answer is its part name printed as a list
# ("['small', 'ring']"); a line with zero discount gives a blank answer.
ML_LEVELS = ["ring", "widget", "bolt", "gear", "plate", "rod", "Blank"]


def multilabel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate rows (order, line order key, printed label list) for the multi-label vote."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    printed = F.concat(F.lit("['"), F.regexp_replace(F.col("p_name"), " ", "', '"), F.lit("']"))
    answer = F.when(F.col("l_discount") == 0.0, F.lit("")).otherwise(printed)
    return li.join(part, li.l_partkey == part.p_partkey, "left").select(
        "l_orderkey", *LINE_ORDER, answer.alias("answer")
    )


def _multilabel(spark, sf_dir):
    return consensus.multilabel_consensus(
        multilabel_rows(spark, sf_dir), "l_orderkey", LINE_ORDER, "answer", ML_LEVELS
    )


def q_multilabel_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order and level, majority 0/1 and replicate count."""
    return _multilabel(spark, sf_dir)


def q_agreement_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: unanimous / near / split shares of the level counts (Blank in, 'rod' out)."""
    ml = _multilabel(spark, sf_dir)
    cats = {c[: -len("_count")]: c for c in cols_ending(ml, "_count", exclude=["rod_count"])}
    out = consensus.agreement_bands(ml, cats, n_replicates=5)
    return out.select(
        "category", "total", "n_eq_0", "n_eq_5", "n_0_5", "n_1_4", "n_2_3",
        *[r6(c).alias(c) for c in ("prop_0_5", "prop_1_4", "prop_2_3")],
    )


def q_vote_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident orders that also have more than 2 'included' votes."""
    g = consensus.vote_gate(_summary(spark, sf_dir), min_count=("count_included", 2))
    return g.select("l_orderkey", "label_mode", "count_included")


FIT_LEVELS = {"Ring": "ring", "Widget": "widget", "Bolt": "bolt", "Gear": "gear", "Plate": "plate", "Rod": "rod"}


def q_multilabel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus rating rows (one 0/1 column per category, reader 'model'),
    orders with two or more blank replicates dropped."""
    return consensus.consensus_flags(
        _multilabel(spark, sf_dir), "l_orderkey", FIT_LEVELS, "model", blank_count_col="Blank_count"
    )


QUERIES = {
    "vote_consensus": q_vote_consensus,
    "vote_gate": q_vote_gate,
    "review_list": q_review_list,
    "multilabel_consensus": q_multilabel_consensus,
    "agreement_bands": q_agreement_bands,
    "vote_included": q_vote_included,
    "multilabel_flags": q_multilabel_flags,
}

_VOTE_CTE = f"""
WITH r AS (
  SELECT l_orderkey,
         CASE WHEN l_discount > 0.095 THEN NULL
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN ''
              ELSE l_returnflag END AS label,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS pos
  FROM lineitem),
v AS (
  SELECT l_orderkey, label, count(*) AS cnt, min(pos) AS first_pos
  FROM r WHERE label IS NOT NULL GROUP BY l_orderkey, label),
m AS (
  SELECT l_orderkey, label AS label_mode FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cnt DESC, first_pos) AS rn
    FROM v) WHERE rn = 1),
c AS (
  SELECT l_orderkey,
         CAST(count(*) FILTER (WHERE label = 'A') AS BIGINT) AS count_excluded,
         CAST(count(*) FILTER (WHERE label = 'R') AS BIGINT) AS count_included,
         CAST(count(*) FILTER (WHERE label = '') AS BIGINT) AS count_blank
  FROM r GROUP BY l_orderkey),
s AS (
  SELECT m.l_orderkey, m.label_mode, c.count_excluded, c.count_included, c.count_blank,
         CAST(c.count_excluded + c.count_included + c.count_blank AS DOUBLE) AS tot
  FROM m JOIN c USING (l_orderkey)),
g AS (
  SELECT *, CASE WHEN tot > 0 THEN
      (1 - ((count_excluded / tot) * (count_excluded / tot)
          + (count_included / tot) * (count_included / tot)
          + (count_blank / tot) * (count_blank / tot))) / (1 - 1.0 / 3) END AS gini_norm
  FROM s)
"""



def _ml_sql() -> str:
    flag_cols = ",\n".join(
        f"    CAST(coalesce(list_contains(toks, '{lv}'), false) AS INTEGER) AS f_{lv}" for lv in ML_LEVELS
    )
    aggs = ",\n".join(
        f"    CAST(sum(f_{lv}) AS BIGINT) AS c_{lv}, arg_min(f_{lv}, pos) AS first_{lv}" for lv in ML_LEVELS
    )
    outs = ",\n".join(
        f"  CAST(CASE WHEN c_{lv} * 2 > n_reps THEN 1 WHEN c_{lv} * 2 < n_reps THEN 0 ELSE first_{lv} END AS INTEGER)"
        f" AS {lv}_mode, c_{lv} AS {lv}_count" for lv in ML_LEVELS
    )
    return f"""
WITH a AS (
  SELECT l.l_orderkey,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {LINE_ORDER_SQL}) AS pos,
         CASE WHEN l.l_discount = 0.0 THEN '' ELSE '[''' || replace(p.p_name, ' ', ''', ''') || ''']' END AS answer
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
t AS (
  SELECT l_orderkey, pos,
         list_transform(string_split_regex(regexp_replace(
             CASE WHEN answer = '' THEN 'Blank' ELSE answer END, '[\\[\\]''"]', '', 'g'), ',\\s*'),
             lambda x: regexp_replace(x, '\\s+', '', 'g')) AS toks
  FROM a),
f AS (
  SELECT l_orderkey, pos,
{flag_cols}
  FROM t),
p AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_reps,
{aggs}
  FROM f GROUP BY l_orderkey)
SELECT l_orderkey,
{outs},
  n_reps
FROM p
"""


def _bands_sql() -> str:
    cats = [lv for lv in ML_LEVELS if lv != "rod"]
    unions = "\n  UNION ALL ".join(f"SELECT '{lv}' AS category, {lv}_count AS value FROM ml" for lv in cats)
    return f"""
WITH ml AS ({_ml_sql()}),
long AS ({unions}),
agg AS (
  SELECT category,
         CAST(count(value) AS BIGINT) AS total,
         CAST(count(*) FILTER (WHERE value = 0) AS BIGINT) AS n_eq_0,
         CAST(count(*) FILTER (WHERE value = 5) AS BIGINT) AS n_eq_5,
         CAST(count(*) FILTER (WHERE value IN (0, 5)) AS BIGINT) AS n_0_5,
         CAST(count(*) FILTER (WHERE value IN (1, 4)) AS BIGINT) AS n_1_4,
         CAST(count(*) FILTER (WHERE value IN (2, 3)) AS BIGINT) AS n_2_3
  FROM long GROUP BY GROUPING SETS ((category), ()))
SELECT category, total, n_eq_0, n_eq_5, n_0_5, n_1_4, n_2_3,
       round(n_0_5 / total, 6) AS prop_0_5,
       round(n_1_4 / total, 6) AS prop_1_4,
       round(n_2_3 / total, 6) AS prop_2_3
FROM agg
"""


ORACLE = {
    "vote_consensus": _VOTE_CTE + """
SELECT l_orderkey, label_mode, count_excluded, count_included, count_blank,
       round(gini_norm, 6) AS gini_norm FROM g""",
    "vote_gate": _VOTE_CTE + """
SELECT l_orderkey, label_mode, round(gini_norm, 6) AS gini_norm FROM g
WHERE gini_norm < 0.5 AND count_blank < 2""",
    "review_list": _VOTE_CTE + """
SELECT l_orderkey, 'dispersion' AS reason FROM g WHERE gini_norm > 0.5
UNION ALL
SELECT l_orderkey, 'blank' AS reason FROM g WHERE count_blank > 1""",
    "multilabel_consensus": _ml_sql(),
    "agreement_bands": _bands_sql(),
}

ORACLE["vote_included"] = _VOTE_CTE + """
SELECT l_orderkey, label_mode, count_included FROM g
WHERE gini_norm < 0.5 AND count_blank < 2 AND count_included > 2"""
ORACLE["multilabel_flags"] = "WITH ml AS (" + _ml_sql() + ")\nSELECT l_orderkey, " + ", ".join(
    f"{lv}_mode AS {out}" for out, lv in FIT_LEVELS.items()
) + ", 'model' AS reader FROM ml WHERE Blank_count < 2"
