"""Rater-agreement queries (C5-C12) over ``lineitem``, ``documents`` and ``labels``.

Stand-in rating tables:

* orders x raters: each line of an order is one rater's rating of the order; lines 1-6
  are human raters ``r1``..``r6`` and line 7 plays the model (``model``). Categories:
  ``cat_r`` = flag R, ``cat_o`` = status O, ``cat_d`` = discount above 0.05 (NULL when
  the discount is 0, so missing ratings are exercised).
* documents x raters: ``human_a`` from ``labels``, ``human_b`` and ``model`` from rules on
  ``documents`` columns (with NULL toxic ratings for one language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.functions.text import after_first_line, first_line
from raterspark.operators import agreement as ag
from raterspark.operators.summary import freq_table
from raterspark.plans.common import LINE_ORDER, LINE_ORDER_SQL, r6, table

CATS = ["cat_r", "cat_o", "cat_d"]
ROW_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice"]
MODEL_PATTERN = "model"


def _line_frame(li: DataFrame) -> DataFrame:
    """Rating rows (order, rater, three 0/1 categories, row order columns) from lines."""
    reader = F.when(F.col("l_linenumber") == 7, F.lit("model")).otherwise(
        F.concat(F.lit("r"), F.col("l_linenumber").cast("string"))
    )
    return li.select(
        "l_orderkey", reader.alias("reader"),
        (F.col("l_returnflag") == "R").cast("int").alias("cat_r"),
        (F.col("l_linestatus") == "O").cast("int").alias("cat_o"),
        F.when(F.col("l_discount") < 0.005, F.lit(None).cast("int"))
        .otherwise((F.col("l_discount") > 0.05).cast("int")).alias("cat_d"),
        *ROW_ORDER,
    )


def line_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human and model rating rows combined by :func:`rating_union`."""
    li = table(spark, sf_dir, "lineitem")
    human = _line_frame(li.where(F.col("l_linenumber") < 7))
    model = _line_frame(li.where(F.col("l_linenumber") >= 7))
    u = ag.rating_union([human, model], "l_orderkey", "reader", ROW_ORDER)
    return u.select("l_orderkey", "reader", *CATS)


def _line_long(spark, sf_dir):
    return ag.long_ratings(line_ratings(spark, sf_dir), "l_orderkey", "reader", CATS)


def line_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rater name that can occur (a superset is exact: raters without shared
    items yield no pair rows), from a one-column scan instead of the rating chain."""
    li = table(spark, sf_dir, "lineitem")
    return _line_frame(li).select("reader").distinct()


def _pairs(spark, sf_dir):
    return ag.pair_counts(_line_long(spark, sf_dir), "l_orderkey", "reader", roster=line_roster(spark, sf_dir))


def _repeating_frame(spark, sf_dir) -> DataFrame:
    frame = _line_frame(table(spark, sf_dir, "lineitem"))
    person = F.regexp_extract("reader", "^r([0-9])$", 1).try_cast("int")
    return frame.withColumn("reader", F.when(person.isNull(), F.col("reader")).otherwise(
        F.concat(F.lit("r"), ((person - 1) % 3 + 1).cast("string"))))


def _repeating_roster(spark, sf_dir) -> DataFrame:
    """Raters by name alone: one column of the lines, not the chain of ratings."""
    return _repeating_frame(spark, sf_dir).select("reader").distinct()


def repeated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ratings in which raters repeat themselves: lines 1-6 are rated by three people
    (lines 1 and 4 by ``r1`` and so on), line 7 by the model; nothing is de-duplicated."""
    frame = _repeating_frame(spark, sf_dir)
    kept = ag.rating_union([frame], "l_orderkey", "reader", ROW_ORDER, dedupe=False)
    return ag.long_ratings(kept, "l_orderkey", "reader", CATS)


def q_pairwise_agreement_dup(spark, sf_dir):
    """Pair counts over ratings that keep repeated rows of a rater."""
    ratings = repeated_ratings(spark, sf_dir)
    return ag.pair_counts(ratings, "l_orderkey", "reader", roster=_repeating_roster(spark, sf_dir))


def q_percent_agreement_dup(spark, sf_dir):
    """Percent agreement over the orders that both raters rated exactly once."""
    once = ag.single_ratings(repeated_ratings(spark, sf_dir), "l_orderkey", "reader")
    pairs = ag.pair_counts(once, "l_orderkey", "reader", roster=_repeating_roster(spark, sf_dir))
    p = ag.percent_agreement(pairs, MODEL_PATTERN)
    return p.select("pair", "category", r6("percent_agreement").alias("percent_agreement"), "pair_type")


def q_rating_union(spark, sf_dir):
    """Human + model rows, items with > 1 row, first row per (item, reader)."""
    return line_ratings(spark, sf_dir)


def q_mismatches(spark, sf_dir):
    """Orders where a category differs across raters (distinct counts, NULL counted)."""
    return ag.mismatches(line_ratings(spark, sf_dir), "l_orderkey", CATS)


def q_pairwise_agreement(spark, sf_dir):
    """Agree / disagree / NA counts per rater pair and category."""
    return _pairs(spark, sf_dir)


def q_agreement_overall(spark, sf_dir):
    """Agree / disagree / NA pair counts per category and overall, pair-free."""
    return ag.agreement_overall(_line_long(spark, sf_dir), "l_orderkey")


def _pct(spark, sf_dir):
    return ag.percent_agreement(_pairs(spark, sf_dir), MODEL_PATTERN)


def q_percent_agreement(spark, sf_dir):
    """Percent agreement per (pair, category) with the pair type."""
    p = _pct(spark, sf_dir)
    return p.select("pair", "category", r6("percent_agreement").alias("percent_agreement"), "pair_type")


def q_agreement_se(spark, sf_dir):
    """Mean, sd, n, se of percent agreement by category x pair type."""
    s = ag.agreement_se(_pct(spark, sf_dir))
    return s.select(
        "category", "pair_type", r6("mean_agreement").alias("mean_agreement"),
        r6("sd_agreement").alias("sd_agreement"), "n", r6("se").alias("se"),
    )


def q_agreement_box(spark, sf_dir):
    """Box statistics of percent agreement by category x pair type."""
    b = ag.agreement_box(_pct(spark, sf_dir))
    return b.select("category", "pair_type", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


def q_agreement_by_type(spark, sf_dir):
    """Mean percent agreement per pair type."""
    t = ag.agreement_by_type(_pct(spark, sf_dir))
    return t.select("pair_type", r6("mean_agreement").alias("mean_agreement"))


def doc_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rating rows (doc, rater, quality, toxic) of three raters."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    human_a = labels.select("doc_id", F.lit("human_a").alias("reader"), "quality", "toxic")
    human_b = docs.select(
        "doc_id", F.lit("human_b").alias("reader"),
        (F.col("n_chars") > 800).cast("int").alias("quality"),
        F.when(F.col("lang") == "es", F.lit(None).cast("int"))
        .otherwise((F.col("lang") == "de").cast("int")).alias("toxic"),
    )
    model = docs.select(
        "doc_id", F.lit("model").alias("reader"),
        (F.col("n_chars") > 400).cast("int").alias("quality"),
        F.col("source").isin("src3", "src7").cast("int").alias("toxic"),
    )
    return human_a.unionByName(human_b).unionByName(model)


def q_prevalence(spark, sf_dir):
    """Positive rate per reader x category."""
    p = ag.prevalence(doc_ratings(spark, sf_dir), "reader", ["quality", "toxic"])
    return p.select("reader", "category", r6("positive_rate").alias("positive_rate"))


def q_human_vs_model(spark, sf_dir):
    """Model rate against human mean +- sd per category."""
    p = ag.prevalence(doc_ratings(spark, sf_dir), "reader", ["quality", "toxic"])
    h = ag.human_vs_model(p, "reader", "model")
    return h.select("category", *[r6(c).alias(c) for c in ("model_rate", "mean_human_rate", "sd_human_rate")])


def q_prevalence_comparison(spark, sf_dir):
    """Model and human rates in long form (Model sd 0, Humans sd)."""
    p = ag.prevalence(doc_ratings(spark, sf_dir), "reader", ["quality", "toxic"])
    c = ag.comparison_long(ag.human_vs_model(p, "reader", "model"))
    return c.select("category", "rater", r6("rate").alias("rate"), r6("sd").alias("sd"))


def q_disagreement_text(spark, sf_dir):
    """Responses of disagreeing (document, category) groups with the document's
    title line and body."""
    long = ag.long_ratings(doc_ratings(spark, sf_dir), "doc_id", "reader", ["quality", "toxic"])
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", first_line("text").alias("title"), after_first_line("text").alias("abstract")
    )
    return ag.inspect_disagreements(long, docs, "doc_id", ["title", "abstract"], ["doc_id"])


def q_disagreement_text_first(spark, sf_dir):
    """The same where documents repeat: one in three has an earlier edition, whose text
    is the one shown."""
    long = ag.long_ratings(doc_ratings(spark, sf_dir), "doc_id", "reader", ["quality", "toxic"])
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit(2).alias("edition"), first_line("text").alias("title"), after_first_line("text").alias("abstract")
    )
    earlier = docs.where(F.col("doc_id") % 3 == 0).select(
        "doc_id", F.lit(1).alias("edition"), F.concat(F.lit("Earlier: "), "title").alias("title"), F.lit(None).cast("string").alias("abstract")
    )
    return ag.inspect_disagreements(long, docs.unionByName(earlier), "doc_id", ["title", "abstract"], ["edition"])


def set_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two delimited lists per order: words of the part names on lines 1-3 and 4+."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    return j.groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("w")))), ", ").alias("list_a"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("w")))), "; ").alias("list_b"),
    )


def q_set_similarity(spark, sf_dir):
    """C11: Jaccard similarity of the two lists per order."""
    s = ag.set_similarity(set_lists(spark, sf_dir), "l_orderkey", "list_a", "list_b")
    return s.select("l_orderkey", "inter", "uni", r6("similarity").alias("similarity"))


def q_set_similarity_table(spark, sf_dir):
    """Frequency table of the similarity values (NULL excluded)."""
    s = ag.set_similarity(set_lists(spark, sf_dir), "l_orderkey", "list_a", "list_b")
    return freq_table(s.select(r6("similarity").alias("similarity")), "similarity")


def support_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate answers (order, line order key, delimited label list or a sentinel)."""
    li = table(spark, sf_dir, "lineitem")
    listed = F.concat(
        F.col("l_returnflag"), F.lit(", "), F.col("l_linestatus"),
        F.when(F.col("l_tax") > 0.05, F.concat(F.lit("; "), F.col("l_returnflag"))).otherwise(F.lit("")),
    )
    answer = (
        F.when(F.col("l_discount") < 0.005, F.lit("None"))
        .when(F.col("l_discount") < 0.015, F.lit(""))
        .otherwise(listed)
    )
    return li.select("l_orderkey", *LINE_ORDER, answer.alias("answer"))


UNKNOWN = ("None", "", "Unknown")


def q_label_support(spark, sf_dir):
    """Per (order, label) replicates naming it, replicates, support over 3."""
    s = ag.label_support(support_answers(spark, sf_dir), "l_orderkey", LINE_ORDER, "answer", 3, UNKNOWN)
    return s.select("l_orderkey", "label", "n_included", "n_reps", r6("agreement_rate").alias("agreement_rate"))


def q_modal_agreement(spark, sf_dir):
    """Modal share and full agreement of known answers per order."""
    m = ag.modal_agreement(support_answers(spark, sf_dir), "l_orderkey", "answer", UNKNOWN)
    return m.select("l_orderkey", "n_reps", r6("modal_agreement").alias("modal_agreement"), "full_agreement")


QUERIES = {
    "rating_union": q_rating_union,
    "mismatches": q_mismatches,
    "pairwise_agreement": q_pairwise_agreement,
    "pairwise_agreement_dup": q_pairwise_agreement_dup,
    "percent_agreement_dup": q_percent_agreement_dup,
    "agreement_overall": q_agreement_overall,
    "percent_agreement": q_percent_agreement,
    "agreement_se": q_agreement_se,
    "agreement_box": q_agreement_box,
    "agreement_by_type": q_agreement_by_type,
    "prevalence": q_prevalence,
    "human_vs_model": q_human_vs_model,
    "prevalence_comparison": q_prevalence_comparison,
    "disagreement_text": q_disagreement_text,
    "disagreement_text_first": q_disagreement_text_first,
    "set_similarity": q_set_similarity,
    "set_similarity_table": q_set_similarity_table,
    "label_support": q_label_support,
    "modal_agreement": q_modal_agreement,
}

_RT = """
u AS (
  SELECT l_orderkey,
         CASE WHEN l_linenumber = 7 THEN 'model' ELSE 'r' || CAST(l_linenumber AS VARCHAR) END AS reader,
         CAST(l_returnflag = 'R' AS INTEGER) AS cat_r,
         CAST(l_linestatus = 'O' AS INTEGER) AS cat_o,
         CASE WHEN l_discount < 0.005 THEN NULL ELSE CAST(l_discount > 0.05 AS INTEGER) END AS cat_d,
         l_partkey, l_suppkey, l_extendedprice
  FROM lineitem),
k AS (SELECT l_orderkey FROM u GROUP BY l_orderkey HAVING count(*) >= 2),
d AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, reader
                               ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM u WHERE l_orderkey IN (SELECT l_orderkey FROM k)),
rt AS (SELECT l_orderkey, reader, cat_r, cat_o, cat_d FROM d WHERE rn = 1),
long AS (
  SELECT l_orderkey, reader, 'cat_r' AS variable, CAST(cat_r AS VARCHAR) AS response FROM rt
  UNION ALL SELECT l_orderkey, reader, 'cat_o', CAST(cat_o AS VARCHAR) FROM rt
  UNION ALL SELECT l_orderkey, reader, 'cat_d', CAST(cat_d AS VARCHAR) FROM rt),
pr AS (
  SELECT a.reader AS reader_1, b.reader AS reader_2, a.variable, a.response AS r1, b.response AS r2
  FROM long a JOIN long b
    ON a.l_orderkey = b.l_orderkey AND a.variable = b.variable AND a.reader < b.reader),
pc AS (
  SELECT reader_1, reader_2, variable,
         CAST(count(*) AS BIGINT) AS n_both,
         CAST(count(*) FILTER (WHERE r1 = r2) AS BIGINT) AS n_agree,
         CAST(count(*) FILTER (WHERE r1 <> r2) AS BIGINT) AS n_disagree,
         CAST(count(*) FILTER (WHERE r1 IS NULL OR r2 IS NULL) AS BIGINT) AS n_na
  FROM pr GROUP BY reader_1, reader_2, variable),
pct AS (
  SELECT reader_1 || '-' || reader_2 AS pair, variable AS category,
         CASE WHEN n_agree + n_disagree > 0 THEN n_agree / (n_agree + n_disagree) END AS percent_agreement,
         CASE WHEN regexp_matches(reader_1 || ' ' || reader_2, 'model') THEN 'Human-Model' ELSE 'Human-Human' END AS pair_type
  FROM pc)
"""

_PAIRS_ON = _RT[_RT.index("pr AS ("):]
_RT_DUP = """
u AS (
  SELECT l_orderkey,
         CASE WHEN l_linenumber = 7 THEN 'model' ELSE 'r' || CAST((l_linenumber - 1) % 3 + 1 AS VARCHAR) END AS reader,
         CAST(l_returnflag = 'R' AS INTEGER) AS cat_r,
         CAST(l_linestatus = 'O' AS INTEGER) AS cat_o,
         CASE WHEN l_discount < 0.005 THEN NULL ELSE CAST(l_discount > 0.05 AS INTEGER) END AS cat_d
  FROM lineitem),
rt AS (SELECT * FROM u WHERE l_orderkey IN (SELECT l_orderkey FROM u GROUP BY l_orderkey HAVING count(*) >= 2)),
every AS (
  SELECT l_orderkey, reader, 'cat_r' AS variable, CAST(cat_r AS VARCHAR) AS response FROM rt
  UNION ALL SELECT l_orderkey, reader, 'cat_o', CAST(cat_o AS VARCHAR) FROM rt
  UNION ALL SELECT l_orderkey, reader, 'cat_d', CAST(cat_d AS VARCHAR) FROM rt),
"""
_LONG_ALL = "long AS (SELECT * FROM every),"
_LONG_ONCE = """long AS (
  SELECT l_orderkey, reader, variable, min(response) AS response
  FROM every GROUP BY l_orderkey, reader, variable HAVING count(*) = 1),"""

_DOCR = """
dr AS (
  SELECT doc_id, 'human_a' AS reader, quality, toxic FROM labels
  UNION ALL
  SELECT doc_id, 'human_b', CAST(n_chars > 800 AS INTEGER),
         CASE WHEN lang = 'es' THEN NULL ELSE CAST(lang = 'de' AS INTEGER) END FROM documents
  UNION ALL
  SELECT doc_id, 'model', CAST(n_chars > 400 AS INTEGER), CAST(source IN ('src3', 'src7') AS INTEGER) FROM documents),
dlong AS (
  SELECT doc_id, reader, 'quality' AS category, CAST(quality AS DOUBLE) AS value FROM dr
  UNION ALL SELECT doc_id, reader, 'toxic', CAST(toxic AS DOUBLE) FROM dr),
prev AS (SELECT reader, category, avg(value) AS positive_rate FROM dlong GROUP BY reader, category)
"""

_SUPPORT = f"""
sa AS (
  SELECT l_orderkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS rep,
         CASE WHEN l_discount < 0.005 THEN 'None'
              WHEN l_discount < 0.015 THEN ''
              ELSE l_returnflag || ', ' || l_linestatus ||
                   CASE WHEN l_tax > 0.05 THEN '; ' || l_returnflag ELSE '' END END AS answer
  FROM lineitem),
ok AS (SELECT * FROM sa WHERE answer IS NOT NULL AND answer NOT IN ('None', '', 'Unknown'))
"""

ORACLE = {
    "rating_union": "WITH " + _RT + "SELECT * FROM rt",
    "mismatches": "WITH " + _RT + """
SELECT l_orderkey,
       CAST(count(DISTINCT cat_r) + max(CAST(cat_r IS NULL AS INTEGER)) AS BIGINT) AS cat_r,
       CAST(count(DISTINCT cat_o) + max(CAST(cat_o IS NULL AS INTEGER)) AS BIGINT) AS cat_o,
       CAST(count(DISTINCT cat_d) + max(CAST(cat_d IS NULL AS INTEGER)) AS BIGINT) AS cat_d
FROM rt GROUP BY l_orderkey
HAVING count(DISTINCT cat_r) + max(CAST(cat_r IS NULL AS INTEGER)) > 1
    OR count(DISTINCT cat_o) + max(CAST(cat_o IS NULL AS INTEGER)) > 1
    OR count(DISTINCT cat_d) + max(CAST(cat_d IS NULL AS INTEGER)) > 1""",
    "pairwise_agreement": "WITH " + _RT + "SELECT * FROM pc",
    "agreement_overall": "WITH " + _RT + """
SELECT variable,
       CAST(count(*) FILTER (WHERE r1 = r2) AS BIGINT) AS n_agree,
       CAST(count(*) FILTER (WHERE r1 <> r2) AS BIGINT) AS n_disagree,
       CAST(count(*) FILTER (WHERE r1 IS NULL OR r2 IS NULL) AS BIGINT) AS n_na
FROM pr GROUP BY GROUPING SETS ((variable), ())""",
    "percent_agreement": "WITH " + _RT + """
SELECT pair, category, round(percent_agreement, 6) AS percent_agreement, pair_type FROM pct""",
    "agreement_se": "WITH " + _RT + """
SELECT category, pair_type, round(avg(percent_agreement), 6) AS mean_agreement,
       round(stddev_samp(percent_agreement), 6) AS sd_agreement,
       CAST(count(*) AS BIGINT) AS n,
       round(stddev_samp(percent_agreement) / sqrt(count(*)), 6) AS se
FROM pct GROUP BY category, pair_type""",
    "agreement_box": "WITH " + _RT + """
SELECT category, pair_type, round(min(percent_agreement), 6) AS min,
       round(quantile_cont(percent_agreement, 0.25), 6) AS q1,
       round(quantile_cont(percent_agreement, 0.5), 6) AS median,
       round(quantile_cont(percent_agreement, 0.75), 6) AS q3,
       round(max(percent_agreement), 6) AS max
FROM pct GROUP BY category, pair_type""",
    "prevalence": "WITH " + _DOCR + """
SELECT reader, category, round(positive_rate, 6) AS positive_rate FROM prev""",
    "human_vs_model": "WITH " + _DOCR + """,
m AS (SELECT category, positive_rate AS model_rate FROM prev WHERE reader = 'model'),
h AS (SELECT category, avg(positive_rate) AS mean_human_rate, stddev_samp(positive_rate) AS sd_human_rate
      FROM prev WHERE reader <> 'model' GROUP BY category)
SELECT m.category, round(model_rate, 6) AS model_rate, round(mean_human_rate, 6) AS mean_human_rate,
       round(sd_human_rate, 6) AS sd_human_rate
FROM m LEFT JOIN h USING (category)""",
    "disagreement_text": "WITH " + _DOCR + """,
rl AS (
  SELECT doc_id, reader, 'quality' AS variable, CAST(quality AS VARCHAR) AS response FROM dr
  UNION ALL SELECT doc_id, reader, 'toxic', CAST(toxic AS VARCHAR) FROM dr),
bad AS (
  SELECT doc_id, variable FROM rl WHERE response IS NOT NULL
  GROUP BY doc_id, variable HAVING count(DISTINCT response) > 1),
dd AS (
  SELECT doc_id, regexp_extract(text, '^([^\\n]*)', 1) AS title,
         regexp_extract(text, '(?s)^[^\\n]*\\n(.*)$', 1) AS abstract
  FROM documents)
SELECT rl.doc_id, rl.reader, rl.variable, rl.response, dd.title, dd.abstract
FROM rl JOIN bad USING (doc_id, variable) JOIN dd USING (doc_id)""",
    "set_similarity": """
WITH j AS (
  SELECT l.l_orderkey, l.l_linenumber, p.w
  FROM lineitem l LEFT JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) p
    ON l.l_partkey = p.p_partkey),
s AS (
  SELECT l_orderkey,
         coalesce(string_agg(DISTINCT w, ', ' ORDER BY w) FILTER (WHERE l_linenumber <= 3), '') AS list_a,
         coalesce(string_agg(DISTINCT w, '; ' ORDER BY w) FILTER (WHERE l_linenumber > 3), '') AS list_b
  FROM j GROUP BY l_orderkey),
t AS (
  SELECT l_orderkey,
         list_distinct(list_filter(list_transform(string_split_regex(list_a, '\\s*[;,]\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS a,
         list_distinct(list_filter(list_transform(string_split_regex(list_b, '\\s*[;,]\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS b
  FROM s)
SELECT l_orderkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS inter,
       CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS uni,
       round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0
                  THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity
FROM t""",
    "set_similarity_table": """
WITH j AS (
  SELECT l.l_orderkey, l.l_linenumber, p.w
  FROM lineitem l LEFT JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) p
    ON l.l_partkey = p.p_partkey),
s AS (
  SELECT l_orderkey,
         coalesce(string_agg(DISTINCT w, ', ' ORDER BY w) FILTER (WHERE l_linenumber <= 3), '') AS list_a,
         coalesce(string_agg(DISTINCT w, '; ' ORDER BY w) FILTER (WHERE l_linenumber > 3), '') AS list_b
  FROM j GROUP BY l_orderkey),
t AS (
  SELECT list_distinct(list_filter(list_transform(string_split_regex(list_a, '\\s*[;,]\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS a,
         list_distinct(list_filter(list_transform(string_split_regex(list_b, '\\s*[;,]\\s*'), lambda x: trim(x)), lambda x: x <> '')) AS b
  FROM s),
v AS (
  SELECT round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0
                    THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity
  FROM t)
SELECT similarity, count(*) AS n FROM v WHERE similarity IS NOT NULL GROUP BY similarity""",
    "label_support": "WITH " + _SUPPORT + """,
ex AS (
  SELECT DISTINCT l_orderkey, rep, trim(x) AS label
  FROM ok, unnest(string_split_regex(answer, '\\s*[,;|]\\s*')) AS t(x)
  WHERE trim(x) <> ''),
c AS (SELECT l_orderkey, label, CAST(count(*) AS BIGINT) AS n_included FROM ex GROUP BY l_orderkey, label),
r AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_reps FROM sa GROUP BY l_orderkey)
SELECT c.l_orderkey, label, n_included, n_reps, round(n_included / 3.0, 6) AS agreement_rate
FROM c LEFT JOIN r USING (l_orderkey)""",
    "modal_agreement": "WITH " + _SUPPORT + """,
per AS (SELECT l_orderkey, answer, count(*) AS c FROM ok GROUP BY l_orderkey, answer)
SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS n_reps, round(max(c) / sum(c), 6) AS modal_agreement,
       count(*) = 1 AS full_agreement
FROM per GROUP BY l_orderkey""",
}

ORACLE["pairwise_agreement_dup"] = "WITH " + _RT_DUP + _LONG_ALL + _PAIRS_ON + "SELECT * FROM pc"
ORACLE["percent_agreement_dup"] = "WITH " + _RT_DUP + _LONG_ONCE + _PAIRS_ON + """
SELECT pair, category, round(percent_agreement, 6) AS percent_agreement, pair_type FROM pct"""
ORACLE["agreement_by_type"] = "WITH " + _RT + """
SELECT pair_type, round(avg(percent_agreement), 6) AS mean_agreement FROM pct GROUP BY pair_type"""
ORACLE["prevalence_comparison"] = "WITH " + _DOCR + """,
m AS (SELECT category, positive_rate AS model_rate FROM prev WHERE reader = 'model'),
h AS (SELECT category, avg(positive_rate) AS mean_human_rate, stddev_samp(positive_rate) AS sd_human_rate
      FROM prev WHERE reader <> 'model' GROUP BY category),
c AS (SELECT m.category, model_rate, mean_human_rate, sd_human_rate FROM m LEFT JOIN h USING (category))
SELECT category, 'Model' AS rater, round(model_rate, 6) AS rate, 0.0 AS sd FROM c
UNION ALL
SELECT category, 'Humans', round(mean_human_rate, 6), round(sd_human_rate, 6) FROM c"""

ORACLE["disagreement_text_first"] = ORACLE["disagreement_text"].replace(
    "SELECT rl.doc_id, rl.reader, rl.variable, rl.response, dd.title, dd.abstract",
    """SELECT rl.doc_id, rl.reader, rl.variable, rl.response,
       CASE WHEN dd.doc_id % 3 = 0 THEN 'Earlier: ' || dd.title ELSE dd.title END AS title,
       CASE WHEN dd.doc_id % 3 > 0 THEN dd.abstract END AS abstract""",
)
