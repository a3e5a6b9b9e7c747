"""Linkage queries: title keys, fuzzy joins, fuzzy subset, waterfall, name conformance.

Stand-ins:

* fuzzy titles: documents of source ``src0`` play the curated list, all other documents
  the items to resolve; the match key is :func:`title_key` of the whole text. k = 15.
* waterfall: a customer's order priority. Consensus = first-seen mode of its orders'
  priorities ('4-NOT SPECIFIED' and missing -> Unknown); fallback 1 = the mode over its
  fulfilled (status F) orders; fallback 2 = a manual list (segment AUTOMOBILE ->
  '3-MEDIUM'); unresolved customers are dropped.
* conform names: each customer's nation written in one of several spellings, mapped
  back to a nation code through an alias list, the nation table and a pattern table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.functions.nulls import sentinel_to
from raterspark.functions.text import title_key
from raterspark.operators import linkage as lk
from raterspark.operators.consensus import mode_first
from raterspark.plans.common import table
from raterspark.sources.io import materialize

MAX_DIST = 15
CURATED_SOURCE = "src0"
MANUAL_SOURCES = ["src1", "src2"]


def _titled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", title_key("text").alias("title_clean"))


def q_title_key(spark, sf_dir):
    """accent-folded, lower-cased, punctuation-free match key of each document."""
    return _titled(spark, sf_dir).select("doc_id", "title_clean")


# Fixed values of the stand-in: letters put in the place of plain ones.
RARE_LETTERS = ("ihnts", "ıħŋŧſ")


def q_title_key_letters(spark, sf_dir):
    """keys of texts whose letters have no accent to drop (ı ħ ŋ ŧ ſ), and the one-letter
    spellings ĳ and ŀ."""
    text = F.concat(F.translate("text", *RARE_LETTERS), F.lit(" Ĳsselmeer ĳs paraŀlel"))
    return table(spark, sf_dir, "documents").select("doc_id", title_key(text).alias("title_clean"))


def _sides(spark, sf_dir):
    t = _titled(spark, sf_dir)
    left = t.where(F.col("source") != CURATED_SOURCE).select("doc_id", "title_clean")
    right = t.where(F.col("source") == CURATED_SOURCE).select(
        F.col("doc_id").alias("match_doc_id"), F.col("lang").alias("match_lang"),
        F.col("title_clean").alias("match_title"),
    )
    return left, right


def _fuzzy(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    j = lk.fuzzy_join(left, right, "title_clean", "match_title", MAX_DIST)
    return j.select("doc_id", "match_doc_id", "match_lang", "dist")


def q_fuzzy_titles(spark, sf_dir):
    """Left fuzzy join (Levenshtein <= 15, all matches, distance kept)."""
    return _fuzzy(spark, sf_dir)


def q_fuzzy_titles_blocked(spark, sf_dir):
    """The same join, the left side's keys cut into segments and the right side's
    substrings probed (stated explicitly; it is the default)."""
    left, right = _sides(spark, sf_dir)
    j = lk.fuzzy_join(left, right, "title_clean", "match_title", MAX_DIST, strategy="segments", probe="right")
    return j.select("doc_id", "match_doc_id", "match_lang", "dist")


def q_fuzzy_subset(spark, sf_dir):
    """C14: documents whose key is within 15 edits of a curated key."""
    left, right = _sides(spark, sf_dir)
    return lk.fuzzy_semi(left, right, "title_clean", "match_title", MAX_DIST).select("doc_id")


def q_waterfall_fuzzy(spark, sf_dir):
    """C13 with J9 in the chain: a document's language where its consensus is unknown, from
    curated documents with nearly the same title key (all matches), then a second model, then
    a manual list; each step sees what the ones before it left; unresolved rows dropped."""
    t = table(spark, sf_dir, "documents").withColumn("title_clean", title_key("text"))
    known = (F.col("n_chars") % 3 > 0) & F.col("lang").isNotNull()
    base = t.where(F.col("source") != CURATED_SOURCE).select(
        "doc_id", "title_clean", F.when(known, F.col("lang")).otherwise("Unknown").alias("language")
    )
    curated = t.where(F.col("source") == CURATED_SOURCE).select(F.col("title_clean").alias("match_title"), F.col("lang").alias("found"))
    second = t.where(F.col("n_chars") % 5 > 0).select(
        F.col("doc_id").alias("other_id"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("Unknown").alias("found")
    )
    manual = t.where(F.col("source").isin(MANUAL_SOURCES)).select(F.col("doc_id").alias("other_id"), F.lit("en").alias("found"))

    def fuzzy(rest):
        sides = [materialize(side, "fuzzy") for side in (rest, curated)]  # the titles are folded once
        j = lk.fuzzy_join(*sides, "title_clean", "match_title", MAX_DIST, how="inner")
        return j.select("doc_id", F.col("found").alias("language"))

    def listed(source):
        return lambda rest: rest.join(source, F.col("doc_id") == F.col("other_id")).select("doc_id", F.col("found").alias("language"))

    steps = [("curated", fuzzy), ("second", listed(second)), ("manual", listed(manual))]
    w = lk.staged_waterfall(base, "doc_id", "language", steps, out_col="language_final")
    return w.select("doc_id", "language", "language_final", "resolved_by")


UNKNOWN_PRIORITY = ["4-NOT SPECIFIED", ""]
ORDER_SEQ = ["o_orderdate", "o_orderkey"]


def q_waterfall(spark, sf_dir):
    """Consensus -> second source -> manual list; unresolved dropped."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    mode_all = mode_first(orders, ["c_custkey"], "o_orderpriority", ORDER_SEQ, mode_col="priority")
    base = cust.join(mode_all, "c_custkey", "left").select(
        "c_custkey", "c_mktsegment",
        F.coalesce(sentinel_to("priority", UNKNOWN_PRIORITY, "Unknown"), F.lit("Unknown")).alias("priority"),
    )
    second = mode_first(
        orders.where(F.col("o_orderstatus") == "F"), ["c_custkey"], "o_orderpriority", ORDER_SEQ, mode_col="priority"
    ).select("c_custkey", sentinel_to("priority", UNKNOWN_PRIORITY, "Unknown").alias("priority"))
    # Fixed manual list of the stand-in: one segment coded by hand.
    manual = cust.where(F.col("c_mktsegment") == "AUTOMOBILE").select(
        "c_custkey", F.lit("3-MEDIUM").alias("priority")
    )
    w = lk.waterfall(base, "c_custkey", "priority", [("second", second), ("manual", manual)],
                     out_col="priority_final")
    return w.select("c_custkey", "priority", "priority_final", "resolved_by")


def q_waterfall_unresolved(spark, sf_dir):
    """K5: customers the waterfall could not resolve, with all their columns (the export
    for manual coding), restricted to customers that have orders."""
    cust = table(spark, sf_dir, "customer")
    resolved = q_waterfall(spark, sf_dir)
    with_orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lk.unresolved(cust, resolved, "c_custkey", restrict_to=with_orders)


# Fixed alias list of the stand-in (misspellings -> canonical name).
NAME_FIXES = {"NATOIN_3": "NATION_3", "NATOIN_7": "NATION_7"}
DROP_NAMES = ["", "Unknown land"]


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, free-text nation name) with spelling variants chosen by customer key."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    v = F.col("c_custkey") % 7
    raw = (
        F.when(v == 0, F.col("n_name"))
        .when(v == 1, F.lower("n_name"))
        .when(v == 2, F.regexp_replace("n_name", "_", " "))
        .when(v == 3, F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")))
        .when(v == 4, F.regexp_replace("n_name", "NATION", "NATOIN"))
        .when(v == 5, F.regexp_replace("n_name", "_", "-"))
        .otherwise(F.lit("Unknown land"))
    )
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left").select("c_custkey", raw.alias("raw_name"))


def q_conform_names(spark, sf_dir):
    """Trim, fix spellings, exact dictionary, then regex patterns on distinct
    unmatched names; unmappable rows dropped; region attached."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    dim = nation.select("n_name", F.col("n_nationkey").alias("n_code"))
    patterns = nation.select(
        F.col("n_nationkey").alias("n_code"),
        F.concat(F.lit("(?i)^nation[ _-]*"), F.col("n_nationkey").cast("string"), F.lit("$")).alias("pattern"),
    )
    c = lk.conform_names(
        raw_names(spark, sf_dir), "raw_name", dim, "n_name", "n_code", patterns,
        fixes=NAME_FIXES, drop_values=DROP_NAMES, code_col="n_code",
    )
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("n_code"), "r_name"
    )
    return c.join(geo, "n_code", "left").select("c_custkey", "raw_name", "n_code", "r_name")


QUERIES = {
    "title_key": q_title_key,
    "title_key_letters": q_title_key_letters,
    "fuzzy_titles": q_fuzzy_titles,
    "fuzzy_titles_blocked": q_fuzzy_titles_blocked,
    "fuzzy_subset": q_fuzzy_subset,
    "waterfall": q_waterfall,
    "waterfall_fuzzy": q_waterfall_fuzzy,
    "waterfall_unresolved": q_waterfall_unresolved,
    "conform_names": q_conform_names,
}

# Oracle: DuckDB's strip_accents folds the decomposable accents; the multi-letter and
# non-decomposable letters are replaced explicitly, as in the Spark expression.
_FOLD_SQL = "strip_accents(text)"
for _src, _dst in [
    ("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"),
    ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"),
    ("ł", "l"), ("Ł", "L"), ("þ", "th"), ("Þ", "TH"),
]:
    _FOLD_SQL = f"replace({_FOLD_SQL}, '{_src}', '{_dst}')"
_KEY_SQL = f"trim(regexp_replace(lower({_FOLD_SQL}), '[^\\p{{L}}\\p{{N}} ]+', '', 'g'))"

_TITLED = f"""
t AS (SELECT doc_id, source, lang, {_KEY_SQL} AS title_clean FROM documents),
l AS (SELECT doc_id, title_clean FROM t WHERE source <> '{CURATED_SOURCE}'),
r AS (SELECT doc_id AS match_doc_id, lang AS match_lang, title_clean AS match_title
      FROM t WHERE source = '{CURATED_SOURCE}'),
m AS (
  SELECT l.title_clean, r.match_title, levenshtein(l.title_clean, r.match_title) AS dist
  FROM (SELECT DISTINCT title_clean FROM l) l, (SELECT DISTINCT match_title FROM r) r
  WHERE abs(length(l.title_clean) - length(r.match_title)) <= {MAX_DIST}
    AND CASE WHEN abs(length(l.title_clean) - length(r.match_title)) <= {MAX_DIST}
             THEN levenshtein(l.title_clean, r.match_title) <= {MAX_DIST} ELSE false END)
"""

_FUZZY_SQL = "WITH " + _TITLED + """
SELECT l.doc_id, r.match_doc_id, r.match_lang, CAST(m.dist AS INTEGER) AS dist
FROM l LEFT JOIN m ON l.title_clean = m.title_clean
       LEFT JOIN r ON m.match_title = r.match_title"""

_MODE = """
SELECT c_custkey, priority FROM (
  SELECT c_custkey, o_orderpriority AS priority,
         row_number() OVER (PARTITION BY c_custkey ORDER BY cnt DESC, first_pos) AS rn
  FROM (SELECT c_custkey, o_orderpriority, count(*) AS cnt, min(pos) AS first_pos
        FROM {src} WHERE o_orderpriority IS NOT NULL GROUP BY c_custkey, o_orderpriority))
WHERE rn = 1"""

ORACLE = {
    "title_key": f"SELECT doc_id, {_KEY_SQL} AS title_clean FROM documents",
    "title_key_letters": f"""
WITH d AS (SELECT doc_id, translate(text, '{RARE_LETTERS[0]}', '{RARE_LETTERS[1]}') || ' Ĳsselmeer ĳs paraŀlel' AS raw FROM documents),
plain AS (SELECT doc_id, translate(replace(replace(raw, 'Ĳ', 'IJ'), 'ĳ', 'ij'), '{RARE_LETTERS[1]}ŀ', '{RARE_LETTERS[0]}l') AS text FROM d)
SELECT doc_id, {_KEY_SQL} AS title_clean FROM plain""",
    "fuzzy_titles": _FUZZY_SQL,
    "fuzzy_titles_blocked": _FUZZY_SQL,
    "waterfall_fuzzy": "WITH " + _TITLED + """,
b AS (
  SELECT d.doc_id, d.source, d.n_chars, d.lang, l.title_clean,
         CASE WHEN d.n_chars % 3 > 0 AND d.lang IS NOT NULL THEN d.lang ELSE 'Unknown' END AS language
  FROM documents d JOIN l USING (doc_id)),
s1 AS (
  SELECT b.*, r.match_lang AS f1
  FROM b LEFT JOIN (SELECT m.title_clean, r.match_lang FROM m JOIN r ON m.match_title = r.match_title) r
    ON b.title_clean = r.title_clean AND b.language = 'Unknown'),
s2 AS (
  SELECT *, CASE WHEN n_chars % 5 > 0 THEN CASE WHEN n_chars % 2 = 0 THEN lang ELSE 'Unknown' END END AS f2,
         CASE WHEN source IN ('src1', 'src2') THEN 'en' END AS f3
  FROM s1),
w AS (
  SELECT doc_id, language,
         CASE WHEN language <> 'Unknown' THEN language WHEN f1 <> 'Unknown' THEN f1 WHEN f2 <> 'Unknown' THEN f2 ELSE f3 END AS language_final,
         CASE WHEN language <> 'Unknown' THEN 'base' WHEN f1 <> 'Unknown' THEN 'curated' WHEN f2 <> 'Unknown' THEN 'second'
              WHEN f3 IS NOT NULL THEN 'manual' END AS resolved_by
  FROM s2)
SELECT * FROM w WHERE language_final IS NOT NULL""",
    "fuzzy_subset": "WITH " + _TITLED + """
SELECT doc_id FROM l WHERE title_clean IN (SELECT title_clean FROM m)""",
    "waterfall": f"""
WITH o AS (
  SELECT o_custkey AS c_custkey, o_orderpriority, o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos
  FROM orders),
of AS (
  SELECT o_custkey AS c_custkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos
  FROM orders WHERE o_orderstatus = 'F'),
m1 AS ({_MODE.format(src='o')}),
m2 AS ({_MODE.format(src='of')}),
b AS (
  SELECT c.c_custkey, c.c_mktsegment,
         coalesce(CASE WHEN m1.priority IN ('4-NOT SPECIFIED', '') THEN 'Unknown' ELSE m1.priority END,
                  'Unknown') AS priority,
         CASE WHEN m2.priority IN ('4-NOT SPECIFIED', '') THEN 'Unknown' ELSE m2.priority END AS p2,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN '3-MEDIUM' END AS p3
  FROM customer c LEFT JOIN m1 USING (c_custkey) LEFT JOIN m2 USING (c_custkey)),
w AS (
  SELECT c_custkey, priority,
         CASE WHEN priority <> 'Unknown' THEN priority
              WHEN p2 IS NOT NULL AND p2 <> 'Unknown' THEN p2
              WHEN p3 IS NOT NULL AND p3 <> 'Unknown' THEN p3 END AS priority_final,
         CASE WHEN priority <> 'Unknown' THEN 'base'
              WHEN p2 IS NOT NULL AND p2 <> 'Unknown' THEN 'second'
              WHEN p3 IS NOT NULL AND p3 <> 'Unknown' THEN 'manual' END AS resolved_by
  FROM b)
SELECT * FROM w WHERE priority_final IS NOT NULL""",
    "conform_names": """
WITH raw AS (
  SELECT c.c_custkey,
         CASE c.c_custkey % 7
           WHEN 0 THEN n.n_name
           WHEN 1 THEN lower(n.n_name)
           WHEN 2 THEN replace(n.n_name, '_', ' ')
           WHEN 3 THEN '  ' || n.n_name || ' '
           WHEN 4 THEN replace(n.n_name, 'NATION', 'NATOIN')
           WHEN 5 THEN replace(n.n_name, '_', '-')
           ELSE 'Unknown land' END AS raw_name
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
cl AS (
  SELECT c_custkey, raw_name,
         CASE regexp_replace(raw_name, '^\\s+|\\s+$', '', 'g')
           WHEN 'NATOIN_3' THEN 'NATION_3' WHEN 'NATOIN_7' THEN 'NATION_7'
           ELSE regexp_replace(raw_name, '^\\s+|\\s+$', '', 'g') END AS nm
  FROM raw),
kept AS (SELECT * FROM cl WHERE nm IS NULL OR nm NOT IN ('', 'Unknown land')),
names AS (SELECT DISTINCT nm FROM kept WHERE nm IS NOT NULL),
ex AS (
  SELECT names.nm, min(n.n_nationkey) AS code
  FROM names LEFT JOIN nation n ON lower(names.nm) = lower(n.n_name) GROUP BY names.nm),
rx AS (
  SELECT ex.nm, min(n.n_nationkey) AS rcode
  FROM ex JOIN nation n
    ON regexp_matches(ex.nm, '(?i)^nation[ _-]*' || CAST(n.n_nationkey AS VARCHAR) || '$')
  WHERE ex.code IS NULL GROUP BY ex.nm),
codes AS (SELECT ex.nm, coalesce(ex.code, rx.rcode) AS n_code FROM ex LEFT JOIN rx USING (nm))
SELECT k.c_custkey, k.raw_name, codes.n_code, r.r_name
FROM kept k JOIN codes ON k.nm = codes.nm
     LEFT JOIN nation n ON codes.n_code = n.n_nationkey
     LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE codes.n_code IS NOT NULL""",
}

_WF_BODY = ORACLE["waterfall"].rsplit("SELECT * FROM w WHERE priority_final IS NOT NULL", 1)[0]
ORACLE["waterfall_unresolved"] = _WF_BODY + """
SELECT c.* FROM customer c
WHERE c.c_custkey NOT IN (SELECT c_custkey FROM w WHERE priority_final IS NOT NULL)
  AND c.c_custkey IN (SELECT o_custkey FROM orders)"""
