"""Request build and response ingest queries.

Stand-ins:

* requests: every document; title = first line, abstract = the rest; the three keyword
  fields are (blank for German documents, else missing), (language, blank for English
  ones) and (source): the first non-blank one is appended.
* responses: one response line per conversation turn, custom_id = conversation id,
  choice index = turn. Assistant turns end with a JSON answer naming the first word of
  the turn, user turns with a single-quoted answer naming the role, system turns have
  no answer at all. Responses with nested answers (:func:`nested_response_lines`) hold nested
  braces, braces and apostrophes in quotes, Python literals, a missing label, a stray brace,
  records without choices and lines that are no JSON. The lines are JSON text built with ``to_json`` and go through the
  same parser as files read with :func:`raterspark.sources.io.read_response_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.functions.text import after_first_line, compose_text, first_line, json_key
from raterspark.operators import requests as rq
from raterspark.plans.common import table

# Fixed values of the stand-in request.
MODEL = "model-a"
SYSTEM_PROMPT = "You review research papers."
USER_TEMPLATE = "Title, abstract and keywords of a paper:\n```{text}```\nAnswer with a JSON object {\"label\": [...]}."


def _composed(docs: DataFrame):
    kw1 = F.when(F.col("lang") == "de", F.lit(""))
    kw2 = F.when(F.col("lang") == "en", F.lit("  ")).otherwise(F.col("lang"))
    return compose_text(first_line("text"), after_first_line("text"), kw1, kw2, F.col("source"))


def q_build_requests(spark, sf_dir):
    """One JSON request per document, parsed back into fields."""
    docs = table(spark, sf_dir, "documents")
    reqs = rq.build_requests(docs, "doc_id", _composed(docs), MODEL, SYSTEM_PROMPT, USER_TEMPLATE)
    return rq.parse_requests(reqs)


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON response line (``value``) per conversation turn."""
    conv = table(spark, sf_dir, "conversations")
    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), '", "')
    answer = (
        F.when(F.col("role") == "assistant",
               F.concat(F.col("text"), F.lit('\noutput_json\n{"label": ["'), words, F.lit('"]}')))
        .when(F.col("role") == "user", F.concat(F.col("text"), F.lit(" {'label': '"), F.col("role"), F.lit("'}")))
        .otherwise(F.col("text"))
    )
    return conv.select(F.to_json(_record(answer)).alias("value"))


def nested_response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like :func:`response_lines`, with answers that name all words of the turn."""
    conv = table(spark, sf_dir, "conversations")
    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), '", "')
    case = (F.col("conv_id") + F.col("turn")) % 6
    tail = (
        F.when(case == 0, F.concat(F.lit(" It's settled: {\"meta\": {\"n\": 1}, \"label\": [\""), words, F.lit('"]}')))
        .when(case == 1, F.concat(F.lit(' {"note": "a } b { c", "label": ["'), words, F.lit('"]} {"label": "second"}')))
        .when(case == 2, F.lit(" {'label': ['first', None, 'last',]}"))
        .when(case == 3, F.lit(' {"label": null}'))
        .when(case == 4, F.lit(" no block }"))
        .otherwise(F.lit(' {"note": "it\'s", "label": "single"}'))
    )
    failed = F.col("conv_id") % 7 == 5
    rec = _record(F.concat(F.col("text"), tail), failed)
    line = F.when(F.col("conv_id") % 7 == 3, F.lit("upstream error")).otherwise(F.to_json(rec))
    return conv.select(line.alias("value"))


def _record(answer: Column, failed: Column | None = None) -> Column:
    """A response record with one choice, or with none where ``failed``."""
    choices = F.array(F.struct(F.col("turn").cast("int").alias("index"),
                               F.struct(answer.alias("content")).alias("message")))
    return F.struct(
        F.concat(F.lit("req_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("custom_id"),
        F.struct(F.struct(
            F.lit(MODEL).alias("model"), F.col("turn").alias("created"),
            (choices if failed is None else F.when(~failed, choices)).alias("choices"),
        ).alias("body")).alias("response"),
    )


def q_ingest_responses(spark, sf_dir):
    """Response lines -> choices -> first {...} block -> 'label' -> cleaned."""
    ing = rq.ingest_responses(response_lines(spark, sf_dir), "label")
    return ing.select("custom_id", "choice_index", "label_clean", "model", "parse_status")


def q_ingest_responses_balanced(spark, sf_dir):
    """Nested answers through the balanced-brace block and name cleaning; records
    without choices and lines that are no JSON keep a row with a status."""
    ing = rq.ingest_responses(
        nested_response_lines(spark, sf_dir), "label", block="balanced", missing_key_text="", clean="name_chars"
    )
    return ing.select("custom_id", "choice_index", "label_clean", "model", "parse_status")


RESPONSE_CLASSES = {"count_user": "user", "count_blank": ""}


def q_response_votes(spark, sf_dir):
    """C30 -> C1: ingested answers voted per conversation (first-seen mode by choice
    index, class counts, normalised Gini over the two classes)."""
    from raterspark.operators import consensus

    ing = rq.answered(rq.ingest_responses(response_lines(spark, sf_dir), "label"))
    s = consensus.vote_summary(ing, "custom_id", "label_clean", RESPONSE_CLASSES, ["choice_index"])
    return s.select("custom_id", "label_mode", *RESPONSE_CLASSES, F.round("gini_norm", 6).alias("gini_norm"))


def q_json_props(spark, sf_dir):
    """one key of a JSON text column."""
    ev = table(spark, sf_dir, "events")
    found = ev.select("event_id", json_key(F.col("props"), "k").alias("_k"))
    return found.select("event_id", F.col("_k.value").try_cast("int").alias("k"), F.col("_k.status").alias("parse_status"))


QUERIES = {
    "build_requests": q_build_requests,
    "ingest_responses": q_ingest_responses,
    "ingest_responses_balanced": q_ingest_responses_balanced,
    "response_votes": q_response_votes,
    "json_props": q_json_props,
}

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _kw(x: str) -> str:
    return f"({x} IS NOT NULL AND {_TRIM.format(x=x)} <> '')"


_PREFIX, _, _SUFFIX = USER_TEMPLATE.partition("{text}")

ORACLE = {
    "build_requests": f"""
WITH d AS (
  SELECT doc_id, source, lang,
         regexp_extract(text, '^([^\\n]*)', 1) AS title,
         regexp_extract(text, '(?s)^[^\\n]*\\n(.*)$', 1) AS abstract,
         CASE WHEN lang = 'de' THEN '' END AS kw1,
         CASE WHEN lang = 'en' THEN '  ' ELSE lang END AS kw2,
         source AS kw3
  FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url,
       '{MODEL}' AS model, 5 AS n, 1 AS temperature, 'medium' AS reasoning_effort,
       800 AS max_completion_tokens, 2 AS n_messages, '{SYSTEM_PROMPT}' AS system_content,
       {"'" + _PREFIX.replace("'", "''") + "'"} ||
       coalesce(title, '') || ' ' || coalesce(abstract, '') ||
       coalesce(CASE WHEN {_kw('kw1')} THEN ' ' || kw1 WHEN {_kw('kw2')} THEN ' ' || kw2
                     WHEN {_kw('kw3')} THEN ' ' || kw3 END, '') ||
       {"'" + _SUFFIX.replace("'", "''") + "'"} AS user_content
FROM d""",
    "ingest_responses": """
WITH c AS (
  SELECT CAST(conv_id AS VARCHAR) AS custom_id, CAST(turn AS INTEGER) AS choice_index,
         CASE WHEN role = 'assistant'
                THEN text || chr(10) || 'output_json' || chr(10) || '{"label": ["' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), '", "') || '"]}'
              WHEN role = 'user' THEN text || ' {''label'': ''' || role || '''}'
              ELSE text END AS content
  FROM conversations),
b AS (SELECT *, nullif(regexp_extract(content, '(?s)\\{.*?\\}', 0), '') AS blk FROM c),
j AS (SELECT *, CAST(replace(blk, '''', '"') AS JSON) AS js FROM b),
v AS (
  SELECT *, CASE WHEN blk IS NULL THEN NULL
                 WHEN json_type(js, '$.label') = 'ARRAY' THEN array_to_string(CAST(json_extract_string(js, '$.label[*]') AS VARCHAR[]), ', ')
                 ELSE json_extract_string(js, '$.label') END AS val
  FROM j)
SELECT custom_id, choice_index,
       regexp_replace(CASE WHEN blk IS NULL THEN '' WHEN val IS NULL THEN 'None' ELSE val END, '[\\[\\]''"]', '', 'g') AS label_clean,
       'model-a' AS model,
       CASE WHEN blk IS NULL THEN 'no_block' WHEN val IS NULL THEN 'no_key' ELSE 'ok' END AS parse_status
FROM v""",
    "json_props": """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CASE WHEN props IS NULL THEN 'no_block' WHEN json_extract_string(props, '$.k') IS NULL THEN 'no_key'
            ELSE 'ok' END AS parse_status
FROM events""",
}

ORACLE["ingest_responses_balanced"] = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, conv_id % 7 AS kind,
         text || CASE (conv_id + turn) % 6
           WHEN 0 THEN ' It''s settled: {"meta": {"n": 1}, "label": ["' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), '", "') || '"]}'
           WHEN 1 THEN ' {"note": "a } b { c", "label": ["' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), '", "') || '"]} {"label": "second"}'
           WHEN 2 THEN ' {''label'': [''first'', None, ''last'',]}'
           WHEN 3 THEN ' {"label": null}'
           WHEN 4 THEN ' no block }'
           ELSE ' {"note": "it''s", "label": "single"}' END AS content
  FROM conversations),
f AS (
  SELECT row_number() OVER () AS row_id, kind, conv_id, turn, content, 1 AS i, 0 AS depth, '' AS quote, 0 AS start, 0 AS stop,
         regexp_extract_all(content, '(?s)\\\\.|[''"{}]|[^\\\\''"{}]+|\\\\') AS ps, 0 AS pos
  FROM c
  UNION ALL
  SELECT row_id, kind, conv_id, turn, content, i + 1,
         depth + CAST(quote = '' AND x = '{' AS INTEGER) - CAST(quote = '' AND x = '}' AND depth > 0 AS INTEGER),
         CASE WHEN quote = '' AND depth > 0 AND x IN ('''', '"') THEN x WHEN quote = x THEN '' ELSE quote END,
         CASE WHEN quote = '' AND x = '{' AND depth = 0 THEN pos + 1 ELSE start END,
         CASE WHEN quote = '' AND x = '}' AND depth = 1 THEN pos + 1 ELSE 0 END,
         ps, CAST(pos + length(x) AS INTEGER)
  FROM (SELECT *, ps[i] AS x FROM f WHERE i <= len(ps) AND stop = 0)),
e AS (
  SELECT kind, conv_id, turn, CASE WHEN max(stop) > 0 THEN substr(any_value(content), arg_max(start, stop), max(stop) - arg_max(start, stop) + 1) END AS blk
  FROM f GROUP BY row_id, kind, conv_id, turn),
j AS (
  SELECT *, CAST(CASE WHEN blk IS NULL OR json_valid(blk) THEN blk
                      ELSE replace(replace(replace(blk, '''', '"'), 'None', 'null'), ',]', ']') END AS JSON) AS js FROM e),
v AS (
  SELECT *, CASE WHEN json_type(js, '$.label') = 'ARRAY'
                   THEN array_to_string(list_transform(CAST(json_extract_string(js, '$.label[*]') AS VARCHAR[]), lambda x: coalesce(x, 'None')), ', ')
                 ELSE json_extract_string(js, '$.label') END AS val
  FROM j)
SELECT CASE WHEN kind <> 3 THEN CAST(conv_id AS VARCHAR) END AS custom_id,
       CASE WHEN kind NOT IN (3, 5) THEN CAST(turn AS INTEGER) END AS choice_index,
       CASE WHEN kind NOT IN (3, 5) THEN regexp_replace(coalesce(val, ''), '[^A-Za-zÀ-ÿ ,-]', '', 'g') END AS label_clean,
       CASE WHEN kind <> 3 THEN 'model-a' END AS model,
       CASE WHEN kind = 3 THEN 'malformed' WHEN kind = 5 THEN 'no_choices' WHEN blk IS NULL THEN 'no_block'
            WHEN val IS NULL THEN 'no_key' ELSE 'ok' END AS parse_status
FROM v"""

_INGEST_BODY = ORACLE["ingest_responses"].rsplit("SELECT custom_id, choice_index,", 1)[0]
ORACLE["response_votes"] = _INGEST_BODY + """,
lab AS (
  SELECT custom_id, choice_index,
         regexp_replace(CASE WHEN blk IS NULL THEN '' WHEN val IS NULL THEN 'None' ELSE val END,
                        '[\\[\\]''"]', '', 'g') AS label
  FROM v),
pv AS (
  SELECT custom_id, label, count(*) AS cnt, min(choice_index) AS first_pos
  FROM lab WHERE label IS NOT NULL GROUP BY custom_id, label),
m AS (
  SELECT custom_id, label AS label_mode FROM (
    SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY cnt DESC, first_pos) AS rn FROM pv)
  WHERE rn = 1),
cnt AS (
  SELECT custom_id,
         CAST(count(*) FILTER (WHERE label = 'user') AS BIGINT) AS count_user,
         CAST(count(*) FILTER (WHERE label = '') AS BIGINT) AS count_blank
  FROM lab GROUP BY custom_id)
SELECT m.custom_id, m.label_mode, k.count_user, k.count_blank,
       round(CASE WHEN k.count_user + k.count_blank > 0 THEN
         (1 - ((k.count_user / (k.count_user + k.count_blank)) * (k.count_user / (k.count_user + k.count_blank))
             + (k.count_blank / (k.count_user + k.count_blank)) * (k.count_blank / (k.count_user + k.count_blank))))
         / (1 - 1.0 / 2) END, 6) AS gini_norm
FROM m JOIN cnt k USING (custom_id)"""
