"""The numbered queries of this subpackage and their SQL, for registration."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, fold, materialize, shared_folder, spread_join
from .divergence import source_divergence
from .filter_audit import filter_interactions
from .language_id import identify_languages
from .language_model import score_documents
from .mixing import mix_sources
from .neardup_vectors import linked_vectors
from .packing import pack_documents, token_counts
from .quality import quality_measures
from .shingle_join import jaccard_components
from .suffix_dedup import removed_bytes
from .token_rollup import TokenRollup
from .toxicity import score_toxicity
from .url_filters import PHRASES, RULES, judge_urls, rule_table

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    Also lowers the rows of an Arrow batch to BATCH_ROWS where the session has the default.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_rater_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="rater-py-"), os.path.basename(PACKAGE) + ".zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._rater_shipped = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard 0.85 of their 4-word shingles."""
    return jaccard_components(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents, learned from those whose id is not in fold 2 of 7."""
    docs = documents(spark, sf_dir)
    out = score_documents(docs, train=fold("doc_id", 7) != 2, deleted=fold("doc_id", 7) == 3)
    return out.withColumn("held_out", fold("doc_id", 7) == 2)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: direct links, component and keeper at cosine >= 0.9."""
    return linked_vectors(documents(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 at 150 % of the words, two epochs at most."""
    return mix_sources(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of all documents, learned from those whose id is not in fold 0 of 5."""
    out = identify_languages(documents(spark, sf_dir), learn_from=fold("doc_id", 5) != 0)
    return out.withColumn("held_out", fold("doc_id", 5) == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures and divergence verdict of every document."""
    return quality_measures(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of ids not in fold 0 of 5."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    out = score_toxicity(docs, labels, learn_from=fold("doc_id", 5) != 0)
    return out.withColumn("held_out", fold("doc_id", 5) == 0).withColumn("n_passages", F.size("passages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document under 100-byte strings that occurred earlier."""
    return removed_bytes(documents(spark, sf_dir))


WORD = r"[^\x20\x09-\x0D]+"
WORD_WITH_LETTER = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


def document_events(docs: DataFrame) -> list[DataFrame]:
    """Stand-in event batches made of the documents, in the schema that TokenRollup expects.

    First batch: every document's words under words-1. Second: revised counts where symbols
    alone are no longer words, and every document's token ids under word_bpe_49k. Third:
    deletes, under all versions, of the later ones of documents with equal text, each after an
    insert of the same batch that it undoes.
    """
    columns = docs.select(
        "doc_id", "source", "lang", "text",
        F.xxhash64("text").alias("h"), F.md5("text").alias("m"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        F.regexp_count("text", F.lit(WORD_WITH_LETTER)).cast("long").alias("revised"),
    )
    counts = materialize(token_counts(columns, tokenizer_path(), "text", "ids"), "counts")
    event = lambda df, op, version, n, seq=0: df.select(
        F.lit(op).alias("op"), "doc_id", "source", "lang",
        F.lit(version).cast("string").alias("tokenizer_version"), n.cast("long").alias("n_tokens"), F.lit(seq).cast("long").alias("seq"),
    )
    first = counts.where("m is not null").groupBy("h", "m").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"))
    later = spread_join(counts, first.where("n > 1").drop("n"), ["h", "m"], "doc_id").where("doc_id > kept")
    return [
        event(counts, "insert", "words-1", F.col("words")),
        event(counts.where("revised <> words"), "revise", "words-1", F.col("revised")).unionByName(
            event(counts, "insert", "word_bpe_49k", F.col("ids"))
        ),
        event(later, "insert", "words-2", F.col("words"), 1).unionByName(event(later, "delete", None, F.lit(None), 2)),
    ]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version, kept by three batches of signed
    deltas over all documents; the last two batches are delivered twice."""
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollups/{uuid.uuid4().hex}")
    batches = document_events(documents(spark, sf_dir))
    for number in (0, 1, 2, 1, 2):
        rollup.commit(number, batches[number])
    return rollup.totals()


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source, in all 120 orders."""
    return filter_interactions(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of a language, and the terms each source favours."""
    return source_divergence(documents(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by site rules first and pattern rules for the rest."""
    return judge_urls(documents(spark, sf_dir, "pages"), rule_table(spark, RULES)).drop("method_rule")


_QUERIES = (
    op1_ngram_jaccard_join,
    op2_lm_scoring,
    op3_embedding_near_dedup,
    op4_best_fit_packing,
    op5_mixing_sources,
    op6_language_id,
    op7_quality_rules,
    op8_toxicity,
    op9_suffix_array_dedup,
    op10_token_counts,
    op11_filter_interactions,
    op12_source_divergence,
    op13_url_filters,
)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        run.__doc__ = query.__doc__
        return run

    return {q.__name__: shipped(q) for q in _QUERIES}


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL
), edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT d.vec_id, coalesce(n, 0) AS n_links, least(d.vec_id, coalesce(m, d.vec_id)) AS component_id,
       d.vec_id = least(d.vec_id, coalesce(m, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN links ON links.a = d.vec_id LEFT JOIN comp ON comp.a = d.vec_id
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS draw
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM src
), weighted AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * size AS cap,
         1.5::DOUBLE * sum(size) OVER () AS budget
  FROM ranked
), level AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / w, r)
), clamp AS (
  SELECT *, (budget - cap_before)::DOUBLE * w / w_left >= cap AS capped FROM level
), targets AS (
  SELECT source, size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * w
      / sum(w) FILTER (NOT capped) OVER () END AS target
  FROM clamp
), run AS (
  SELECT s.doc_id, s.size, t.size AS source_size, t.target, floor(t.target)::BIGINT AS need,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (need // source_size) * size
    + greatest(0, least(size, need % source_size - before)) END::BIGINT AS taken
FROM run
"""


OP11_SQL = r"""
WITH t AS (
  SELECT coalesce(CAST(source AS VARCHAR), '') AS part, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), flags AS (
  SELECT w.part, w.doc_id,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask,
    coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l
    ON w.doc_id = l.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(regexp_replace('ABCDE', '[^' || a.x || b.x || c.x || d.x || e.x || ']', '', 'g')) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS f,
    coalesce(list_sum([1 << (ascii(y) - 65) FOR y IN string_split(substr(filter_order, 1, step - 1), '') IF y <> '']), 0)::BIGINT AS earlier
  FROM orders, range(1, 6) r(step)
), base AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER ((mask & (earlier | f)) = 0) AS kept,
    sum(n) FILTER ((mask & f) > 0 AND (mask & earlier) = 0) AS removed,
    sum(n) FILTER ((mask & f) > 0 AND (mask & earlier) > 0) AS redundant,
    sum(n) FILTER (mask = f) AS unique_fails,
    sum(good) FILTER ((mask & f) > 0 AND (mask & earlier) = 0) AS good_lost,
    sum(toxic) FILTER ((mask & f) > 0 AND (mask & earlier) = 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM base
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
    unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
), terms AS (
  SELECT lang, source, k, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), vocab AS (
  SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), groups AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n, v.total,
    sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS gn,
    sum(v.total) OVER (PARTITION BY g.lang, g.source) AS ln,
    count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM groups g JOIN vocab v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (gn + 5 * v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (total + 5) // (ln + 5 * v)::HUGEINT AS q
  FROM cells
), diffs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN diffs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT,
    (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, encode(term)))::INT FROM shares WHERE n > 0 AND p > q
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), fit AS (
  SELECT *, '.' || host AS h, CASE
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split
), phrases AS (
  SELECT *, 'i' AS o, '(^|[^a-z0-9])(PHRASES)([^a-z0-9]|$)' AS p FROM fit
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(lower(host || path), p) OR regexp_matches(lower(host || path), ';jsessionid=')
    OR regexp_matches(host || path, '^([0-9]{1,3}\.){3}[0-9]{1,3}(:[0-9]+)?(/|$)')
    OR regexp_matches(lower(host || path), '/[^/]+\.(exe|apk|msi|dmg)$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM phrases
""".replace("PHRASES", "|".join(PHRASES))


def llm_oracles() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": OP3_SQL,
        "op5_mixing_sources": OP5_SQL,
        "op11_filter_interactions": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
        "op13_url_filters": OP13_SQL,
    }
