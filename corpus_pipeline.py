"""Training-corpus pipeline: filter, de-duplicate, mix and pack a table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.llm._common import documents, materialize
from raterspark.llm.mixing import mix_sources
from raterspark.llm.packing import pack_documents
from raterspark.llm.quality import quality_measures
from raterspark.llm.queries import WORD, ship, tokenizer_path
from raterspark.llm.shingle_join import jaccard_components, one_per_component
from raterspark.llm.suffix_dedup import removed_bytes

#: SQL cannot express the stages (divergence verdicts, 100-byte strings, tokenizer ids);
#: tests/llm checks them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Null and empty texts go (they have under ten words); null ids and repeated rows are judged
    like others; texts of any length are read whole; other columns come along whatever their
    names; an empty table stays empty.
    """
    ship(spark)
    judged = quality_measures(_with_row(docs, "doc_id", "text", "lang"), carry=(ROW,))
    return judged.where("kept").select(f"{ROW}.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component at Jaccard 0.8 of 5-word shingles.

    The one with the smallest id stays, of its rows with this text one. Rows without a shingle
    (null, empty and wordless texts) and rows with a null id all stay; rows that share an id
    but no near text are documents of their own. Texts of any length are read whole; other
    columns come along whatever their names; an empty table stays empty.
    """
    ship(spark)
    return one_per_component(docs, width=5, num=80).select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes under 100-byte strings that occurred earlier; every document stays.

    Null texts become empty; of equal texts the one of the smallest id (null first) stays
    whole, and repeated rows count as later ones. Texts of any length are read whole; other
    columns come along whatever their names; an empty table stays empty.
    """
    ship(spark)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = removed_bytes(_with_row(docs, "doc_id", "text", row=rest), keep_text=True, carry=(ROW,))
    return _with_text(out.select(f"{ROW}.*", F.col("kept_text").alias("text")), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, a fractional time as its first words.

    Documents of which the mix takes no word go, so null, empty and wordless texts do. A null
    source is a source; rows of equal id share a draw and are taken in turn. Texts of any
    length are read whole; other columns come along whatever their names; an empty table
    stays empty.
    """
    ship(spark)
    rest = [c for c in docs.columns if c != "n_chars"]
    mixed = mix_sources(_with_row(docs, "doc_id", "text", "source", row=rest), carry=(ROW,)).where("taken > 0")
    last = F.ceil(F.col("taken") / F.col("size")).cast("long") - 1
    repeated = mixed.select(ROW, "taken", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("turn"))
    left = F.col("taken") - F.col("turn") * F.col("size")
    whole = F.col(f"{ROW}.text")
    words = F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), 1, left.cast("int"))
    text = F.when(left >= F.col("size"), whole).otherwise(F.array_join(words, " "))
    rest.remove("text")
    return _with_text(repeated.select(*[F.col(f"{ROW}.{c}") for c in rest], text.alias("text")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens.

    A null or empty text is its end token; repeated rows and null ids are packed like others;
    longer texts are cut; other columns are not read; an empty table gives no piece.
    """
    ship(spark)
    return pack_documents(docs, tokenizer_path())


#: A document's own columns travel through an operator as one struct of this name.
ROW = "__document"


def _with_row(docs: DataFrame, *needed: str, row: list[str] | None = None) -> DataFrame:
    """The columns an operator reads, and those to keep as one struct, so that no name can clash."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in row or docs.columns]).alias(ROW))


def _with_text(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars being that of the present text."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length).select(*docs.columns)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
