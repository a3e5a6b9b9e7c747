"""Readers and writers.

* R-style CSV (``read.csv`` / ``read.csv2``): fixed schema, no inference; the text
  ``NA`` is missing; in string columns a blank stays ``''`` (a blank answer is a vote),
  in numeric columns a blank is missing. Numbers are parsed with ``try_cast`` so a
  stray text never fails the job.
* JSON-lines requests (write) and responses (read) of the model round trip.
* Table sink: Parquet by default, optionally partitioned (one file set per model).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterspark.session import shared_folder


def r_name(header: str) -> str:
    """A header as R's ``make.names`` spells it: other characters become dots, and a name
    that does not begin with a letter or a dot gets an X in front."""
    name = re.sub(r"[^\w.]", ".", header)
    return name if re.match(r"[^\W\d_]|\.(?!\d)", name) else f"X{name}"


def _r_value(text: Column, field: T.StructField, decimal: str, blank_as_null: bool) -> Column:
    """A CSV field as text -> typed value under R's missing-value rule."""
    if isinstance(field.dataType, T.StringType):
        blank = F.lit(None) if blank_as_null else F.lit("")
        value = F.when(text == F.lit("NA"), F.lit(None)).when(text.isNull() | (text == F.lit("")), blank).otherwise(text)
    else:
        number = F.trim(text)
        if decimal != ".":
            number = F.regexp_replace(number, re.escape(decimal), ".")
        # 'NA', blank and any other non-number -> NULL.
        value = number.try_cast(field.dataType)
    return value.alias(field.name)


def _header_map(headers: Sequence[str], schema: T.StructType) -> dict[str, str]:
    """Header for each schema name, which is the header or R's spelling of it."""
    by_name: dict[str, str] = {}
    for header in headers:
        plain = header.lstrip("\ufeff")
        for name in (plain, r_name(plain)):
            by_name.setdefault(name, header)
    missing = [f.name for f in schema.fields if f.name not in by_name]
    if missing:
        raise ValueError(f"no header named {missing} among {list(headers)}")
    return by_name


def read_r_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    sep: str = ",",
    decimal: str = ".",
    source_col: str | None = None,
    blank_as_null: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header, read as strings and typed by ``schema`` (R missing-value rule).

    Columns are taken by header name, in any order: a schema name matches a header as it
    stands or as R spells it (``Income group`` -> ``Income.group``, ``2015`` -> ``X2015``).
    A name that no header has is an error. A file whose quoted fields hold line breaks is read
    by one task, any other is split; which it is, is found out by a pass over the lines (a
    record spans lines only where one has an odd number of quotes) unless ``multi_line`` says.

    ``blank_as_null=True`` reads a blank string field as NULL (the pandas reader's rule)
    instead of ''.

    ``source_col`` adds the input file name, so files of several models (one per model)
    are read in one scan and grouped by a column instead of looped over.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = (
        spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("nullValue", "\u0000NA\u0000").option("emptyValue", "")
        .csv(path)
    )
    by_name = _header_map(raw.columns, schema)
    out = raw.select(*[_r_value(raw[f"`{by_name[f.name]}`"], f, decimal, blank_as_null) for f in schema.fields])
    if source_col:
        out = out.withColumn(source_col, F.input_file_name())
    return out


def parse_r_csv(
    df: DataFrame,
    col: str,
    header: Sequence[str],
    schema: T.StructType,
    sep: str = ",",
    decimal: str = ".",
    blank_as_null: bool = False,
    corrupt_col: str = "corrupt_record",
) -> DataFrame:
    """CSV records held in a text column, typed by the rules of :func:`read_r_csv`.

    ``header`` names the fields of a record in their order. A record with too few or too many
    fields keeps its text in ``corrupt_col`` and has NULL in all others; the other columns of
    ``df`` stay.
    """
    by_name = _header_map(header, schema)
    fields = [T.StructField(f"f{k}", T.StringType()) for k in range(len(header))]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "nullValue": "\u0000NA\u0000"}
    rec = F.from_csv(F.col(col), T.StructType([*fields, T.StructField("_bad", T.StringType())]).simpleString()[7:-1].replace(":", " "), options)
    rest = [c for c in df.columns if c != col]
    read = df.select(*rest, rec.alias("_rec"))
    good = F.col("_rec._bad").isNull()
    position = {name: k for k, name in enumerate(header)}
    values = [
        F.when(good, _r_value(F.col(f"_rec.f{position[by_name[f.name]]}"), f, decimal, blank_as_null)).alias(f.name) for f in schema.fields
    ]
    return read.select(*rest, *values, F.col("_rec._bad").alias(corrupt_col))


def model_from_path(path_col: str = "source_file", pattern: str = r"_([^_/]+)\.csv$") -> Column:
    """Model name taken from a per-model file name (``classification_<model>.csv``), so
    one scan over all models' files can be grouped by model."""
    return F.regexp_extract(F.col(path_col), pattern, 1)


def read_response_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON-lines response files as one ``value`` text column per line (parsed later
    with a fixed schema, so one malformed line cannot change the inferred schema)."""
    return spark.read.text(path)


def write_requests(requests: DataFrame, path: str, col: str = "request") -> None:
    """One JSON request per line."""
    requests.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table. CSV output gets a header and no row names."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_models(df: DataFrame, path: str, model_col: str = "model", fmt: str = "parquet") -> None:
    """Overwrite the tables of the models that ``df`` has rows of, and no others.

    Every model is a partition directory. A model counts once its marker is written, which
    comes last, so a failed first write is not read, and writing a model again replaces it.
    """
    for data, folder in ((df, "data"), (df.select(model_col).distinct().withColumn("written", F.lit(True)), "written")):
        w = data.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(model_col)
        (w.option("header", True) if fmt == "csv" and folder == "data" else w).format(fmt if folder == "data" else "parquet").save(f"{path}/{folder}")


def read_models(spark: SparkSession, path: str, schema: T.StructType, model_col: str = "model", fmt: str = "parquet") -> DataFrame:
    """All models of :func:`write_models` that have their marker, in one scan."""
    text = T.StructField(model_col, T.StringType())
    rest = T.StructType([f for f in schema.fields if f.name != model_col] + [text])
    data = spark.read.schema(rest).option("header", True).format(fmt).load(f"{path}/data")
    written = spark.read.schema(T.StructType([T.StructField("written", T.BooleanType()), text])).parquet(f"{path}/written")
    return data.join(written.select(model_col), model_col, "left_semi").select(*[f.name for f in schema.fields])


def review_sink(ids: DataFrame, path: str) -> None:
    """Review list (item, reason) as a table."""
    write_table(ids, path)


def run_folder(spark: SparkSession) -> str:
    """This application's own folder under the shared one; nothing else writes there, so it
    can be deleted when the application has ended."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage's output as Parquet to a fresh table in the run folder and return it
    read back: later stages (several summaries over the same fact table) start from the
    written table instead of recomputing its lineage, and the table survives executor loss.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path, partition_by=partition_by)
    return spark.read.schema(df.schema).parquet(path)
