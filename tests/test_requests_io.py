import json
import os
import tempfile

from conftest import rows
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterspark.functions.text import compose_text
from raterspark.operators import requests as rq
from raterspark.sources import io


def test_build_and_parse_requests(spark):
    docs = spark.createDataFrame([(7, "Title", "Abstract", None, "kw")], "ID int, t string, a string, k1 string, k2 string")
    reqs = rq.build_requests(docs, "ID", compose_text("t", "a", "k1", "k2"), "m", "sys", "Paper: {text} end", n=3)
    rec = json.loads(reqs.collect()[0].request)
    assert rec["custom_id"] == "7" and rec["body"]["n"] == 3
    assert rec["body"]["messages"][1]["content"] == "Paper: Title Abstract kw end"
    back = rq.parse_requests(reqs).collect()[0]
    assert back.user_content == "Paper: Title Abstract kw end" and back.n_messages == 2


def _line(cid, contents):
    return json.dumps({
        "id": f"r{cid}", "custom_id": str(cid),
        "response": {"body": {"model": "m", "created": 1,
                              "choices": [{"index": i, "message": {"content": c}} for i, c in enumerate(contents)]}},
    })


def test_ingest_variants_and_status(spark):
    lines = [
        _line(1, ['Reason.\noutput_json\n{"inclusion": ["included"]}', "no json", '{"other": 1}']),
        _line(2, ["study's answer {'countries': ['France', 'Spain',]}"]),
        "not json at all",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    reg = rows(rq.ingest_responses(df, "inclusion"), "custom_id", "choice_index", "label_clean", "parse_status")
    assert reg[:4] == [
        (None, None, None, "malformed"), ("1", 0, "included", "ok"), ("1", 1, "", "no_block"), ("1", 2, "None", "no_key"),
    ]
    bal = rq.ingest_responses(df, "countries", block="balanced", missing_key_text="", clean="name_chars")
    got = {(r.custom_id, r.choice_index): (r.label_clean, r.parse_status) for r in bal.collect()}
    assert got[("2", 0)] == ("France, Spain", "ok")


def test_lines_without_choices_keep_a_row(spark):
    failed = json.dumps({"id": "r9", "custom_id": "9", "response": {"body": {"model": "m", "created": 1, "choices": None}}})
    df = spark.createDataFrame([(failed,), ("{broken",), (_line(1, ["x"]),)], "value string")
    flat = {(r.custom_id, r.record_status): r.raw for r in rq.flatten_responses(df).collect()}
    assert flat == {("9", "no_choices"): failed, (None, "malformed"): "{broken", ("1", "ok"): None}
    out = rq.ingest_responses(df, "a")
    assert out.count() == 3 and [r.custom_id for r in rq.answered(out).collect()] == ["1"]


def test_read_r_csv_by_header_name(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("b,Income group,2015,a\n1,High,2.5,x\n2,Low,NA,y\n")
    fields = [("a", T.StringType()), ("X2015", T.DoubleType()), ("Income.group", T.StringType()), ("b", T.IntegerType())]
    for multi in (True, False):
        out = io.read_r_csv(spark, p, T.StructType([T.StructField(*x) for x in fields]), multi_line=multi)
        assert out.columns == [x for x, _ in fields]
        assert sorted(map(tuple, out.collect())) == [("x", 2.5, "High", 1), ("y", None, "Low", 2)]
    with pytest.raises(ValueError, match="missing"):
        io.read_r_csv(spark, p, T.StructType([T.StructField("missing", T.StringType())]))


def test_read_r_csv_missing_rules(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿ID;label;score\n1;;NA\n2;NA;3,5\n3;x;\n")
    schema = T.StructType([T.StructField("ID", T.IntegerType()), T.StructField("label", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    out = rows(io.read_r_csv(spark, p, schema, sep=";", decimal=","))
    assert out == [(1, "", None), (2, None, 3.5), (3, "x", None)]


def test_write_requests_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="req-", dir="/tmp")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "ID int, t string")
    reqs = rq.build_requests(docs, "ID", F.col("t"), "m", "s", "{text}")
    io.write_requests(reqs, os.path.join(d, "out"))
    back = spark.read.text(os.path.join(d, "out"))
    assert sorted(json.loads(r.value)["custom_id"] for r in back.collect()) == ["1", "2"]


def test_read_csv_blank_as_null(spark):
    d = tempfile.mkdtemp(prefix="csv2-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("ID,label\n1,\n2,x\n")
    schema = T.StructType([T.StructField("ID", T.IntegerType()), T.StructField("label", T.StringType())])
    assert rows(io.read_r_csv(spark, p, schema, blank_as_null=True)) == [(1, None), (2, "x")]


def test_multi_model_single_scan_and_csv_sink(spark):
    from raterspark.operators import consensus as cs

    d = tempfile.mkdtemp(prefix="models-", dir="/tmp")
    for model, labels in {"m1": ["included", "included", "excluded"], "m2": ["excluded", "", "excluded"]}.items():
        with open(os.path.join(d, f"inclusion_{model}.csv"), "w", encoding="utf-8") as f:
            f.write("custom_id,choice_index,label\n")
            for i, lab in enumerate(labels):
                f.write(f"7,{i},{lab}\n")
    schema = T.StructType([T.StructField("custom_id", T.IntegerType()), T.StructField("choice_index", T.IntegerType()),
                           T.StructField("label", T.StringType())])
    df = io.read_r_csv(spark, os.path.join(d, "inclusion_*.csv"), schema, source_col="source_file")
    df = df.withColumn("model", io.model_from_path("source_file"))
    votes = cs.vote_summary(df.withColumn("item", F.concat_ws(":", "model", "custom_id")), "item", "label",
                            {"count_excluded": "excluded", "count_included": "included", "count_blank": ""},
                            ["choice_index"])
    got = {r.item: (r.label_mode, r.count_blank) for r in votes.collect()}
    assert got == {"m1:7": ("included", 0), "m2:7": ("excluded", 1)}
    out = os.path.join(d, "out_csv")
    io.write_table(votes, out, fmt="csv")
    assert spark.read.option("header", True).csv(out).count() == 2


def test_materialize_to_shared_folder(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    back = io.materialize(df, "stage_test")
    assert sorted(r.id for r in back.collect()) == [1, 2]
    assert spark.conf.get("spark.checkpoint.dir") in back.inputFiles()[0]


def test_an_answer_is_read_once(spark):
    """One fold, one block and few parses a row, however often the value is named."""
    lines = spark.createDataFrame([('{"custom_id": "a"}',)], "value string")
    for block in ("balanced", "regex"):
        out = rq.ingest_responses(lines, "label", block=block, clean="name_chars")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") == (1 if block == "balanced" else 0)
        assert plan.count("from_json(") <= 4  # the record, a scalar, a list, the reason for no value


def test_csv_records_in_a_column(spark):
    schema = T.StructType([T.StructField("Income.group", T.StringType()), T.StructField("X2015", T.DoubleType())])
    lines = ['"low, ""mid""","1,5"', "NA,2", ",NA", "a,b,c", "only", "x,-3", None, '"open,1']
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "id int, line string")
    out = {r.id: (r["Income.group"], r.X2015, r.corrupt_record) for r in io.parse_r_csv(df, "line", ["Income group", "2015"], schema, decimal=",").collect()}
    assert out[0] == ('low, "mid"', 1.5, None) and out[1] == (None, 2.0, None) and out[2] == ("", None, None) and out[5] == ("x", -3.0, None)
    assert out[3] == (None, None, "a,b,c") and out[4] == (None, None, "only") and out[7][2] == '"open,1'
    with pytest.raises(ValueError):
        io.parse_r_csv(df, "line", ["a", "b"], schema)


def test_models_written_again_replace_themselves_only(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("model", T.StringType()), T.StructField("v", T.StringType())])
    path = tempfile.mkdtemp(prefix="models-", dir="/tmp") + "/t"
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None)], schema)
    io.write_models(first, path)
    io.write_models(first, path)  # the same batch again
    assert rows(io.read_models(spark, path, schema)) == rows(first)
    io.write_models(spark.createDataFrame([(9, "b", "y")], schema), path)
    assert rows(io.read_models(spark, path, schema)) == rows(spark.createDataFrame([(1, "a", "x"), (9, "b", "y"), (3, "c", None)], schema))
    # data without a marker (a first write that failed) is not read
    spark.createDataFrame([(7, "z")], "k long, v string").write.parquet(f"{path}/data/model=d")
    assert io.read_models(spark, path, schema).count() == 3


def test_csv_is_split_unless_a_record_spans_lines(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    folder = tempfile.mkdtemp(prefix="lines-", dir="/tmp")
    for name, body in (("plain.csv", 'b,a\n1,"x, ""y"""\n2,z\n'), ("spans.csv", 'b,a\n1,"two\nlines"\n2,z\n')):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(body)
    assert rows(io.read_r_csv(spark, f"{folder}/plain.csv", schema)) == [('x, "y"', 1), ("z", 2)]
    assert rows(io.read_r_csv(spark, f"{folder}/spans.csv", schema)) == [("two\nlines", 1), ("z", 2)]
