from conftest import rows
from pyspark.sql import functions as F

from raterspark.functions import nulls as nl
from raterspark.functions import text as tx
from raterspark.operators.summary import bin_left_closed, ordered_level


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("China",), ("France",), (None,)], "c string")
    kept = rows(df.where(nl.not_in("c", ["China", "India"])))
    assert kept == [(None,), ("France",)]
    assert df.where(~F.col("c").isin("China")).count() == 1  # plain SQL drops NULL


def test_n_distinct_counts_null(spark):
    df = spark.createDataFrame([(1, None), (1, 1), (1, 1)], "g int, v int")
    assert df.groupBy("g").agg(nl.n_distinct_na("v").alias("n")).collect()[0].n == 2


def test_if_else3_and_paste0(spark):
    df = spark.createDataFrame([(None, "a"), (True, None), (False, "b")], "c boolean, s string")
    out = df.select(nl.if_else3(F.col("c"), 1, 0).alias("x"), nl.paste0("s", F.lit("x")).alias("p")).collect()
    assert [r.x for r in out] == [None, 1, 0]
    assert [r.p for r in out] == ["ax", "NAx", "bx"]


def test_sum_rules(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "g int, v double")
    out = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(nl.sum_na_rm("v").alias("a"), nl.sum_strict("v").alias("b")).collect()}
    assert out[1] == (2.0, None)
    assert out[2] == (0, None)


def test_bins_left_closed(spark):
    vals = [0.0, 9.99, 10.0, 14.9, 15.0, 25.0, 35.0, 99.9, 100.0, -1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    labels = ["very low", "low", "medium", "high", "very high"]
    got = [r[0] for r in df.select(bin_left_closed("x", [0, 10, 15, 25, 35, 100], labels)).collect()]
    assert got == ["very low", "very low", "low", "low", "medium", "high", "very high", "very high", None, None, None]


def test_ordered_level(spark):
    df = spark.createDataFrame([("High",), ("Low",), ("Other",), (None,)], "x string")
    got = [r[0] for r in df.select(ordered_level("x", ["High", "Mid", "Low"])).collect()]
    assert got == [1, 3, None, None]


def test_title_key(spark):
    df = spark.createDataFrame([("  Élan: Straße — Øre, 2024!\n ",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.title_key("t")).collect()]
    assert got == ["elan strasse  ore 2024", None]


def test_fold_table_built_from_rule():
    assert "é" in tx.FOLD_SRC and tx.FOLD_DST[tx.FOLD_SRC.index("é")] == "e"
    assert "Ņ" in tx.FOLD_SRC and tx.FOLD_DST[tx.FOLD_SRC.index("Ņ")] == "N"
    assert len(tx.FOLD_SRC) == len(tx.FOLD_DST)


def test_tokens(spark):
    df = spark.createDataFrame([("A; B , C",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(tx.tokens("s")).collect()]
    assert got == [["A", "B", "C"], [], None]


def test_capitalize_first(spark):
    df = spark.createDataFrame([("very high",)], "s string")
    assert df.select(tx.capitalize_first("s")).collect()[0][0] == "Very high"


def test_compose_text(spark):
    df = spark.createDataFrame(
        [("T", "A", "  ", "wos", "sc"), (None, None, None, None, "sc"), ("T", "A", "au", "wos", None)],
        "t string, a string, k1 string, k2 string, k3 string",
    )
    got = [r[0] for r in df.select(tx.compose_text("t", "a", "k1", "k2", "k3")).collect()]
    assert got == ["T A wos", "  sc", "T A au"]


CASES = [
    'x {"a": ["b"]} y',
    "{'a': ['b',]}",
    "study's {\"a\": [\"b\"]}",
    "no braces here",
    None,
    '{"a": "{nested}"} tail',
    '{"z": 1}',
]


def test_first_json_block_and_key(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    blk = tx.first_json_block("s")
    val = tx.json_key_text(blk, "a")
    out = df.select(blk.alias("b"), val.alias("v"), tx.parse_status(blk, val).alias("st")).collect()
    assert out[0].b == '{"a": ["b"]}' and out[0].v == "b" and out[0].st == "ok"
    assert out[1].v == "b"  # single quotes and trailing comma tolerated
    assert out[3].b is None and out[3].st == "no_block"
    assert out[4].st == "no_block"
    assert out[6].st == "no_key"


def test_balanced_block(spark):
    # text, block with quotes tracked inside braces only, block with quotes tracked everywhere
    cases = [
        ('x {"a": {"b": 1}} y {"c": 2}', '{"a": {"b": 1}}', '{"a": {"b": 1}}'),
        ('it\'s {"a": 1}', '{"a": 1}', None),  # the apostrophe hides the block
        ('it\'s John\'s {"a": 1}', '{"a": 1}', '{"a": 1}'),
        ('{"a": "}{"} tail', '{"a": "}{"}', '{"a": "}{"}'),
        ('{"a": "q\\"}"} tail', '{"a": "q\\"}"}', '{"a": "q\\"}"}'),  # an escaped quote
        ("{'a': None}", "{'a': None}", "{'a': None}"),
        ("} {unclosed", None, None),
        ("no block", None, None),
        ("", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, s string").orderBy("k")
    for pick, quotes in ((1, "inside"), (2, "literal")):
        got = [r[0] for r in df.select(tx.first_balanced_block("s", quotes)).collect()]
        assert got == [c[pick] for c in cases]


def test_pattern_flag(spark):
    df = spark.createDataFrame([("Standard Barometer 99",), ("Flash 12",), ("Other",), (None,)], "s string")
    got = [r[0] for r in df.select(tx.pattern_flag("s", "barometer", also_equal="Flash 12")).collect()]
    assert got == [1, 1, 0, 0]


def test_json_key_text_python_literals(spark):
    data = [
        (1, "{'label': ['a', None]}", "a, None"),
        (2, '{"label": ["a", null]}', "a, None"),
        (3, "{'label': ['x',], }", "x"),
        (4, "{'label': True}", "True"),
        (5, '{"label": "None, ] True"}', "None, ] True"),
        (6, "{'label': None}", None),
        (7, '{"label": "it\'s", "n": [1,]}', "it's"),
        (8, "{'label': [false, 'b']}", "False, b"),
        (9, None, None),
    ]
    df = spark.createDataFrame([d[:2] for d in data], "id int, b string")
    got = {r.id: r.v for r in df.select("id", tx.json_key_text(F.col("b"), "label").alias("v")).collect()}
    assert got == {d[0]: d[2] for d in data}


def test_letters_without_an_accent_fold(spark):
    data = {
        "ıħŋŧſĳŀ": "ihntsijl", "ĦŊŦĲĿ": "HNTIJL", "éØßŁþđ": "eOssLthd", "ﬁﬀ": "fiff", "ƀɓ": "bɓ", "ŉ ĸ": "'n q", "ＡＢｚ": "ABz", "Ǆ ǆ": "DZ dz", "日本 я": "日本 я",
        "ấṩ": "as",
    }
    df = spark.createDataFrame([(k,) for k in data], "s string")
    assert {r.s: r.f for r in df.select("s", tx.fold_ascii("s").alias("f")).collect()} == data
