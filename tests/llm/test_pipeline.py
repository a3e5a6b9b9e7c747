"""The corpus pipeline, stage by stage, against what brute force keeps."""

import os
import sys

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_stages_on_a_planted_corpus(spark):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    passage = text(60)
    clean = [text(300) for _ in range(30)]
    near = clean[0].split()
    near[5] = "changed"
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(clean)]
    rows += [(100, clean[1], "en", "s0", 1), (101, " ".join(near), "en", "s0", 1)]  # copies
    rows += [(102, text(50) + " " + passage, "en", "s1", 1), (103, passage + " " + text(50), "en", "s1", 1)]
    rows += [(104, "again and again and " * 40, "en", "s1", 1), (105, "few words", "en", "s0", 1), (106, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {r[0] for r in rows} - {104, 105, 106}

    kept = stages["ngram_jaccard_join"](spark, kept, "").cache()
    assert {r[0] for r in kept.collect()} == {r[0] for r in rows[:30]} | {102, 103}

    cut = {r["doc_id"]: r for r in stages["suffix_array_dedup"](spark, kept, "").collect()}
    assert cut[102]["text"].endswith(passage) and passage not in cut[103]["text"]
    assert all(cut[k]["text"] == t and cut[k]["n_chars"] == len(t) for k, t in enumerate(clean))

    docs2 = spark.createDataFrame(list(cut.values()), docs.schema)
    mixed = stages["mixing_sources"](spark, docs2, "").collect()
    words = lambda rs: sum(len(r["text"].split()) for r in rs)
    total = words(cut.values())
    assert abs(words(mixed) - 1.5 * total) <= 2
    for r in mixed:  # a repetition is the whole text or its first words
        words_of = r["text"].split()
        assert cut[r["doc_id"]]["text"].split()[: len(words_of)] == words_of

    packed = stages["best_fit_packing"](spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert len(packed) == len(mixed)
    assert not stages["quality_rules"](spark, docs.limit(0), "").collect()


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    for k in range(1, 14):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "mixing_sources", "best_fit_packing",
    ]


CLASH = {"kept": False, "base_failed": True, "n_words": 3, "n_removed": 9, "kept_text": "old", "size": 5, "taken": 6, "target": 7.5, "repetition": 8,
         "turn": "t", "n_shingles": 1, "component_id": 2, "id": 77, "h": "hh", "piece": 4, "bin": 3, "fill": 2, "length": 1}


def test_stages_leave_clashing_columns_alone(spark):
    """Extra columns named like the operators' own come out of every stage as they went in."""
    rng = np.random.default_rng(10)
    vocab = ["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(2000)]
    rows = [(k, " ".join(rng.choice(vocab, 80)), "en", "s0", 1, *CLASH.values()) for k in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} " + {bool: "boolean", int: "int", float: "double", str: "string"}[type(v)] for c, v in CLASH.items()
    )
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema["size"].dataType == docs.schema["size"].dataType, name
        found = out.collect()
        assert {r["doc_id"] for r in found} == set(range(20)), name
        assert all(r[c] == v for r in found for c, v in CLASH.items()), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.count() == 20


def test_stages_on_nothing_and_on_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (3, None, "en", "s", None), (3, None, "en", "s", None)], schema)
    left = {"quality_rules": 0, "ngram_jaccard_join": 4, "suffix_array_dedup": 4, "mixing_sources": 0, "best_fit_packing": 4}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
        assert stage(spark, odd, "").count() == left[name], name


def test_repeated_ids_in_the_join_stage(spark):
    """Exact copies under one id leave one row; another text under it stays."""
    rng = np.random.default_rng(11)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(2))
    rows = [(5, a), (5, a), (5, b), (1, a), (8, "short"), (8, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(1, a), (5, b), (8, "short")])
