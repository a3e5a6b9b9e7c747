import json
import os
import tempfile

from conftest import rows

from raterspark.streaming import mode_from_counts, start_ingest, start_vote_counts


def _write(folder, name, records):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")


def _rec(cid, contents):
    return {"id": f"r{cid}", "custom_id": str(cid),
            "response": {"body": {"model": "m", "created": 0,
                                  "choices": [{"index": i, "message": {"content": c}} for i, c in enumerate(contents)]}}}


def test_incremental_ingest_and_votes(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _write(src, "a.jsonl", [_rec(1, ['{"inclusion": ["included"]}', '{"inclusion": "excluded"}',
                                     '{"inclusion": ["included"]}'])])
    q = start_ingest(spark, src, os.path.join(base, "out"), os.path.join(base, "ck1"), "inclusion")
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(base, "out"))
    assert out.count() == 3
    # A second file arrives later: only it is processed on the next run.
    _write(src, "b.jsonl", [_rec(2, ["no answer", '{"inclusion": ["excluded"]}'])])
    q = start_ingest(spark, src, os.path.join(base, "out"), os.path.join(base, "ck1"), "inclusion")
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(base, "out")).count() == 5

    counts = os.path.join(base, "counts")
    v = start_vote_counts(spark, src, os.path.join(base, "ck2"), "inclusion", "vote_counts_test", counts)
    v.awaitTermination(120)
    modes = rows(mode_from_counts(spark.read.parquet(counts)), "custom_id", "label_mode", "n_votes")
    # Item 2: the answer without a JSON block is a blank vote ('') and ties with
    # 'excluded'; the first-seen value wins.
    assert modes == [("1", "included", 3), ("2", "", 2)]


def test_vote_counts_to_table(spark):
    base = tempfile.mkdtemp(prefix="stream2-", dir="/tmp")
    src = os.path.join(base, "in")
    os.makedirs(src)
    _write(src, "a.jsonl", [_rec(5, ['{"inclusion": "x"}', '{"inclusion": "y"}', '{"inclusion": "y"}'])])
    out = os.path.join(base, "counts")
    q = start_vote_counts(spark, src, os.path.join(base, "ck"), "inclusion", "vote_counts_table", table_path=out)
    q.awaitTermination(120)
    modes = rows(mode_from_counts(spark.read.parquet(out)), "custom_id", "label_mode", "n_votes")
    assert modes == [("5", "y", 3)]
