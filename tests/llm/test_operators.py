"""Operators of the training-data subpackage against brute force, on small awkward tables."""

import hashlib
import os
import re
import sys
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from raterspark.llm import _blocks, neardup_vectors, shingle_join, suffix_dedup, toxicity  # noqa: E402
from raterspark.llm import _kernels as K  # noqa: E402
from raterspark.llm._common import fold, shared_folder, spread_join  # noqa: E402
from raterspark.llm._graph import connected_components  # noqa: E402
from raterspark.llm.language_id import identify_languages  # noqa: E402
from raterspark.llm.language_model import score_documents  # noqa: E402
from raterspark.llm.mixing import mix_sources  # noqa: E402
from raterspark.llm.neardup_vectors import linked_vectors  # noqa: E402
from raterspark.llm.packing import best_fit, pack_documents  # noqa: E402
from raterspark.llm.quality import quality_measures  # noqa: E402
from raterspark.llm.queries import document_events, ship, tokenizer_path  # noqa: E402
from raterspark.llm.shingle_join import jaccard_components, one_per_component  # noqa: E402
from raterspark.llm.suffix_dedup import removed_bytes  # noqa: E402
from raterspark.llm.token_rollup import EVENTS, TokenRollup  # noqa: E402
from raterspark.llm.toxicity import log_odds, maximal_segments, score_toxicity, word_counts_by_label  # noqa: E402

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A column named like an internal one must not matter.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, bin string, size string"


@pytest.fixture(scope="module")
def corpus(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base, line = text(300), "shared boilerplate line that many of the documents carry: " + text(30)
    rows = []
    for k in range(160):
        t = text(int(rng.integers(5, 200)))
        if k % 5 == 0:  # near copies of one text
            words = base.split()
            for at in rng.integers(0, 300, k % 20):
                words[at] = "edit%d" % rng.integers(0, 99)
            t = " ".join(words)
        elif k % 7 == 0:
            t = t + "\n" + line + "\n" + text(20)
        elif k % 11 == 0:
            t = base
        rows.append((k * 3, t, ["en", "de", None][k % 3], ["a", "b", None, "a"][k % 4], 1, k, "x", "y"))
    odd = [None, "", " \n\t", "one", "Two words", "É à ü", "###", line, "a\r\nb\n" * 40, "x" * 5000, text(12000)]
    rows += [(1000 + k, t, None, None, None, None, None, None) for k, t in enumerate(odd)]
    rows += [(None, base, "en", "a", 1, 1, "x", "y"), (7000, base, "en", None, 1, 1, "x", "y"), (7000, base, "en", None, 1, 1, "x", "y")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4))
    want = groups([e for e in edges if e[0] != e[1]], {n for e in edges if e[0] != e[1] for n in e})
    assert {r[0]: r[1] for r in found.collect()} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, width):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


@pytest.mark.parametrize(("width", "num", "grid"), [(4, 85, 4096), (5, 80, 8)])
def test_jaccard(corpus, monkeypatch, width, num, grid):
    monkeypatch.setattr(shingle_join, "BUCKET_CHARS", 20_000)
    monkeypatch.setattr(shingle_join, "GROUP_ROWS", grid)
    monkeypatch.setattr(shingle_join, "VERIFY_SHINGLES", 100)
    rows, df = corpus
    sets = {r[0]: shingles(r[1], width) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [
        (a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    want = groups(links, ids)
    got = jaccard_components(df, width=width, num=num).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert jaccard_components(df.limit(0)).count() == 0


def test_suffix_dedup(corpus, monkeypatch):
    monkeypatch.setattr(_blocks, "BLOCK_CHARS", 30_000)
    monkeypatch.setattr(_blocks, "BUCKET_CHARS", 40_000)
    rows, df = corpus
    seen, want = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p] += 1
                gone[p + 100 if p + 100 <= len(b) else len(b)] -= 1
            seen.add(b[p : p + 100])
        cut = np.cumsum(gone)[:-1] > 0
        spans = int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, c in zip(b, cut) if not c)
        want.append((r[0], len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in removed_bytes(df).collect()]
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = removed_bytes(df, keep_text=True, carry=("lang", "bin"))
    assert kept.columns[-3:] == ["kept_text", "lang", "bin"] and kept.count() == len(rows)
    assert removed_bytes(df.limit(0)).count() == 0


def test_seed_positions_of_a_long_text():
    raw = np.random.default_rng(3).integers(97, 101, 300_000).astype(np.uint8)
    ladder, row, seed, first, last = suffix_dedup.seeds(raw, np.array([0, len(raw)]), 100)
    assert (last - first + 1).sum() == len(raw) - 99
    assert ((seed >= first) & (seed + 32 <= last + 100)).all()


def test_lm_scores(corpus, monkeypatch):
    monkeypatch.setattr(_blocks, "BLOCK_CHARS", 30_000)
    monkeypatch.setattr(_blocks, "BUCKET_CHARS", 20_000)
    rows, df = corpus
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    toks = [(r[0], WORD.findall((r[1] or "").encode().lower()) + [None]) for r in rows]
    count = {}
    for i, ts in toks:
        if crc(i) != 2:
            for t in ts:
                count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(
        (i or -1, len(ts), sum(t in count for t in ts), n, round(sum(np.log10((count.get(t, 0) + 1) / (n + v + 1)) for t in ts), 6))
        for i, ts in toks
    )
    out = score_documents(df, fold("doc_id", 7) != 2, fold("doc_id", 7) == 3).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] <= 0 for r in out)
    held = [r for r in out if crc(r["doc_id"]) == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # nothing learned: uniform over one unknown token
    assert all(r["base_score"] == 0 and r["score"] == 0 for r in score_documents(df, F.lit(False), F.lit(False)).collect())
    assert score_documents(df.limit(0), F.lit(True), F.lit(False)).count() == 0


def brute_language_model(texts, train, deleted):
    """P(word | context), counts kept in plain dictionaries; END and START are None and ()."""
    from collections import Counter

    from raterspark.llm import language_model as lm

    tokens = [WORD.findall((t or "").encode().lower()) + [None] for t in texts]
    uni, bi, uni_d, bi_d = Counter(), Counter(), Counter(), Counter()
    for ts, a, d in zip(tokens, train, deleted, strict=True):
        if a:
            uni.update(ts)
            bi.update(zip([(), *ts], ts))
        if a and d:
            uni_d.update(ts)
            bi_d.update(zip([(), *ts], ts))
    n, v = sum(uni.values()), len(uni)
    ctx = lambda c, h: c[None] if h == () else c[h]
    cells = Counter()
    for ts, a, d in zip(tokens, train, deleted, strict=True):
        for h, w in zip([(), *ts], ts) if a and d else ():
            c = ctx(uni, h) - ctx(uni_d, h)
            p2 = (bi[h, w] - bi_d[h, w]) / max(c, 1)
            p1 = (uni[w] - uni_d[w]) / max(n - sum(uni_d.values()), 1)
            cells[tuple(int(lm.context_bucket(np.array([c]))[0]) if k == 0 else int(lm.bins(np.array([x]))[0]) for k, x in enumerate((c, p2, p1)))] += 1
    keys = sorted(cells)
    cols = [np.array([k[x] for k in keys], np.int64) for x in range(3)]
    weights = lm.learn_weights(*cols, np.array([cells[k] for k in keys]), v)

    def prob(h, w):
        c = ctx(uni, h)
        a, b, u = weights[int(lm.context_bucket(np.array([c]))[0])] * [c > 0, n > 0, 1]
        return (a * bi[h, w] / max(c, 1) + b * uni[w] / max(n, 1) + u / (v + 1)) / (a + b + u)

    return tokens, prob, set(uni)


def test_lm_score_against_dictionaries(corpus, monkeypatch):
    """The score of every text is the mixture's, and the mixture sums to one over the known
    words and one unknown, in every context."""
    monkeypatch.setattr(_blocks, "BLOCK_CHARS", 30_000)
    monkeypatch.setattr(_blocks, "BUCKET_CHARS", 20_000)
    rows, df = corpus
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    ids = [r[0] for r in rows]
    tokens, prob, known = brute_language_model([r[1] for r in rows], [crc(i) != 2 for i in ids], [crc(i) == 3 for i in ids])
    want = sorted((i or -1, round(sum(np.log10(prob(h, w)) for h, w in zip([(), *ts], ts)), 5)) for i, ts in zip(ids, tokens, strict=True))
    out = score_documents(df, fold("doc_id", 7) != 2, fold("doc_id", 7) == 3).collect()
    got = sorted((r["doc_id"] or -1, round(r["score"], 5)) for r in out)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-6, atol=1e-4)
    for h in [(), *sorted(known - {None})[:20], b"never seen"]:
        assert abs(sum(prob(h, w) for w in known) + prob(h, b"no such word") - 1) < 1e-9


def test_rows_without_an_id_spread_over_blocks(spark, monkeypatch):
    """A table whose rows share a null id: several blocks, every row scored and cut."""
    ship(spark)
    monkeypatch.setattr(_blocks, "BLOCK_CHARS", 5_000)
    monkeypatch.setattr(_blocks, "BUCKET_CHARS", 5_000)
    rng = np.random.default_rng(21)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(60)]
    df = spark.createDataFrame([(None, t) for t in texts + texts[:5]], "doc_id long, text string")
    assert df.select(_blocks.block_of("doc_id", "text", 8).alias("b")).distinct().count() > 4
    cut = removed_bytes(df).collect()
    assert len(cut) == 65 and sorted(r["n_removed"] for r in cut)[-6:] == sorted([0] + [len(t) for t in texts[:5]])
    assert len(score_documents(df, F.lit(True), fold("doc_id", 7) == 3).collect()) == 65


def test_vectors(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 8, 80)] + rng.normal(size=(80, 16)) * 0.12
    rows = [(int(k), [float(x) for x in v], 0) for k, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, [], 1), (505, rows[0][1], 1)]
    rows += [(506, rows[0][1][:8], 1), (None, rows[0][1], 1), (507, [float("inf")] + [1.0] * 15, 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    ok = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and None not in r[1]}
    ok = {k: v for k, v in ok.items() if np.isfinite(v).all() and v.any()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in ok for b in ok if a < b and cos(ok[a], ok[b]) >= 0.9]
    comp = groups(links, [r[0] for r in rows if r[0] is not None])
    for tile in (4096, 10):
        for r in linked_vectors(df, tile_rows=tile).collect():
            n = sum(r["vec_id"] in e for e in links)
            want = (n, comp[r["vec_id"]]) if r["vec_id"] is not None else (0, None)
            assert (r["n_links"], r["component_id"]) == want and r["kept"] == (want[1] == r["vec_id"])
    assert linked_vectors(df.limit(0)).count() == 0


def test_packing(corpus):
    from tokenizers import Tokenizer

    rows, df = corpus
    t = Tokenizer.from_file(tokenizer_path())
    special = df.limit(1).select(F.lit(9000).cast("long").alias("doc_id"), F.lit("A<|endoftext|>b It's, 12.5-x é! K").alias("text"))
    out = pack_documents(df.select("doc_id", "text").union(special), tokenizer_path()).collect()
    texts = {(r[0], r[1]) for r in rows} | {(9000, "A<|endoftext|>b It's, 12.5-x é! K")}
    want = set()
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want.add((i, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert {tuple(r)[:5] for r in out} == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 4096) + 1
    assert pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_best_fit_chooses_the_tightest_bin():
    bins, offsets, fills = best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_mixing(corpus):
    rows, df = corpus
    out = mix_sources(df).collect()
    assert len(out) == len(rows)
    size = lambda t: len(WORD.findall((t or "").encode()))
    by = {}
    for r in rows:
        by[r[3]] = by.get(r[3], 0) + size(r[1])
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(by.values()), set()
    while True:
        left = budget - sum(2 * by[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / w >= 2 * by[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * by[s] if s in capped else left * weight[s] / w for s in names}
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[round(r["target"], 6)] = taken.get(round(r["target"], 6), 0) + r["taken"]
    assert taken == {round(t, 6): int(t) for t in target.values()}
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(mix_sources(df.repartition(3)).collect()) == key(out)
    assert mix_sources(df.limit(0)).count() == 0


def test_quality(corpus):
    rows, df = corpus
    got = {(r["doc_id"], r["n_words"]): r for r in quality_measures(df).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text.encode())
        w5 = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        repeat = {k + j for k, x in enumerate(w5) if w5.count(x) > 1 for j in range(5)} if len(words) < 400 else None
        lines, dup, seen = text.split("\n"), 0, set()
        for x in lines:
            if WORD.search(x.encode()):
                dup += x in seen
                seen.add(x)
        r = got[i, len(words)]
        assert r["word_chars"] == sum(len(x.decode()) for x in words)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == dup
        if repeat is not None:
            assert r["n_repeat_words"] == len(repeat)
        assert r["base_failed"] == (len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality_measures(df.limit(0)).count() == 0


def test_quality_rejects_short_texts_of_another_language(spark):
    """Also short texts without their language's common words go; its own stay; a language
    whose common words are too rare to tell is not judged by them."""
    ship(spark)
    rng = np.random.default_rng(9)
    share = {"en": 0.38, "de": 0.38, "xx": 0.03}
    tail = {x: [f"{x}{k:05d}" for k in range(20000)] for x in share}

    def make(x, n):
        return " ".join(f"{x}{rng.integers(0, 128):03d}" if rng.random() < share[x] else tail[x][rng.integers(0, 20000)] for _ in range(n))

    rows = [(k, make(x, 400), x) for k, x in enumerate(["en", "de", "xx"] * 40)]
    sizes = [60, 80, 120, 150, 180, 205] * 3
    rows += [(1000 + k, make("en", n), "en") for k, n in enumerate(sizes)]
    rows += [(2000 + k, make("de", n), "en") for k, n in enumerate(sizes)]
    rows += [(3000 + k, make("en", n), None) for k, n in enumerate(sizes)]
    rows += [(4000 + k, make("xx", n), "xx") for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality_measures(df).where("doc_id >= 1000").collect()}
    for i, r in out.items():
        assert r["kept"] == (i // 1000 != 2), r
        assert (r["common_ratio"] is None) == (i >= 3000)  # an unknown language may be xx


def test_language_id(spark):
    ship(spark)
    rng = np.random.default_rng(8)
    words = {"en": ["the", "with", "which", "thing", "house"], "de": ["und", "nicht", "schön", "haus", "über"]}
    make = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(k, make(x, 40), x) for k, x in enumerate(["en", "de"] * 60)]
    rows += [(900, make("en", 60) + " " + make("de", 40), None), (901, None, "en"), (902, "12 ... 34", "de"), (903, "", None), (904, "A", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in identify_languages(df, fold("doc_id", 5) != 0).collect()}
    assert all(out[k]["lang_pred"] == x for k, _, x in rows[:120])
    assert sorted(out[900]["languages"]) == ["de", "en"] and out[900]["lang_pred"] == "en"
    assert abs(sum(out[900]["proportions"]) - 1) < 1e-9
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (901, 902, 903))
    assert out[904]["lang_pred"] in words
    assert {r["lang_pred"] for r in identify_languages(df, F.lit(False)).collect()} == {"und"}
    assert identify_languages(df.limit(0), F.lit(True)).count() == 0


def test_maximal_segments_against_definition():
    """A run is maximal if no proper extension or part of it has a larger score."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(1, 12)).astype(float)
        after = np.cumsum(s)
        up = np.flatnonzero(s > 0)
        got = [(int(up[a]), int(up[b])) for a, b in maximal_segments((after - s)[up].tolist(), after[up].tolist())]

        def best(lo, hi, s=s):
            runs = [(s[a : b + 1].sum(), -(b - a), -a) for a in range(lo, hi + 1) for b in range(a, hi + 1)]
            if not runs or max(runs)[0] <= 0:
                return []
            _, width, a = max(runs)
            a, b = -a, -a - width
            return best(lo, a - 1) + [(a, b)] + best(b + 1, hi)

        assert [s[a : b + 1].sum() for a, b in got] == [s[a : b + 1].sum() for a, b in best(0, len(s) - 1)]


def test_toxicity(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    vocab = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(vocab, int(rng.integers(20, 80))))
        toxic = k % 6 == 0
        if toxic:
            at = int(rng.integers(0, len(words)))
            words[at:at] = ["badword", "awful", "badword"]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "badword awful badword")]
    labels += [(None, 1, 1), (3, 1, None), (3, 1, 0), (5, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = score_toxicity(df, lb, fold("doc_id", 5) != 0).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None or r["doc_id"] < 600:
            assert r["predicted"] == int(r["doc_id"] is None or r["doc_id"] % 6 == 0)
            if r["predicted"]:
                text = dict(rows)[r["doc_id"]].encode()
                assert b"badword" in text[r["passages"][0]["start"] : r["passages"][0]["end"]]
        else:
            assert r["predicted"] == 0 and r["passages"] == []
    assert {r["predicted"] for r in score_toxicity(df, lb.limit(0), F.lit(True)).collect()} == {0}
    assert score_toxicity(df.limit(0), lb, F.lit(True)).count() == 0


def test_spread_join_deals_a_hot_key_and_loses_nothing(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, F.lit(0)).otherwise(F.col("id")).cast("int").alias("k"))
    rows = rows.union(spark.createDataFrame([(2000, None), (None, 0), (5, 0)], "id long, k int"))
    lookup = spark.createDataFrame([(0, "hot"), (800, "one"), (9999, "none")], "k int, v string")
    for how in ("inner", "left"):
        got = spread_join(rows, lookup, ["k"], "id", how).select("id", "k", "v")
        want = rows.join(lookup, "k", how).select("id", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spread_join(rows, lookup.limit(0), ["k"], "id").isEmpty()


def test_token_rollup(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path / "roll"))
    ev = lambda *rows: spark.createDataFrame(list(rows), EVENTS)
    total = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert total() == []
    assert r.commit(1, ev(("insert", 1, "a", "en", "v1", 10, 0), ("insert", 2, "a", None, "v1", 5, 0), ("insert", 1, "a", "en", "v2", 12, 0)))
    assert not r.commit(1, ev(("insert", 9, "a", "en", "v1", 99, 0)))  # delivered again
    assert total() == sorted([("a", "en", "v1", 1, 10), ("a", None, "v1", 1, 5), ("a", "en", "v2", 1, 12)], key=str)
    r.commit(2, ev(("revise", 1, "b", "en", "v1", 7, 0), ("revise", 1, "b", "en", "v1", 8, 1), ("delete", 77, None, None, None, None, 0),
                   ("insert", None, "a", "en", "v1", 3, 0), ("mend", 2, "a", "en", "v1", 3, 0)))
    assert total() == sorted([("b", "en", "v1", 1, 8), ("a", None, "v1", 1, 5), ("a", "en", "v2", 1, 12)], key=str)
    r.commit(3, ev(("delete", 1, None, None, None, None, 0)))
    assert total() == [("a", None, "v1", 1, 5)]
    r.commit(4, ev())
    assert total() == [("a", None, "v1", 1, 5)] and r.committed() == [1, 2, 3, 4]


def test_span_hash_is_position_free():
    raw = np.frombuffer(b"abc Abc abcabc", np.uint8)
    h = K.span_hash(raw, np.array([0, 4, 8, 11]), np.array([3, 7, 11, 14]))
    assert h[0] == h[2] == h[3] != h[1]
    low = K.span_hash(raw, np.array([0, 4]), np.array([3, 7]), lower=True)
    assert low[0] == low[1]


def test_toxic_evidence_grows_with_use():
    """A word's score grows with toxic uses, at every corpus size, and falls with clean ones."""
    sizes = np.array([1_000_000.0, 200_000.0])
    for times in (1, 300):
        n1 = np.array([1, 3, 6, 10, 16, 100, 1000])
        alone = log_odds(0 * n1, n1, sizes * times, 30000.0, 3.0, 1.0)
        assert (np.diff(alone) >= 0).all() and alone[0] == -1 and alone[3] > 0 and alone[-1] > alone[4] > alone[3]
        n0 = np.arange(8)
        mixed = log_odds(n0, n0 * 0 + 16, sizes * times, 30000.0, 3.0, 1.0)
        assert (np.diff(mixed) < 0).all() or mixed.min() == -1 and (np.diff(mixed) <= 0).all()
        assert mixed[0] > mixed[1] > 0


def test_word_counts_are_by_word(spark, monkeypatch):
    """No two words share a count, however often a task hands its counts on."""
    monkeypatch.setattr(toxicity, "HELD_WORDS", 100)
    ship(spark)
    rows = [(" ".join(f"w{k}" for k in range(d, 200_000, 40)), d % 2) for d in range(40)]
    df = spark.createDataFrame(rows + [("W7 w7", 1), ("w1", None)], "t string, y int")
    got = word_counts_by_label(df, "t", "y")
    assert got.count() == 200_000
    assert got.agg(F.sum("n0"), F.sum("n1")).first() == (100_000, 100_002)
    assert got.where("n1 = 3 and n0 = 0").count() == 1 and got.where("n0 + n1 > 1").count() == 1


def test_falling_totals_are_scanned_in_linear_time():
    """The worst case for a plain leftward search: every total lies under the ones before."""
    import time

    n = 100_000
    after = [float(n - k) for k in range(n)]
    before = [a - 0.5 for a in after]
    began = time.process_time()
    assert maximal_segments(before, after) == [(k, k) for k in range(n)]
    rising = maximal_segments([float(k) for k in range(n)], [k + 2.0 for k in range(n)])
    assert rising == [(0, n - 1)] and time.process_time() - began < 2


class _Counted(list):
    looks = 0

    def __getitem__(self, k):
        _Counted.looks += 1
        return super().__getitem__(k)


def test_segment_scan_bounds_its_looks():
    rng = np.random.default_rng(12)
    for _ in range(40):
        n = int(rng.integers(50, 400))
        total = np.cumsum(rng.normal(rng.normal(), 1, n))
        step = rng.random(n) + 0.1
        _Counted.looks = 0
        maximal_segments(_Counted((total - step).tolist()), _Counted(total.tolist()))
        assert _Counted.looks < 12 * n


def test_every_set_of_a_repeated_id_is_compared(spark):
    """Rows (5, A), (5, B), (1, A), (2, B): id 5 brings ids 1 and 2 together."""
    ship(spark)
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(3))
    near = b.split()
    near[7] = "edit"
    rows = [(5, a), (5, b), (1, a), (2, " ".join(near)), (7, c), (8, c), (9, None), (5, None), (5, ""), (None, a), (5, a)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, k1 string, class int")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, num=75).collect()]
    want = [(5, 57, 1), (5, 57, 1), (1, 57, 1), (2, 57, 1), (7, 57, 7), (8, 57, 7), (9, 0, 9), (5, 0, 5), (5, 0, 5), (None, 57, None), (5, 57, 1)]
    assert sorted(map(str, out)) == sorted(map(str, want))
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in one_per_component(df, width=4, num=75).collect())))
    # near texts under ids 5 and 2 leave one row, of id 2; A stays under id 1; wordless and null ids stay
    assert kept == sorted(map(str, [(1, a), (2, " ".join(near)), (7, c), (9, None), (5, None), (5, ""), (None, a)]))


def test_no_pair_is_verified_twice(spark, corpus, monkeypatch):
    asked = []
    plain = shingle_join.verified

    def watched(pairs, *rest):
        asked.append({(r["x"], r["y"]) for r in pairs.collect()})
        return plain(pairs, *rest)

    monkeypatch.setattr(shingle_join, "verified", watched)
    jaccard_components(corpus[1], num=70).count()
    assert len(asked) == 2 and asked[0] and not asked[0] & asked[1]
    assert not {(y, x) for x, y in asked[0]} & asked[1]


def test_vectors_of_a_repeated_id_have_their_own_links(spark):
    ship(spark)
    e = np.eye(8)
    rows = [(1, e[0]), (2, e[0]), (3, e[0]), (1, e[1]), (4, e[1]), (6, e[2]), (None, e[2]), (6, e[2])]
    df = spark.createDataFrame([(i, [float(x) for x in v], 5, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, tile string")
    for tile in (4096, 2):
        out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df, tile_rows=tile).collect()), key=str)
        assert out == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (1, 1, 1, True), (4, 1, 1, False), (6, 1, 6, True), (None, 0, None, True), (6, 1, 6, True)], key=str)


def test_possible_rows_hold_every_linked_row():
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(300, 24))
    unit[100:200] = unit[:100] + rng.normal(size=(100, 24)) * 0.2
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = neardup_vectors.quantise(unit[:150]), neardup_vectors.quantise(unit[150:])
    in_a, in_b = neardup_vectors.involved(a, b, False, 0.9)
    hit = unit[:150] @ unit[150:].T >= 0.9
    assert hit.any() and (in_a >= hit.any(axis=1)).all() and (in_b >= hit.any(axis=0)).all()
    assert in_a.sum() < 150 and in_b.sum() < 150


def test_rollup_delete_of_every_version_meets_its_own_batch(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path / "roll"))
    wide = EVENTS + ", sign int, wiped long"
    ev = lambda *rows: spark.createDataFrame([(*x, 7, 8) for x in rows], wide)
    total = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    r.commit(1, ev(("insert", 1, "a", "en", "v1", 10, 1), ("insert", 1, "a", "en", "v2", 4, 6), ("delete", 1, None, None, None, None, 5),
                   ("insert", 2, "a", "en", "v1", 3, 5), ("delete", 2, None, None, None, None, 5), ("insert", 3, "a", "en", "v1", 2, None)))
    assert total() == sorted([("a", "en", "v2", 1, 4), ("a", "en", "v1", 1, 2)], key=str)
    # ties: of equal seq the delete first, then the larger count; a repeated event counts once
    r.commit(2, ev(("revise", 3, "a", "en", "v1", 5, 1), ("revise", 3, "a", "en", "v1", 9, 1), ("revise", 3, "a", "en", "v1", 9, 1),
                   ("delete", 1, "a", "en", "v2", None, 3), ("insert", 1, "a", "en", "v2", 8, 3)))
    assert total() == [("a", "en", "v1", 1, 9)]


def test_token_counts_of_all_versions(spark, corpus):
    """The batches of the registered query, against counts by the tokenizer itself."""
    from tokenizers import Tokenizer

    rows, df = corpus
    t = Tokenizer.from_file(tokenizer_path())
    docs = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    roll = TokenRollup(spark, shared_folder(spark) + "/rollups/test-" + uuid.uuid4().hex)
    for number, events in enumerate(document_events(docs)):
        roll.commit(number, events)
    seen, want = set(), {}
    for i, text, lang, source, *_ in sorted({r[:4] for r in rows if r[0] is not None}, key=lambda r: r[0]):
        if text is not None and text in seen:
            continue
        seen.add(text)
        words = [w.decode() for w in WORD.findall((text or "").encode())]
        for version, n in (("words-1", sum(any(c.isalnum() for c in w) for w in words)), ("word_bpe_49k", len(t.encode(text or "", add_special_tokens=False).ids))):
            x = want.setdefault((source, lang, version), [0, 0])
            x[0] += 1
            x[1] += n
    assert {tuple(r)[:3]: list(r)[3:] for r in roll.totals().collect()} == want


def test_language_mixture_against_plain_em(spark, monkeypatch):
    """Model, choice of languages and proportions, one document and one number at a time."""
    from collections import Counter
    from math import exp, log

    from raterspark.llm import language_id as li

    ship(spark)
    rng = np.random.default_rng(18)
    words = {"en": ["the", "with", "which", "thing"], "de": ["und", "nicht", "schön", "über"], "fr": ["les", "été", "dans", "où"]}
    make = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(k, make(x, 12), x) for k, x in enumerate(["en", "de", "fr"] * 20)]
    rows += [(100 + k, make("en", 5 + k) + " " + make("de", 12) + " " + make("fr", 4 * (k % 3)), None) for k in range(12)]
    rows += [(200, "ab", None), (201, "Q" * 20000 + " the with", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return Counter(li.trigrams(raw, np.array([0, len(raw)]))[1].tolist())

    learned = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 0]
    langs = ["de", "en", "fr"]
    counts = {x: sum((grams(t) for _, t, y in learned if y == x), Counter()) for x in langs}
    theta = lambda x, c: (counts[x][c] + 0.5) / (sum(counts[x].values()) + 0.5 * li.CELLS)
    for dense in (1 << 23, 0):
        monkeypatch.setattr(li, "DENSE", dense)
        got = {r["doc_id"]: r for r in identify_languages(df, fold("doc_id", 5) != 0).collect()}
        for i, text, _ in rows:
            g = grams(text)
            n = sum(g.values())
            if not n:
                assert got[i]["lang_pred"] in langs
                continue
            single = {x: sum(k * log(theta(x, c)) for c, k in g.items()) for x in langs}
            best = max(langs, key=single.get)
            share, reached = {best: 1.0}, single[best]
            while len(share) < len(langs):
                mixed = {c: sum(s * theta(x, c) for x, s in share.items()) for c in g}
                new = max((x for x in langs if x not in share), key=lambda x: sum(k * theta(x, c) / mixed[c] for c, k in g.items()))
                pi = {**{x: 0.8 * s for x, s in share.items()}, new: 0.2}
                for _ in range(8):
                    mixed = {c: sum(s * theta(x, c) for x, s in pi.items()) for c in g}
                    pi = {x: sum(k * s * theta(x, c) / mixed[c] for c, k in g.items()) / n for x, s in pi.items()}
                value = sum(k * log(sum(s * theta(x, c) for x, s in pi.items())) for c, k in g.items())
                if value - reached <= 4.0 * log(n + 1):
                    break
                share, reached = pi, value
            r = got[i]
            assert sorted(r["languages"]) == sorted(share)
            assert all(abs(p - share[x]) < 1e-6 for x, p in zip(r["languages"], r["proportions"], strict=True))
            top = max(share, key=share.get)
            sure = 1 / sum(exp(min(s - single[best], 0)) for s in single.values())
            assert r["lang_pred"] == top and abs(r["score"] - min(1.0, share[top] * sure)) < 1e-6


def test_quality_distances_against_plain_counts(spark):
    """Both Jensen-Shannon distances and the verdict, from plain counters and the formulas."""
    from collections import Counter
    from math import log2, sqrt

    from raterspark.llm import quality as q

    ship(spark)
    rng = np.random.default_rng(19)
    vocab = {x: [f"{x}{k:03d}" for k in range(300)] for x in ("en", "de")}
    weight = 1 / np.arange(1, 301)
    make = lambda x, n: " ".join(rng.choice(vocab[x], n, p=weight / weight.sum()))
    rows = [(k, make(x, int(rng.integers(30, 400))), x) for k, x in enumerate(["en", "de"] * 30)]
    rows += [(100, make("de", 300), "en"), (101, "#$%& " * 80 + make("en", 60), "en"), (102, make("en", 200), None), (103, "ÀÉ Ünï " * 90, "en"), (104, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cell = lambda w: int(K.span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), lower=True)[0] % np.uint64(q.WORD_CELLS))

    def histograms(text):
        raw = (text or "").encode()
        kinds = Counter()
        for byte in raw:
            if byte >= 192:
                kinds["multi"] += 1
            elif byte < 128:
                kinds[next((k for k, members in enumerate(q.CLASSES) if byte in members), "other")] += 1
        return kinds, Counter(cell(w) for w in WORD.findall(raw))

    total = {x: [sum((histograms(t)[k] for _, t, y in rows if y == x), Counter()) for k in (0, 1)] for x in ("en", "de")}
    common = {x: dict(sorted(t[1].items(), key=lambda c: (-c[1], c[0]))[: q.COMMON_WORDS]) for x, t in total.items()}

    def js(p, r):
        p, r = ({k: n / sum(h.values()) for k, n in h.items()} for h in (p, r))
        mid = {k: (p.get(k, 0) + r.get(k, 0)) / 2 for k in p.keys() | r.keys()}
        return sqrt(max(0.0, sum(h.get(k, 0) * log2(h.get(k, 0) / m) for h in (p, r) for k, m in mid.items() if h.get(k, 0)) / 2))

    def rest(words, kept, of):
        return {**{c: n for c, n in words.items() if c in kept}, "rest": of - sum(n for c, n in words.items() if c in kept)}

    got = {r["doc_id"]: r for r in quality_measures(df).collect()}
    for i, text, lang in rows:
        kinds, words = histograms(text)
        n, r = sum(words.values()), got[i]
        if n < 50:
            assert r["char_distance"] is None and r["word_distance"] is None
            continue
        among = [lang] if lang else ["en", "de"]
        char = min(js(kinds, total[x][0]) for x in among)
        word = min(js(rest(words, common[x], n), rest(total[x][1], common[x], sum(total[x][1].values()))) for x in among)
        assert abs(r["char_distance"] - char) < 1e-9 and abs(r["word_distance"] - word) < 1e-9
        far = char > 0.20 + 1.2 / sqrt(n) or word > 0.32 + 2.2 / sqrt(n) or (r["common_ratio"] is not None and r["common_ratio"] < 0.25)
        assert r["kept"] == (not r["base_failed"] and not far)
    assert not got[100]["kept"] and not got[103]["kept"]


def test_log_odds_and_extreme_value_rate_by_definition():
    rng = np.random.default_rng(20)
    n0, n1 = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    keep = n0 + n1 > 0
    n0, n1 = n0[keep], n1[keep]
    total = np.array([40_000.0, 9_000.0])
    got = log_odds(n0, n1, total, 30000.0, 3.0, 1.0)
    for a, b, s in zip(n0.tolist(), n1.tolist(), got.tolist(), strict=True):
        prior = (a + b) * 30000.0 / (total.sum() + toxicity.UNSEEN)
        y0, y1 = a + prior, b + prior
        even = np.log((total[1] + 30000.0 - y1) / (total[0] + 30000.0 - y0))
        loss = lambda t, y0=y0, y1=y1: (y1 * np.log(y1 / (y0 + y1)) + y0 * np.log(y0 / (y0 + y1))) - (y1 * t - (y0 + y1) * np.logaddexp(0, t))
        if 2 * loss(even) <= 9:
            assert s == -1.0
        else:  # the point of the interval nearest to even odds
            t = even + s + 1.0
            assert abs(2 * loss(t) - 9) < 1e-6 and min(even, np.log(y1 / y0)) < t < max(even, np.log(y1 / y0))
    background = np.append(n0 + 0.5, total[0] - n0.sum())
    scores = np.append(got, -1.0)
    rate = toxicity.extreme_value_rate(scores, background)
    p = (background + 1e-9) / (background + 1e-9).sum()
    assert rate > 0 and abs((p * np.exp(rate * scores)).sum() - 1) < 1e-6
