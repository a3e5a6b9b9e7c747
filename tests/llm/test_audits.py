"""Filter audit, divergence audit and URL filters against brute force, on awkward tables."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from raterspark.llm import divergence, url_filters
from raterspark.llm.divergence import scatter, source_divergence
from raterspark.llm.filter_audit import filter_interactions, in_list, union
from raterspark.llm.queries import ship
from raterspark.llm.url_filters import RULES, host_of, judge_urls, path_of, pattern_rule, phrase_rule, rarest_token_index, rule_table, site_rule

#: Columns named like internal ones must not matter.
DOCS = "doc_id long, text string, lang string, source string, part string, mask int, h long, id long, term string, n string"
EXTRA = ("p", 7, 8, 9, "t", "x")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = ["word%s" % "abcdefghij"[k % 10] * (1 + k // 10) for k in range(40)] + ["Été", "naïve", "A-B", "x$", "#tag", "ÀB", "日本"]
    out = []
    for k in range(150):
        text = " ".join(rng.choice(vocab[: 20 + k % 27], int(rng.choice([3, 40, 250, 400]))))
        if k % 7 == 0:
            text = text.upper()
        if k % 9 == 0:
            text = out[0][1] if out else text
        out.append((k * 10, text, ["en", "de", None][k % 3], ["a", "b", None, "", "c"][k % 5], *EXTRA))
    odd = [None, "", " \n", "ONE", "\x00A|b", "日本 " * 300, "Word " * 30000, "a" * 3000]
    out += [(5000 + k, t, "en", "a", *EXTRA) for k, t in enumerate(odd)]
    out += [(None, out[0][1], "en", "a", *EXTRA), (None, out[0][1], "en", "a", *EXTRA)]
    out += [(7000, out[0][1], "en", None, *EXTRA)] * 3 + [(7000, "other text of the same id", "en", None, *EXTRA), (8000, "only clean " * 150, "zz", "lone", *EXTRA)]
    return out


LABELS = "doc_id long, quality int, toxic int, id long"


def labels_of(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return [(i, k % 3 % 2 if k % 5 else None, int(k % 4 == 0), 1) for k, i in enumerate(ids) if k % 2 == 0] + [(0, 1, 0, 1), (7000, 1, 1, 1), (None, 1, 1, 1)]


def failing(rows):
    out = []
    for doc, text, _, _, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (doc is not None and any(r[0] is not None and r[0] < doc and (r[1] or "") == text for r in rows))
        out.append(set(fails))
    return out


def test_filter_interactions_against_all_orders(spark, rows):
    ship(spark)
    labels = labels_of(rows)
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    fails = failing(rows)
    want = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[3] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                want[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
        for (p, order, step), x in want.items():
            if p == part:
                x.append(total[order[step - 1]])
    found = filter_interactions(spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found} == want
    assert len(found) == len(want) == 120 * 5 * len({r[3] or "" for r in rows})


def test_filter_interactions_empty_tables(spark, rows):
    ship(spark)
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_interactions(docs, labels).count() == 0
    out = filter_interactions(spark.createDataFrame(rows[:5], DOCS), labels)
    assert out.agg({"good_lost": "sum"}).first()[0] == 0


@given(st.lists(st.sets(st.integers(0, 60)), min_size=0, max_size=5))
@settings(max_examples=200, deadline=None)
def test_posting_list_merges(sets):
    lists = [np.array(sorted(s), np.int32) for s in sets]
    assert union(lists).tolist() == sorted(set().union(*sets))
    for a, s in zip(lists, sets, strict=True):
        for b, t in zip(lists, sets, strict=True):
            assert a[in_list(a, b)].tolist() == sorted(s & t)


def brute_divergence(rows, least):
    occ, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        occ[g].update(terms)
        df[g[0]].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = sorted(g[1] for g in groups if g[0] == lang)
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))
        count = {s: {t: occ[lang, s][t] for t in kept} for s in mine}
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in count.items()}
        total = {t: sum(count[s][t] for s in mine) for t in kept}
        q = {t: share(total[t], sum(total.values())) for t in kept}
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:top], 1)}
    return out


@pytest.mark.parametrize("least,postings,held", [(1, 1 << 18, 1 << 18), (8, 16, 40), (10**6, 1 << 18, 1 << 18)])
def test_source_divergence_against_brute_force(spark, rows, monkeypatch, least, postings, held):
    ship(spark)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    found = source_divergence(spark.createDataFrame(rows, DOCS).repartition(4), least_docs=least).collect()
    assert {tuple(r) for r in found} == brute_divergence(rows, least)
    assert len(found) == len(set(found))


def test_source_divergence_of_nothing(spark):
    ship(spark)
    assert source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    one = spark.createDataFrame([(1, None, None, None, *EXTRA), (2, "", None, "b", *EXTRA)], DOCS)
    assert {tuple(r) for r in source_divergence(one).collect()} == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.integers(1, 50)), max_size=40), st.lists(st.integers(0, 9), min_size=5, max_size=5))
@settings(max_examples=150, deadline=None)
def test_scatter_is_the_distance(postings, zero):
    share = {(g, t): p for g, t, p in postings}
    cells = sorted(share)
    row, term = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
    base = np.array(zero, np.int64)
    got = scatter(row, term, np.array([share[c] for c in cells], np.int64), base)
    got = got + got.T + 10 * np.abs(base[:, None] - base[None, :])
    at = lambda g, t: share.get((g, t), zero[g])
    for g in range(5):
        for h in range(5):
            if g != h:
                assert got[g, h] == sum(abs(at(g, t) - at(h, t)) for t in range(10))


URLS = [
    None, "", "no scheme/org/", "http://", "://", "http://org/", "http://ORG/x", "http://a.org", "http://a.org?x=/es/", "http://sub.Example.org/es/1",
    "https://example.org/es", "https://example.org/en/1", "https://www.example.org/en/123?y#z", "https://example.org/EN/1", "https://badexample.org/es/",
    "https://x.com/fr/1", "https://x.com/de/1", "https://x.com/en/1", "https://xcom/fr/", "https://free-bets.example.net/en/4", "http://BETS.example.net",
    "http://freebets.example.net/", "http://a.net/;JSESSIONID=5", "http://10.0.0.1/x", "http://10.0.0.1:80", "http://a.net/setup.exe", "http://a.net/setup.exes",
    "http://a.net/x/casino/y", "http://casino.x.org/", "a://b://c.com/de/", "http://u@x.com:80/fr/", "http://x.net\n/Spam/", "http://é.org/ü/es/", "http://x_adult.net/",
    "http://x.net/" + "a/" * 5000 + "porn", "https://x.com/fr/adult",
]


def judged(url, rules=RULES):
    """Every rule on the url, no index."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    hits = [r for r in rules if re.search(r.pattern.replace("$", r"\Z"), host + path)]
    best = max(hits, key=lambda r: (r.rank, len(r.name), r.verdict == "block", r.name), default=None)
    site = best is not None and best.rank > 0
    return host, path, best.name if site else None, best.verdict if best else "allow", best.name if best and not site else None


@pytest.mark.parametrize("limit", [20_000, 0])
def test_url_verdicts_against_every_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    pages = [(k, u, "h", "t", "r") for k, u in enumerate(URLS)] + [(None, URLS[9], "h", "t", "r")] * 2
    frame = spark.createDataFrame(pages, "page_id long, url string, host string, token string, rule string")
    found = judge_urls(frame, rule_table(spark, RULES)).collect()
    assert Counter(tuple(r) for r in found) == Counter((p[0], *judged(p[1])) for p in pages)
    assert {r["verdict"] for r in found} == {"allow", "block"}
    assert judge_urls(frame.limit(0), rule_table(spark, RULES)).count() == 0
    none = judge_urls(frame, rule_table(spark, RULES).limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


def test_site_rules_by_definition(spark):
    """The contract's own words for a site rule, not its expression."""
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string")
    sites = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in judge_urls(frame, rule_table(spark, RULES)).collect():
        fits = [n for n in sites if ("." + r["host"]).endswith("." + n.split("/")[0]) and r["path"].startswith(n[n.index("/") :])]
        assert r["rule"] == max(fits, key=len, default=None)
        assert not fits or r["verdict"] == sites[r["rule"]]


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = (site_rule("block", "a.org", "/x/yz"), phrase_rule("block", "b-c"), pattern_rule("block", "any", "^$"), site_rule("allow", "q.r", "/"))
    assert rules[0].tokens == ("a", "org", "x") and rules[1].tokens == ("b", "c")
    tokens = spark.createDataFrame([(t,) for t in ["org", "org", "x", "x", "a", "a", "b", "c", "c", "zz"]], "token string")
    found = {r["name"]: r["token"] for r in rarest_token_index(rule_table(spark, rules), tokens).collect()}
    assert found == {"a.org/x/yz": "a", "b-c": "b", "any": None, "q.r/": "q"}


def test_host_and_path(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "url string")
    for r in frame.select("url", host_of(frame["url"]).alias("h"), path_of(frame["url"]).alias("p")).collect():
        assert (r["h"], r["p"]) == judged(r["url"])[:2]
