"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path with the tokens that every match holds
whole. How often these tokens stand in the urls decides which one a rule is filed under; a
url's tokens fetch the rules filed under them, and only those rules' expressions are run.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, spread_join

#: A token is a run of ASCII letters and digits, A-Z lower-cased.
TOKEN = r"[A-Za-z0-9]+"
#: An index of at most so many rules is broadcast; a larger one is joined by shuffles.
BROADCAST_RULES = 20_000


class Rule(NamedTuple):
    """``pattern`` is searched in host + path; ``tokens`` stand whole in all it matches.

    Of a url's rules the one of the highest rank decides, then the longest name, then block.
    A rule without tokens is tried on every url.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Rule for ``host``, its subdomains, and the paths that start with ``path``."""
    whole = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(TOKEN + "$", "", path)  # a cut last token may go on
    tokens = tuple(t.lower() for t in re.findall(TOKEN, f"{host}/{whole}"))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, 1)


def phrase_rule(verdict: str, phrase: str) -> Rule:
    """Rule for urls that hold ``phrase`` (lower case) between non-tokens, in any case."""
    tokens = tuple(re.findall(TOKEN, phrase))
    return Rule(phrase, verdict, rf"(?i)(?:^|[^a-z0-9]){re.escape(phrase)}(?:[^a-z0-9]|$)", tokens, 0)


def pattern_rule(verdict: str, name: str, pattern: str, tokens: tuple[str, ...] = ()) -> Rule:
    """Rule for any expression; ``tokens`` must stand whole in all that it matches."""
    return Rule(name, verdict, pattern, tokens, 0)


#: Sites with a verdict of their own.
SITES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: Phrases of sites that a training corpus does without.
PHRASES = (
    "adult", "adult-x", "betting", "bets", "casino", "cheap-pills", "cracked", "escort", "free-bets", "gambling",
    "hentai", "keygen", "link-farm", "nsfw", "payday-loans", "phishing", "poker", "porn", "sex", "slots",
    "spam", "spam-farm", "torrent", "viagra", "warez", "xxx",
)
RULES = (
    *SITES,
    *(phrase_rule("block", p) for p in PHRASES),
    pattern_rule("block", "host is an address", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?:/|$)"),
    pattern_rule("block", "session in path", r"(?i);jsessionid=", ("jsessionid",)),
    pattern_rule("block", "program file", r"(?i)/[^/]+\.(?:exe|apk|msi|dmg)$"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(address, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t)))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(list(rules), "name string, verdict string, pattern string, tokens array<string>, rank int")


def rarest_token_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with the token each is filed under: the one in the fewest urls, ties by token.

    ``tokens`` has a row for each url and token. Only tokens of rules are counted; a rule
    with none has a null token.
    """
    needed = rules.select(F.explode("tokens").alias("token")).distinct()
    used = tokens.join(needed, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    keyed = rules.select("name", "verdict", "pattern", F.explode("tokens").alias("token")).join(used, "token", "left").na.fill(0, ["urls"])
    rarest = keyed.groupBy("name", "verdict", "pattern").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    return rules.join(rarest, ["name", "verdict", "pattern"], "left")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, method_rule.

    ``rules`` are rows of Rule (see rule_table). rule is the name of the site rule that
    decides, if any; otherwise method_rule is that of the deciding pattern rule, if any, and
    without one the verdict is ``default``. Null urls and urls without :// have an empty
    host and path, which only a rule without tokens can match.

    Urls are judged once each, so repeated rows and ids cost nothing and get equal verdicts;
    null ids are ids like others. Ties between rules go by rank, length of name, block before
    allow, then name. Urls of any length are read whole; other columns are not read, whatever
    their names; an empty table gives no row, and with no rules every verdict is ``default``.
    """
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    read = read.withColumn("address", F.concat("host", "path")).withColumn("deal", F.xxhash64("id", F.spark_partition_id()))
    addresses = read.select("address").distinct()  # a host has no slash and a path starts with one
    tokens = addresses.select("address", F.explode(tokens_of(F.col("address"))).alias("token"))
    index = materialize(rarest_token_index(rules, tokens), "rules")

    filed = index.withColumn("token", F.coalesce("token", F.lit("")))  # every url has the empty token
    asked = addresses.select("address", F.explode(F.array_append(tokens_of(F.col("address")), F.lit(""))).alias("token"))
    if index.count() <= BROADCAST_RULES:
        fetched = asked.join(F.broadcast(filed), "token")
    else:
        fetched = spread_join(asked, filed, ["token"], "address")
    hits = fetched.where(F.regexp_like("address", F.col("pattern")))
    first = F.struct("rank", F.length("name").alias("length"), (F.col("verdict") == "block").alias("block"), "name", "verdict")
    best = hits.groupBy("address").agg(F.max(first).alias("best"))
    judged = spread_join(read, best, ["address"], "deal", "left")
    site = F.col("best.rank") > 0
    return judged.select(
        F.col("id").alias(id_col), "host", "path",
        F.when(site, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~site, F.col("best.name")).alias("method_rule"),
    )
