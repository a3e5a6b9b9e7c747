"""Coverage queries (C16-C28): fact explosion, entity summary, totals, shares, top-k,
growth series, regional distinct counts.

Stand-ins on the driver tables:

* a "paper" is an order; its country list is its customer's nation written as in
  :func:`raterspark.plans.linkage_q.raw_names` (plus a non-country for pending orders);
  its categories are 0/1 flags from priority and status; its year is the order year.
  The "None" flag is priority 5-LOW.
* a "survey" is an order too, with a year string that can be a range ("1995 - 1999")
  and a list of repeat years; its country list may repeat the same country.
* "exposure" per country = mean balance / 250 of its suppliers in the newer edition of the
  table (even keys), or of those in the older one (odd keys) if the newer has none;
  "population" = sum of customer balances; the income-group dimension is the region of
  the nation, with one fixed override.
* topic shares use ``events``: item = user, topic = event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterspark.functions.nulls import if_else3, not_in, paste0, sum_strict
from raterspark.functions.text import capitalize_first, pattern_flag
from raterspark.operators import linkage as lk
from raterspark.operators import reshape as rs
from raterspark.operators import summary as sm
from raterspark.operators.ordering import order_by_measure
from raterspark.plans.common import r6, table
from raterspark.plans.linkage_q import DROP_NAMES, NAME_FIXES, raw_names
from raterspark.sources.io import materialize

FLAGS = ["cat_urgent", "cat_high", "cat_open", "cat_fulfilled"]
# Fixed values of the stand-in.
YEAR_RANGES = {"1995 - 1999": "1997", "1996 - 2000": "1998"}
NEWER_EDITION = "s_suppkey % 2 = 0"
EXPOSURE_BREAKS = [0, 10, 15, 25, 35, 100]
EXPOSURE_LABELS = ["very low", "low", "medium", "high", "very high"]
EXPOSURE_RANGES = {
    "Very low": "Very low\n<10", "Low": "Low\n10-15", "Medium": "Medium\n15-25", "High": "High\n25-35", "Very high": "Very high\n35+",
}
REGION_OVERRIDE = {"nation": 5, "region": "ASIA"}


def _nation_dims(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    dim = nation.select("n_name", F.col("n_nationkey").alias("n_code"))
    patterns = nation.select(
        F.col("n_nationkey").alias("n_code"),
        F.concat(F.lit("(?i)^nation[ _-]*"), F.col("n_nationkey").cast("string"), F.lit("$")).alias("pattern"),
    )
    return dim, patterns


def _conform(spark, sf_dir, df, col):
    dim, patterns = _nation_dims(spark, sf_dir)
    return lk.conform_names(
        df, col, dim, "n_name", "n_code", patterns, fixes=NAME_FIXES, drop_values=DROP_NAMES,
        code_col="n_code", keep_unmatched=True,
    )


def _flagged_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("cat_urgent"),
        (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("cat_high"),
        (F.col("o_orderstatus") == "O").cast("int").alias("cat_open"),
        (F.col("o_orderstatus") == "F").cast("int").alias("cat_fulfilled"),
        (F.col("o_orderpriority") == "5-LOW").cast("int").alias("cat_none"),
    )


def _paper_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper x country name rows, names as they are written."""
    o = _flagged_orders(spark, sf_dir)
    names = raw_names(spark, sf_dir)
    docs = o.join(names, o.o_custkey == names.c_custkey, "inner")
    countries = F.when(F.col("o_orderstatus") == "P", F.concat(F.col("raw_name"), F.lit(", Unknown land"))).otherwise(
        F.col("raw_name")
    )
    docs = docs.select("o_orderkey", "year", "o_custkey", "o_totalprice", *FLAGS, "cat_none", countries.alias("country"))
    return rs.explode_tokens(docs, "country", r",\s*")


def paper_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper x country rows (before the category explosion)."""
    return _conform(spark, sf_dir, _paper_names(spark, sf_dir), "country")


def q_fact_explode(spark, sf_dir):
    """Paper x country x category facts with year."""
    pc = paper_countries(spark, sf_dir)
    facts = rs.flags_to_long(pc, FLAGS, drop=["cat_none"])
    return facts.select("o_orderkey", "country", "n_code", "year", "category")


def _survey_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey x country name x year rows, names as they are written."""
    o = _flagged_orders(spark, sf_dir)
    names = raw_names(spark, sf_dir)
    s = o.join(names, o.o_custkey == names.c_custkey, "inner")
    y = F.col("year")
    year_str = F.when(
        F.col("o_orderstatus") == "P", F.concat(y.cast("string"), F.lit(" - "), (y + 4).cast("string"))
    ).otherwise(y.cast("string"))
    repeated = (
        F.when(F.col("o_orderpriority") == "3-MEDIUM",
               F.concat((y + 1).cast("string"), F.lit("; "), (y + 2).cast("string")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
    )
    countries = F.when(
        F.col("o_orderstatus") == "F", F.concat(F.col("raw_name"), F.lit("; "), F.col("raw_name"))
    ).otherwise(F.col("raw_name"))
    s = s.select(
        "o_orderkey", "o_totalprice", "o_orderpriority", *FLAGS,
        year_str.alias("year_str"), repeated.alias("repeated"), countries.alias("country"),
    )
    s = rs.expand_years(s, "year_str", "repeated", YEAR_RANGES, out_col="year")
    return rs.explode_tokens(s, "country", r";\s*")


def survey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey x country x year rows with categories still wide."""
    return _conform(spark, sf_dir, _survey_names(spark, sf_dir), "country")


def q_fact_explode_years(spark, sf_dir):
    """C17: survey x country x (year + repeat years) x category, ranges collapsed."""
    facts = rs.flags_to_long(survey_rows(spark, sf_dir), FLAGS)
    return facts.select("o_orderkey", "country", "n_code", "year", "category")


def _entity_base(spark, sf_dir) -> DataFrame:
    # Literal label filter (whole-table flag sum, then None != 1) and incidence counts: the
    # papers are read once, tallied by name as written; the few names are conformed then.
    tallies = sm.label_tallies(_paper_names(spark, sf_dir), FLAGS, "cat_none", ["country"])
    tallies = _conform(spark, sf_dir, materialize(tallies, "paper_tallies"), "country")
    papers = sm.labelled_entity_counts(tallies, "n_code", out="n_papers")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_code"), "s_acctbal", "s_suppkey")
    newer, older = supp.where(NEWER_EDITION), supp.where(f"not ({NEWER_EDITION})")
    # Scale 1/250: averages of 2-decimal amounts stay exact at 6 decimals (1/200 would
    # land on rounding ties that the last bit of an average can flip).
    exposure = sm.first_source([newer, older], "n_code", "exposure_source", exposure=F.avg("s_acctbal") / 250)
    j = rs.full_outer(papers, exposure, ["n_code"])
    return j.withColumn("n_papers", F.coalesce(F.col("n_papers"), F.lit(0)).cast("long"))


def _with_source(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_flag", pattern_flag("o_orderpriority", "urgent", also_equal="2-HIGH"))


def _survey_facts(spark, sf_dir) -> DataFrame:
    return _with_source(survey_rows(spark, sf_dir))


def _geo(spark, sf_dir) -> DataFrame:
    """Country group dimension (region of the nation) with its fixed override."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("n_code"), "r_name"
    )
    override = spark.createDataFrame([tuple(REGION_OVERRIDE.values())], "n_code int, r_name string")
    return lk.apply_overrides(geo, override, "n_code", "r_name")


def _survey_counts(spark, sf_dir) -> DataFrame:
    """Surveys per (country, source flag), for the per-country totals and the source split:
    one pass over the facts, counted by name as written; the few names are conformed then."""
    named = _with_source(_survey_names(spark, sf_dir)).groupBy("country", "source_flag").agg(F.count(F.lit(1)).alias("n"))
    named = _conform(spark, sf_dir, materialize(named, "survey_tallies"), "country")
    return named.groupBy("n_code", "source_flag").agg(F.sum("n").alias("n_surveys"))


def _entity_summary(spark, sf_dir, survey_counts: DataFrame | None = None) -> DataFrame:
    base = _entity_base(spark, sf_dir)
    counts = survey_counts if survey_counts is not None else _survey_counts(spark, sf_dir)
    surveys = counts.groupBy("n_code").agg(F.sum("n_surveys").alias("n_surveys"))
    j = rs.full_outer(base, surveys, ["n_code"])
    j = j.withColumn("n_surveys", F.coalesce(F.col("n_surveys"), F.lit(0)).cast("long"))
    cust = table(spark, sf_dir, "customer")
    pop = cust.groupBy(F.col("c_nationkey").alias("n_code")).agg(sum_strict("c_acctbal").alias("population"))
    j = j.join(pop, "n_code", "left")
    j = j.join(_geo(spark, sf_dir), "n_code", "left")
    return j.select(
        "n_code", "n_papers", "exposure", "exposure_source", "n_surveys", "population",
        sm.bin_left_closed("exposure", EXPOSURE_BREAKS, EXPOSURE_LABELS).alias("category_exposure"),
        if_else3(F.col("n_code") == 1, 1, 0).alias("is_n1"),
        if_else3(F.col("n_code") == 2, 1, 0).alias("is_n2"),
        "r_name",
    )


def q_entity_summary(spark, sf_dir):
    """Per country papers, exposure, surveys, population, bin, flags, region."""
    e = _entity_summary(spark, sf_dir)
    return e.select(
        "n_code", "n_papers", r6("exposure").alias("exposure"), "exposure_source", "n_surveys", r6("population").alias("population"),
        "category_exposure", "is_n1", "is_n2", "r_name",
    )


def _source_split(spark, sf_dir, *cols: str) -> DataFrame:
    counts = _survey_counts(spark, sf_dir)
    e = _entity_summary(spark, sf_dir, counts).select("n_code", *cols)
    grid = rs.with_domain(e, "source_flag", [0, 1])
    j = rs.full_outer(grid, counts, ["n_code", "source_flag"])
    return j.withColumn("n_surveys", F.coalesce(F.col("n_surveys"), F.lit(0)).cast("long"))


def q_source_split(spark, sf_dir):
    """Country x source flag grid with survey counts, zero-filled."""
    j = _source_split(spark, sf_dir, "n_papers", "r_name")
    return j.select("n_code", "source_flag", "n_papers", "r_name", "n_surveys")


def _highlighted(entities: DataFrame) -> DataFrame:
    split = F.when(F.col("n_code") == 1, "N1").when(F.col("n_code") == 2, "N2").otherwise("Rest")
    return entities.withColumn("split", split)


def _by_source(entities: DataFrame) -> DataFrame:
    return entities.withColumn("split", F.when(F.col("source_flag") == 1, "Flagged").otherwise("Rest"))


def _exposure_levels(totals: DataFrame) -> DataFrame:
    """Bins as ordered levels, with the label that has the bin's range under the name."""
    name = capitalize_first("category_exposure")
    return totals.select(
        lk.recode(name, EXPOSURE_RANGES).alias("category"),
        sm.ordered_level(name, list(EXPOSURE_RANGES)).alias("level"), "split", "n",
    )


def q_group_totals(spark, sf_dir):
    """C20: papers per region split into NATION_1 / NATION_2 / Rest, plus region totals."""
    return sm.group_totals(_highlighted(_entity_summary(spark, sf_dir)), "r_name", "split", "n_papers")


def q_group_totals_surveys(spark, sf_dir):
    """C20: surveys per region with the same split; countries without a region left out."""
    e = _highlighted(_entity_summary(spark, sf_dir))
    return sm.group_totals(e, "r_name", "split", "n_surveys", keep_null_group=False)


def q_group_totals_exposure(spark, sf_dir):
    """C20/P20/F8: papers per exposure bin with the same split, bins as ordered levels."""
    e = _highlighted(_entity_summary(spark, sf_dir))
    return _exposure_levels(sm.group_totals(e, "category_exposure", "split", "n_papers", keep_null_group=False))


def q_group_totals_by_source(spark, sf_dir):
    """C20: surveys per region split by source flag."""
    e = _by_source(_source_split(spark, sf_dir, "r_name"))
    return sm.group_totals(e, "r_name", "split", "n_surveys", keep_null_group=False)


def q_exposure_totals_by_source(spark, sf_dir):
    """C20/P20/F8: surveys per exposure bin split by source flag, bins as ordered levels."""
    e = _by_source(_source_split(spark, sf_dir, "category_exposure"))
    return _exposure_levels(sm.group_totals(e, "category_exposure", "split", "n_surveys", keep_null_group=False))


def _survey_share(spark, sf_dir, facts: DataFrame) -> DataFrame:
    # The group of a country comes from the country summary, whose group column is the
    # geography dimension: join that dimension directly.
    j = facts.where(F.col("n_code").isNotNull()).join(_geo(spark, sf_dir), "n_code", "left")
    j = j.withColumn("item_id", paste0("n_code", "o_orderkey", "year"))
    t = sm.topic_share_within(j, "item_id", "category", "r_name")
    return t.select("r_name", "category", "n_items", "n_total", r6("share").alias("share"))


def q_survey_share_by_group(spark, sf_dir):
    """C24 over survey facts (the country coverage query): facts joined to the country
    group (region, with its override), surrogate item id = country || survey || year,
    distinct items per (group, category) over distinct items per group."""
    return _survey_share(spark, sf_dir, rs.flags_to_long(_survey_facts(spark, sf_dir), FLAGS))


def q_survey_share_by_group_excl(spark, sf_dir):
    """C24 without one source: the same over the facts that do not carry the source flag."""
    facts = _survey_facts(spark, sf_dir).where(not_in("source_flag", [1]))
    return _survey_share(spark, sf_dir, rs.flags_to_long(facts, FLAGS))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def q_topic_share(spark, sf_dir):
    """Distinct users per event type over distinct users."""
    t = sm.topic_share(_events(spark, sf_dir), "user_id", "event_type")
    return t.select("event_type", "n_items", "n_total", r6("share").alias("share"))


def q_topic_share_ranked(spark, sf_dir):
    """Topics with their place by number of users and the share as a percent label;
    events of one type in seven have no type here."""
    ev = _events(spark, sf_dir).withColumn("event_type", F.when(F.col("event_id") % 7 > 0, F.col("event_type")))
    t = order_by_measure(sm.topic_share(ev, "user_id", "event_type"), "event_type", "n_items")
    return t.select("event_type", "n_items", "level_rank", sm.percent_label("share").alias("label"))


def q_topic_share_excl(spark, sf_dir):
    """The same share without weekend events (NA-safe not-in)."""
    ev = _events(spark, sf_dir).where(not_in(F.dayofweek("ts"), [1, 7]))
    t = sm.topic_share(ev, "user_id", "event_type")
    return t.select("event_type", "n_items", "n_total", r6("share").alias("share"))


VALUE_BREAKS = [0, 10, 50, 100, 1000]
VALUE_LABELS = ["v0_10", "v10_50", "v50_100", "v100_1000"]


def q_topic_share_within(spark, sf_dir):
    """Distinct users per (value bin, type) over the bin's event count."""
    ev = _events(spark, sf_dir).withColumn("bin", sm.bin_left_closed("value", VALUE_BREAKS, VALUE_LABELS))
    denom = ev.groupBy("bin").agg(F.count(F.lit(1)).alias("n_total"))
    t = sm.topic_share_within(ev, "user_id", "event_type", "bin", denominator=denom)
    return t.select("bin", "event_type", "n_items", "n_total", r6("share").alias("share"))


def q_topic_share_grouping(spark, sf_dir):
    """Distinct users per (week, type) over distinct users of the week, one
    GROUPING SETS aggregate."""
    ev = _events(spark, sf_dir).withColumn("week", F.weekofyear("ts"))
    t = sm.topic_share_within(ev, "user_id", "event_type", "week")
    return t.select("week", "event_type", "n_items", "n_total", r6("share").alias("share"))


def _orders_per_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )


def q_top_k_ties(spark, sf_dir):
    """Top 20 customers by order count with ties, plus their nation."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counts = _orders_per_customer(spark, sf_dir)
    top = sm.top_k_ties(counts, "n_orders", 20)
    return top.join(cust, "c_custkey", "left").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select("c_custkey", "n_orders", "n_name", "rank")


def q_yearly_growth(spark, sf_dir):
    """Orders per customer and year, zero-filled over the observed year range,
    with the running total."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    counts = o.groupBy("c_custkey", "year").agg(F.count(F.lit(1)).alias("n"))
    full = rs.complete_years(counts, ["c_custkey"], "year", "n")
    return sm.cumulative(full, ["c_custkey"], "year", "n", "n_cum").select("c_custkey", "year", "n", "n_cum")


def _region_priority_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    j = o.join(cust, o.o_custkey == cust.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = j.groupBy(F.year("o_orderdate").alias("year"), "r_name", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rs.complete_observed(counts, ["year", "r_name", "o_orderpriority"], "n")


def q_yearly_growth_category(spark, sf_dir):
    """Orders per (region, priority, year) completed over observed combinations,
    with running totals per (region, priority)."""
    full = _region_priority_year(spark, sf_dir)
    return sm.cumulative(full, ["r_name", "o_orderpriority"], "year", "n", "n_cum").select(
        "r_name", "o_orderpriority", "year", "n", "n_cum"
    )


def q_yearly_growth_total(spark, sf_dir):
    """The same summed over regions, running total per priority and the
    priority order by the last cumulative value."""
    full = _region_priority_year(spark, sf_dir)
    tot = full.groupBy("o_orderpriority", "year").agg(F.sum("n").alias("n"))
    cum = sm.cumulative(tot, ["o_orderpriority"], "year", "n", "n_cum")
    ranks = sm.last_value_rank(cum, "o_orderpriority", "year", "n_cum")
    return cum.join(ranks, "o_orderpriority").select("o_orderpriority", "year", "n", "n_cum", "level_rank")


def q_regional_distinct(spark, sf_dir):
    """Distinct customers with orders, per region."""
    o = table(spark, sf_dir, "orders").select("o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    j = o.join(cust, o.o_custkey == cust.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name").agg(F.count_distinct("o_custkey").alias("n_customers"))


QUERIES = {
    "fact_explode": q_fact_explode,
    "fact_explode_years": q_fact_explode_years,
    "entity_summary": q_entity_summary,
    "source_split": q_source_split,
    "group_totals": q_group_totals,
    "group_totals_surveys": q_group_totals_surveys,
    "group_totals_exposure": q_group_totals_exposure,
    "group_totals_by_source": q_group_totals_by_source,
    "exposure_totals_by_source": q_exposure_totals_by_source,
    "topic_share": q_topic_share,
    "topic_share_ranked": q_topic_share_ranked,
    "topic_share_excl": q_topic_share_excl,
    "topic_share_within": q_topic_share_within,
    "topic_share_grouping": q_topic_share_grouping,
    "survey_share_by_group": q_survey_share_by_group,
    "survey_share_by_group_excl": q_survey_share_by_group_excl,
    "top_k_ties": q_top_k_ties,
    "yearly_growth": q_yearly_growth,
    "yearly_growth_category": q_yearly_growth_category,
    "yearly_growth_total": q_yearly_growth_total,
    "regional_distinct": q_regional_distinct,
}


# ----------------------------------------------------------------------------------
# SQL oracles
# ----------------------------------------------------------------------------------

_RAW_SQL = """
raw AS (
  SELECT c.c_custkey,
         CASE c.c_custkey % 7
           WHEN 0 THEN n.n_name WHEN 1 THEN lower(n.n_name)
           WHEN 2 THEN replace(n.n_name, '_', ' ') WHEN 3 THEN '  ' || n.n_name || ' '
           WHEN 4 THEN replace(n.n_name, 'NATION', 'NATOIN') WHEN 5 THEN replace(n.n_name, '_', '-')
           ELSE 'Unknown land' END AS raw_name
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
fo AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS cat_urgent,
         CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS cat_high,
         CAST(o_orderstatus = 'O' AS INTEGER) AS cat_open,
         CAST(o_orderstatus = 'F' AS INTEGER) AS cat_fulfilled,
         CAST(o_orderpriority = '5-LOW' AS INTEGER) AS cat_none
  FROM orders)"""


def _conform_sql(src: str, out: str) -> str:
    """CTEs mapping column ``country`` of ``src`` to ``n_code`` (unmatched kept)."""
    return f"""
{out}_n AS (
  SELECT *, CASE regexp_replace(country, '^\\s+|\\s+$', '', 'g')
              WHEN 'NATOIN_3' THEN 'NATION_3' WHEN 'NATOIN_7' THEN 'NATION_7'
              ELSE regexp_replace(country, '^\\s+|\\s+$', '', 'g') END AS nm
  FROM {src}),
{out}_k AS (SELECT * FROM {out}_n WHERE nm IS NULL OR nm NOT IN ('', 'Unknown land')),
{out}_names AS (SELECT DISTINCT nm FROM {out}_k WHERE nm IS NOT NULL),
{out}_ex AS (
  SELECT x.nm, min(n.n_nationkey) AS code
  FROM {out}_names x LEFT JOIN nation n ON lower(x.nm) = lower(n.n_name) GROUP BY x.nm),
{out}_rx AS (
  SELECT e.nm, min(n.n_nationkey) AS rcode
  FROM {out}_ex e JOIN nation n
    ON regexp_matches(e.nm, '(?i)^nation[ _-]*' || CAST(n.n_nationkey AS VARCHAR) || '$')
  WHERE e.code IS NULL GROUP BY e.nm),
{out}_codes AS (SELECT e.nm, coalesce(e.code, r.rcode) AS n_code FROM {out}_ex e LEFT JOIN {out}_rx r USING (nm)),
{out} AS (
  SELECT k.* EXCLUDE (nm), c.n_code
  FROM {out}_k k LEFT JOIN {out}_codes c ON k.nm = c.nm)"""


_PAPERS_SQL = _RAW_SQL + """,
pcs AS (
  SELECT fo.*, CASE WHEN fo.o_orderstatus = 'P' THEN r.raw_name || ', Unknown land' ELSE r.raw_name END AS countries
  FROM fo JOIN raw r ON fo.o_custkey = r.c_custkey),
pct AS (
  SELECT pcs.* EXCLUDE (countries), regexp_replace(t.x, '^\\s+|\\s+$', '', 'g') AS country
  FROM pcs, unnest(string_split_regex(pcs.countries, ',\\s*')) AS t(x)),""" + _conform_sql("pct", "pc")

_SURVEYS_SQL = """,
sv0 AS (
  SELECT fo.o_orderkey, fo.o_totalprice, fo.o_orderpriority,
         fo.cat_urgent, fo.cat_high, fo.cat_open, fo.cat_fulfilled,
         CASE WHEN fo.o_orderstatus = 'P' THEN CAST(fo.year AS VARCHAR) || ' - ' || CAST(fo.year + 4 AS VARCHAR)
              ELSE CAST(fo.year AS VARCHAR) END AS ys,
         CASE WHEN fo.o_orderpriority = '3-MEDIUM' THEN CAST(fo.year + 1 AS VARCHAR) || '; ' || CAST(fo.year + 2 AS VARCHAR)
              WHEN fo.o_orderpriority = '4-NOT SPECIFIED' THEN '' END AS rep,
         CASE WHEN fo.o_orderstatus = 'F' THEN r.raw_name || '; ' || r.raw_name ELSE r.raw_name END AS countries
  FROM fo JOIN raw r ON fo.o_custkey = r.c_custkey),
sv1 AS (
  SELECT sv0.* EXCLUDE (ys),
         CASE ys WHEN '1995 - 1999' THEN '1997' WHEN '1996 - 2000' THEN '1998' ELSE ys END AS year_str
  FROM sv0),
sv2 AS (
  SELECT sv1.* EXCLUDE (year_str, rep),
         regexp_replace(CASE WHEN rep IS NULL OR rep = '' THEN year_str
                             ELSE coalesce(year_str, 'NA') || ';' || rep END, '\\s+', '', 'g') AS all_years
  FROM sv1),
sv3 AS (
  SELECT sv2.* EXCLUDE (all_years), TRY_CAST(t.y AS INTEGER) AS year
  FROM sv2, unnest(string_split(all_years, ';')) AS t(y)),
sv4 AS (
  SELECT sv3.* EXCLUDE (countries), regexp_replace(t.x, '^\\s+|\\s+$', '', 'g') AS country
  FROM sv3, unnest(string_split_regex(sv3.countries, ';\\s*')) AS t(x)),""" + _conform_sql("sv4", "svc")


def _flags_union(src: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT o_orderkey, country, n_code, year, '{f}' AS category FROM {src} WHERE {f} = 1" for f in FLAGS
    )


def _bins_sql(col: str, breaks, labels) -> str:
    parts = " ".join(
        f"WHEN {col} >= {lo} AND {col} < {hi} THEN '{lab}'" for lo, hi, lab in zip(breaks[:-1], breaks[1:], labels)
    )
    return f"CASE {parts} END"


_ENTITY_SQL = "WITH " + _PAPERS_SQL + _SURVEYS_SQL + f""",
pcr AS (SELECT * FROM pc),
anyf AS (SELECT sum(cat_urgent + cat_high + cat_open + cat_fulfilled) AS s FROM pcr),
papers AS (
  SELECT n_code, count(*) AS n_papers FROM pcr
  WHERE (SELECT s FROM anyf) >= 1 AND cat_none <> 1 GROUP BY n_code),
expo AS (
  SELECT s_nationkey AS n_code,
         coalesce(avg(s_acctbal) FILTER (s_suppkey % 2 = 0), avg(s_acctbal)) / 250 AS exposure,
         CASE WHEN count(*) FILTER (s_suppkey % 2 = 0) > 0 THEN 1 ELSE 2 END AS exposure_source
  FROM supplier GROUP BY s_nationkey),
base AS (
  SELECT coalesce(p.n_code, e.n_code) AS n_code, coalesce(p.n_papers, 0) AS n_papers, e.exposure, e.exposure_source
  FROM papers p FULL OUTER JOIN expo e ON p.n_code IS NOT DISTINCT FROM e.n_code),
sfx AS (
  SELECT *, CAST(regexp_matches(o_orderpriority, '(?i)urgent') OR o_orderpriority = '2-HIGH' AS INTEGER) AS source_flag
  FROM svc),
surv AS (SELECT n_code, count(*) AS n_surveys FROM sfx GROUP BY n_code),
jj AS (
  SELECT coalesce(b.n_code, s.n_code) AS n_code, b.n_papers, b.exposure, b.exposure_source, coalesce(s.n_surveys, 0) AS n_surveys
  FROM base b FULL OUTER JOIN surv s ON b.n_code IS NOT DISTINCT FROM s.n_code),
pop AS (
  SELECT c_nationkey AS n_code,
         CASE WHEN count(*) FILTER (WHERE c_acctbal IS NULL) = 0 THEN sum(c_acctbal) END AS population
  FROM customer GROUP BY c_nationkey),
geo AS (
  SELECT n.n_nationkey AS n_code, CASE WHEN n.n_nationkey = 5 THEN 'ASIA' ELSE r.r_name END AS r_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
ent AS (
  SELECT jj.n_code, jj.n_papers, jj.exposure, jj.exposure_source, jj.n_surveys, pop.population,
         {_bins_sql('jj.exposure', EXPOSURE_BREAKS, EXPOSURE_LABELS)} AS category_exposure,
         CASE WHEN jj.n_code IS NULL THEN NULL WHEN jj.n_code = 1 THEN 1 ELSE 0 END AS is_n1,
         CASE WHEN jj.n_code IS NULL THEN NULL WHEN jj.n_code = 2 THEN 1 ELSE 0 END AS is_n2,
         geo.r_name
  FROM jj LEFT JOIN pop ON jj.n_code = pop.n_code LEFT JOIN geo ON jj.n_code = geo.n_code)
"""

_GEO_SQL = """
geo AS (SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

_RPY_SQL = "WITH " + _GEO_SQL + """,
c AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, g.r_name, o.o_orderpriority, count(*) AS n
  FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN geo g ON cu.c_nationkey = g.n_nationkey
  GROUP BY ALL),
grid AS (
  SELECT y.year, r.r_name, p.o_orderpriority
  FROM (SELECT DISTINCT year FROM c) y, (SELECT DISTINCT r_name FROM c) r, (SELECT DISTINCT o_orderpriority FROM c) p),
full_ AS (
  SELECT grid.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM grid LEFT JOIN c USING (year, r_name, o_orderpriority))
"""

_SPLIT_SQL = """,
grid AS (SELECT DISTINCT n_code, n_papers, category_exposure, r_name FROM ent),
gf AS (SELECT grid.*, f.source_flag FROM grid, (VALUES (0), (1)) AS f(source_flag)),
cnt AS (SELECT n_code, source_flag, count(*) AS n_surveys FROM sfx GROUP BY n_code, source_flag),
split_ AS (
  SELECT coalesce(gf.n_code, cnt.n_code) AS n_code, coalesce(gf.source_flag, cnt.source_flag) AS source_flag,
         gf.n_papers, gf.category_exposure, gf.r_name, CAST(coalesce(cnt.n_surveys, 0) AS BIGINT) AS n_surveys
  FROM gf FULL OUTER JOIN cnt
    ON gf.n_code IS NOT DISTINCT FROM cnt.n_code AND gf.source_flag = cnt.source_flag)"""

_HIGHLIGHT_SQL = "CASE WHEN n_code = 1 THEN 'N1' WHEN n_code = 2 THEN 'N2' ELSE 'Rest' END"
_SOURCE_SQL = "CASE WHEN source_flag = 1 THEN 'Flagged' ELSE 'Rest' END"


def _totals_sql(src: str, group: str, measure: str, split: str, keep: str | None = None) -> str:
    return f"""
SELECT {group}, CASE WHEN GROUPING(split) = 0 THEN split END AS split, CAST(coalesce(sum({measure}), 0) AS BIGINT) AS n
FROM (SELECT *, {split} AS split FROM {src} WHERE {keep or f"{group} IS NOT NULL"})
GROUP BY GROUPING SETS (({group}, split), ({group}))"""


def _levels_sql(totals: str) -> str:
    whens = lambda pick: " ".join(
        f"WHEN '{lab}' THEN {pick(k, text)}" for k, (lab, text) in enumerate(zip(EXPOSURE_LABELS, EXPOSURE_RANGES.values()), 1)
    )
    return f""", totals AS ({totals})
SELECT CASE category_exposure {whens(lambda k, text: "'" + text + "'")} END AS category,
       CASE category_exposure {whens(lambda k, text: k)} END AS level, split, n FROM totals"""


ORACLE = {
    "fact_explode": "WITH " + _PAPERS_SQL + "\nSELECT * FROM (" + _flags_union("pc") + ")",
    "fact_explode_years": "WITH " + _RAW_SQL + _SURVEYS_SQL + "\nSELECT * FROM (" + _flags_union("svc") + ")",
    "entity_summary": _ENTITY_SQL + """
SELECT n_code, n_papers, round(exposure, 6) AS exposure, exposure_source, n_surveys, round(population, 6) AS population,
       category_exposure, is_n1, is_n2, r_name FROM ent""",
    "source_split": _ENTITY_SQL + _SPLIT_SQL + """
SELECT n_code, source_flag, n_papers, r_name, n_surveys FROM split_""",
    "group_totals": _ENTITY_SQL + _totals_sql("ent", "r_name", "n_papers", _HIGHLIGHT_SQL, "true"),
    "group_totals_surveys": _ENTITY_SQL + _totals_sql("ent", "r_name", "n_surveys", _HIGHLIGHT_SQL),
    "group_totals_exposure": _ENTITY_SQL + _levels_sql(_totals_sql("ent", "category_exposure", "n_papers", _HIGHLIGHT_SQL)),
    "group_totals_by_source": _ENTITY_SQL + _SPLIT_SQL + _totals_sql("split_", "r_name", "n_surveys", _SOURCE_SQL),
    "exposure_totals_by_source": _ENTITY_SQL + _SPLIT_SQL
    + _levels_sql(_totals_sql("split_", "category_exposure", "n_surveys", _SOURCE_SQL)),
    "topic_share_ranked": """
WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 7 > 0 THEN event_type END AS event_type) FROM events),
s AS (SELECT event_type, count(DISTINCT user_id) AS n_items FROM e GROUP BY event_type)
SELECT event_type, n_items, CAST(dense_rank() OVER (ORDER BY n_items DESC) AS INTEGER) AS level_rank,
       CAST(CAST(round(100 * n_items / (SELECT count(DISTINCT user_id) FROM e)) AS BIGINT) AS VARCHAR) || '%' AS label
FROM s""",
    "topic_share": """
WITH t AS (SELECT count(DISTINCT user_id) AS n_total FROM events)
SELECT event_type, count(DISTINCT user_id) AS n_items, (SELECT n_total FROM t) AS n_total,
       round(count(DISTINCT user_id) / (SELECT n_total FROM t), 6) AS share
FROM events GROUP BY event_type""",
    "topic_share_excl": """
WITH e AS (SELECT * FROM events WHERE dayofweek(ts) NOT IN (0, 6)),
t AS (SELECT count(DISTINCT user_id) AS n_total FROM e)
SELECT event_type, count(DISTINCT user_id) AS n_items, (SELECT n_total FROM t) AS n_total,
       round(count(DISTINCT user_id) / (SELECT n_total FROM t), 6) AS share
FROM e GROUP BY event_type""",
    "topic_share_within": f"""
WITH e AS (SELECT *, {_bins_sql('value', VALUE_BREAKS, VALUE_LABELS)} AS bin FROM events),
d AS (SELECT bin, count(*) AS n_total FROM e GROUP BY bin),
n AS (SELECT bin, event_type, count(DISTINCT user_id) AS n_items FROM e GROUP BY bin, event_type)
SELECT n.bin, n.event_type, n.n_items, d.n_total, round(n.n_items / d.n_total, 6) AS share
FROM n LEFT JOIN d ON n.bin = d.bin""",
    "topic_share_grouping": """
WITH e AS (SELECT *, CAST(weekofyear(ts) AS INTEGER) AS week FROM events),
a AS (
  SELECT week, event_type, GROUPING(event_type) AS gs, count(DISTINCT user_id) AS n
  FROM e GROUP BY GROUPING SETS ((week, event_type), (week)))
SELECT d.week, d.event_type, d.n AS n_items, t.n AS n_total, round(d.n / t.n, 6) AS share
FROM a d LEFT JOIN a t ON d.week = t.week AND t.gs = 1
WHERE d.gs = 0""",
    "top_k_ties": """
WITH c AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
r AS (SELECT *, CAST(rank() OVER (ORDER BY n_orders DESC) AS INTEGER) AS rank FROM c)
SELECT r.c_custkey, r.n_orders, n.n_name, r.rank
FROM r LEFT JOIN customer cu ON r.c_custkey = cu.c_custkey LEFT JOIN nation n ON cu.c_nationkey = n.n_nationkey
WHERE r.rank <= 20""",
    "yearly_growth": """
WITH c AS (
  SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n
  FROM orders GROUP BY ALL),
b AS (SELECT min(year) AS lo, max(year) AS hi FROM c),
y AS (SELECT CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS year FROM b),
grid AS (SELECT g.c_custkey, y.year FROM (SELECT DISTINCT c_custkey FROM c) g, y),
f AS (SELECT grid.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid LEFT JOIN c USING (c_custkey, year))
SELECT c_custkey, year, n,
       CAST(sum(n) OVER (PARTITION BY c_custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_cum
FROM f""",
    "yearly_growth_category": _RPY_SQL + """
SELECT r_name, o_orderpriority, year, n,
       CAST(sum(n) OVER (PARTITION BY r_name, o_orderpriority ORDER BY year
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_cum
FROM full_""",
    "yearly_growth_total": _RPY_SQL + """,
tot AS (SELECT o_orderpriority, year, CAST(sum(n) AS BIGINT) AS n FROM full_ GROUP BY o_orderpriority, year),
cum AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY year
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_cum
  FROM tot),
lastv AS (SELECT o_orderpriority, arg_max(n_cum, year) AS last FROM cum GROUP BY o_orderpriority),
rk AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY last DESC, o_orderpriority) AS INTEGER) AS level_rank FROM lastv)
SELECT cum.o_orderpriority, year, n, n_cum, level_rank FROM cum JOIN rk USING (o_orderpriority)""",
    "regional_distinct": "WITH " + _GEO_SQL + """
SELECT g.r_name, count(DISTINCT o.o_custkey) AS n_customers
FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey LEFT JOIN geo g ON cu.c_nationkey = g.n_nationkey
GROUP BY g.r_name""",
}

_SHARE_SQL = """,
sl AS (
  SELECT o_orderkey, n_code, year, 'cat_urgent' AS category FROM sfx WHERE cat_urgent = 1
  UNION ALL SELECT o_orderkey, n_code, year, 'cat_high' FROM sfx WHERE cat_high = 1
  UNION ALL SELECT o_orderkey, n_code, year, 'cat_open' FROM sfx WHERE cat_open = 1
  UNION ALL SELECT o_orderkey, n_code, year, 'cat_fulfilled' FROM sfx WHERE cat_fulfilled = 1),
sj AS (
  SELECT e.r_name, sl.category,
         coalesce(CAST(sl.n_code AS VARCHAR), 'NA') || coalesce(CAST(sl.o_orderkey AS VARCHAR), 'NA')
           || coalesce(CAST(sl.year AS VARCHAR), 'NA') AS item_id
  FROM sl LEFT JOIN (SELECT n_code, r_name FROM ent WHERE n_code IS NOT NULL) e ON sl.n_code = e.n_code
  WHERE sl.n_code IS NOT NULL),
d AS (SELECT r_name, category, count(DISTINCT item_id) AS n_items FROM sj GROUP BY r_name, category),
tt AS (SELECT r_name, count(DISTINCT item_id) AS n_total FROM sj GROUP BY r_name)
SELECT d.r_name, d.category, d.n_items, tt.n_total, round(d.n_items / tt.n_total, 6) AS share
FROM d LEFT JOIN tt ON d.r_name IS NOT DISTINCT FROM tt.r_name"""
ORACLE["survey_share_by_group"] = _ENTITY_SQL + _SHARE_SQL
ORACLE["survey_share_by_group_excl"] = _ENTITY_SQL + _SHARE_SQL.replace("FROM sfx", "FROM (SELECT * FROM sfx WHERE source_flag <> 1)")
