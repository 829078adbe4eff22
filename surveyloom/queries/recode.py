"""Recodes, flags, regions, dates, respondents, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators import condense, panel, profile, stats
from surveyloom.queries.registry import money, number, query, table

REGIONS = (("North", ("NATION_1", "NATION_22")), ("South", ("NATION_2", "NATION_3")), ("East", ("NATION_4", "NATION_10")))


@query("region", """
SELECT n_name, CASE WHEN n_name IN ('NATION_1', 'NATION_22') THEN 'North' WHEN n_name IN ('NATION_2', 'NATION_3') THEN 'South'
                    WHEN n_name IN ('NATION_4', 'NATION_10') THEN 'East' ELSE 'Unknown' END AS region,
  CASE WHEN regexp_matches(n_name, 'NATION_1|NATION_22') THEN 'North' WHEN regexp_matches(n_name, 'NATION_2|NATION_3') THEN 'South'
       WHEN regexp_matches(n_name, 'NATION_4|NATION_10') THEN 'East' ELSE 'Unknown' END AS region_partial,
  count(DISTINCT c_custkey) AS accounts
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def region(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("accounts"))
    name = F.col("n_name")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", cells.region_exact(name, REGIONS).alias("region"), cells.region_partial(name, REGIONS).alias("region_partial"), "accounts"
    )


PLACES = tuple(dict.fromkeys(c for _, members in V.REGIONS_PARTIAL for c in members)) + ("Atlantis", "usa", "")


def _regions_sql(exact: bool) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    if exact:
        whens = [f"WHEN country IN ({', '.join(map(quote, members))}) THEN '{name}'" for name, members in V.REGIONS_EXACT]
    else:
        whens = [f"WHEN regexp_matches(country, {quote('|'.join(members))}) THEN '{name}'" for name, members in V.REGIONS_PARTIAL]
    return "CASE " + " ".join(whens) + " ELSE 'Unknown' END"


@query("region_lists", f"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN p || ' (' || c_mktsegment || ')' ELSE p END AS country
  FROM (SELECT *, [{', '.join(repr(x) for x in PLACES)}][c_custkey % {len(PLACES)} + 1] AS p FROM customer))
SELECT c_custkey, country, {_regions_sql(True)} AS region, {_regions_sql(False)} AS region_partial FROM c""")
def region_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Both rules over all countries of their lists, some with other words around them, some missing."""
    place = F.get(F.array(*[F.lit(x) for x in PLACES]), (F.col("c_custkey") % len(PLACES)).cast("int"))
    country = F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 0, F.concat(place, F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(place)
    rows = table(spark, folder, "customer").select("c_custkey", country.alias("country"))
    return rows.select("*", cells.region_exact(F.col("country")).alias("region"), cells.region_partial(F.col("country")).alias("region_partial"))


def _case(column: str, rules: tuple, default: str) -> str:
    whens = " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(column, p.replace("'", "''"), v) for p, v in rules)
    return f"CASE {whens} ELSE {default} END"


@query("industry", f"SELECT doc_id, {_case('text', V.INDUSTRY_RULES, 'NULL')} AS industry FROM documents")
def industry(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", cells.industry_category(F.col("text")).alias("industry"))


@query("initiative_flags", "SELECT doc_id, " + ", ".join(
    "CASE WHEN regexp_matches(text, '(?i){}') THEN 1 ELSE 0 END AS initiative_type_{}".format(p, n) for n, p in V.INITIATIVE_FLAGS
) + f", CASE WHEN text IS NULL OR regexp_matches(text, '(?i){V.INITIATIVE_NOT_ANSWERED}') THEN 1 ELSE 0 END AS \"initiative_type_NA\" FROM documents")
def initiative_flags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", *cells.initiative_flags(F.col("text")))


ANSWERS = "CASE WHEN p_size < 8 THEN NULL WHEN p_size < 16 THEN 'No, but we anticipate setting one in the next 2 years' WHEN p_size < 24 THEN 'Yes, but this target has not been approved' WHEN p_size < 30 THEN 'Yes' WHEN p_size < 36 THEN 'Renewable ' || p_name WHEN p_size < 42 THEN 'Absolute target, Intensity target' ELSE 'Yes, this target has been approved as ' || p_type END"


def _codes(column: str, codes: tuple) -> str:
    whens = " ".join("WHEN regexp_matches({}, '(?i){}') THEN {}".format(column, p.replace("'", "''"), v) for v, p in codes)
    return f"CASE WHEN {column} IS NULL THEN 0 {whens} END"


@query("recode_ordinal", f"""
WITH a AS (SELECT p_partkey, {ANSWERS} AS answer FROM part)
SELECT p_partkey, {_codes('answer', V.SCIENCE_BASED_INTENSITY_CODES)} AS intensity_code,
       {_codes('answer', V.SCIENCE_BASED_ABSOLUTE_CODES)} AS absolute_code, {_codes('answer', V.ACTIVE_TARGET_CODES)} AS active_code FROM a""")
def recode_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.col("answer")
    return table(spark, folder, "part").select("p_partkey", F.expr(ANSWERS).alias("answer")).select(
        "p_partkey",
        cells.ordinal_code(answer, V.SCIENCE_BASED_INTENSITY_CODES).alias("intensity_code"),
        cells.ordinal_code(answer, V.SCIENCE_BASED_ABSOLUTE_CODES).alias("absolute_code"),
        cells.ordinal_code(answer, V.ACTIVE_TARGET_CODES).alias("active_code"),
    )


@query("verified_flags", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate) + 19 AS year,
    CASE l_returnflag WHEN 'A' THEN 'Not verified' WHEN 'N' THEN '0.0' ELSE 'Third party' END AS v,
    CASE l_linestatus WHEN 'F' THEN 'Scope 1 and 2' ELSE 'Hidden Answer' END AS scope FROM lineitem)
SELECT year, sum(CASE WHEN year = 2020 AND v IN ('0.0', 'Not verified') THEN 0 WHEN year IN (2018, 2019) AND NOT regexp_matches(scope, '(?i)scope 1') THEN 0
   WHEN year BETWEEN 2010 AND 2017 AND v = 'Not verified' THEN 0 ELSE 1 END)::BIGINT AS verified, count(*) AS n FROM r GROUP BY 1""")
def verified_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        (F.year("l_shipdate") + 19).alias("year"),
        F.when(F.col("l_returnflag") == "A", "Not verified").when(F.col("l_returnflag") == "N", "0.0").otherwise("Third party").alias("v"),
        F.when(F.col("l_linestatus") == "F", "Scope 1 and 2").otherwise("Hidden Answer").alias("scope"),
    )
    flag = cells.verified_flag(F.col("year"), F.col("v"), F.col("scope"))
    return rows.groupBy("year").agg(F.sum(flag).alias("verified"), F.count(F.lit(1)).alias("n"))


@query("recipient_counts", r"""
WITH f AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'Investor list' WHEN 'O' THEN 'Supply Chain list' ELSE 'Inv and SC list' END AS filename FROM orders),
g AS (SELECT o_orderpriority, CASE WHEN regexp_matches(filename, 'Inv|Investor') AND NOT regexp_matches(filename, 'Supply Chain|SC') THEN 1 ELSE 0 END AS i,
  CASE WHEN regexp_matches(filename, 'Supply Chain|SC') AND NOT regexp_matches(filename, 'Inv|Investor') THEN 1 ELSE 0 END AS s,
  CASE WHEN regexp_matches(filename, 'Supply Chain|SC') AND regexp_matches(filename, 'Inv|Investor') THEN 1 ELSE 0 END AS b FROM f),
c AS (SELECT o_orderpriority, sum(i)::BIGINT AS count_investor, sum(s)::BIGINT AS count_supply_chain, sum(b)::BIGINT AS count_both FROM g GROUP BY 1)
SELECT o_orderpriority, unnest(['count_investor', 'count_supply_chain', 'count_both']) AS recipient_type, unnest([count_investor, count_supply_chain, count_both]) AS n,
  row_number() OVER (ORDER BY count_investor + count_supply_chain + count_both DESC, o_orderpriority) AS legend_rank FROM c""")
def recipient_counts(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "F", "Investor list").when(F.col("o_orderstatus") == "O", "Supply Chain list").otherwise("Inv and SC list")
    rows = table(spark, folder, "orders").select("o_orderpriority", *cells.recipient_flags(name))
    kinds = ("investor", "supply_chain", "both")
    counts = rows.groupBy("o_orderpriority").agg(*[F.sum("recipient_" + k).alias("count_" + k) for k in kinds])
    # Legend order: categories by their total; the window is over one row per category.
    total = F.col("count_investor") + F.col("count_supply_chain") + F.col("count_both")
    ranked = counts.withColumn("legend_rank", F.row_number().over(Window.orderBy(total.desc(), "o_orderpriority")).cast("long"))
    entries = F.array(*[F.struct(F.lit("count_" + k).alias("recipient_type"), F.col("count_" + k).alias("n")) for k in kinds])
    return ranked.select("o_orderpriority", "legend_rank", F.explode(entries).alias("e")).select("o_orderpriority", "e.recipient_type", "e.n", "legend_rank")


@query("respondent_breakdown", """
WITH t AS (SELECT user_id, ts::DATE AS day, string_agg(DISTINCT CASE event_type WHEN 'click' THEN 'investor' WHEN 'purchase' THEN 'supply_chain' ELSE event_type END, ', ') AS r FROM events GROUP BY 1, 2)
SELECT day::VARCHAR AS day, CASE WHEN contains(r, 'investor') AND contains(r, 'supply_chain') THEN 'both' WHEN contains(r, 'investor') THEN 'inv_only'
  WHEN contains(r, 'supply_chain') THEN 'sc_only' ELSE 'other' END AS respondent_type, count(DISTINCT user_id) AS n_accounts FROM t GROUP BY 1, 2""")
def respondent_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "investor").when(F.col("event_type") == "purchase", "supply_chain").otherwise(F.col("event_type"))
    rows = table(spark, folder, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), kind.alias("respondent"))
    joined = condense.condense(rows, ["user_id", "day"], {"respondents": "respondent"}, ["respondent"])
    return joined.groupBy("day", cells.respondent_type(F.col("respondents")).alias("respondent_type")).agg(F.count_distinct("user_id").alias("n_accounts"))


@query("pair_difference", """
WITH t AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderstatus, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3),
l AS (SELECT o_custkey, year, o_orderstatus, unnest(['total', 'n']) AS variable, unnest([total, n]) AS value FROM t),
w AS (SELECT o_custkey, year, variable, max(value) FILTER (o_orderstatus = 'F') AS f, max(value) FILTER (o_orderstatus = 'O') AS o FROM l GROUP BY 1, 2, 3)
SELECT o_custkey, year, variable, round(f - o, 4) AS difference FROM w WHERE f IS NOT NULL AND o IS NOT NULL AND f - o <> 0""")
def pair_difference(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus").agg(
        F.sum(money("o_totalprice")).cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("n")
    )
    out = panel.pair_differences(totals, ["o_custkey", "year"], "o_orderstatus", ("F", "O"), ["total", "n"])
    return out.withColumn("difference", F.round("difference", 4))


@query("fiscal_year", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) < 6 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS fiscal_year,
       o_orderdate::DATE AS parsed, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) END AS year_in_text FROM orders""")
def fiscal_year(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "MM/dd/yy")).when(F.col("o_orderstatus") == "O", F.date_format(day, "dd MMM yyyy"))
        .otherwise(day.cast("string"))
    )
    parsed = cells.parse_date(F.col("text"), "yyyy-MM-dd", "MM/dd/yy", "dd MMM yyyy")
    rows = table(spark, folder, "orders").select("o_orderkey", day.alias("day"), text.alias("text"))
    return rows.select(
        "o_orderkey", cells.fiscal_year(parsed).alias("fiscal_year"), parsed.alias("parsed"),
        cells.year_in_text(F.lit(None).cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("year_in_text"),
    )


@query("dedupe_lists", r"""
SELECT p_partkey, CASE WHEN p_name = p_type THEN p_name ELSE concat_ws(', ', lower(p_brand), lower(p_type), CASE WHEN lower(p_name) <> lower(p_type) THEN lower(p_name) END) END AS cleaned FROM part""")
def dedupe_lists(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat_ws(", ", F.lit("NA"), "p_brand", "p_type", "p_brand", F.concat(F.lit(" "), "p_name"), "p_type", F.lit("NA"))
    return table(spark, folder, "part").select("p_partkey", cells.dedupe_list_text(text, lower=True).alias("cleaned"))


@query("market_fields", r"""
SELECT c_custkey, round(c_nationkey * c_acctbal, 4) AS market_cap, c_mktsegment AS ticker_root, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS flag FROM customer""")
def market_fields(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    primary = F.when(F.col("c_nationkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" US"))).otherwise(F.col("c_mktsegment"))
    return customer.select(
        "c_custkey", F.round(cells.market_cap(F.col("c_nationkey"), F.col("c_acctbal")), 4).alias("market_cap"),
        cells.ticker_root(primary).alias("ticker_root"), (cells.ticker_root(primary) != primary).cast("int").alias("flag"),
    )


@query("primary_ids", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment WHEN c_nationkey % 3 = 1 THEN c_name END AS id FROM customer""")
def primary_ids(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("c_nationkey") % 3
    primary = F.when(kind == 0, F.col("c_mktsegment")).when(kind == 2, F.lit("0"))
    listed = F.concat(F.lit("NA, "), "c_name", F.lit(", other"))
    return table(spark, folder, "customer").select("c_custkey", cells.primary_isin(primary, listed).alias("id"))


OUTER_SQL = """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS final_priority FROM orders GROUP BY 1, 2),
p AS (SELECT c_custkey, year, total, final_priority, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, nullif(c_nationkey, 0) AS nation
      FROM customer FULL JOIN o ON c_custkey = o_custkey AND year < 1998)
"""


def outer_panel(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("total"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("final_priority")
    )
    customer = table(spark, folder, "customer")
    return customer.join(orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("year") < 1998), "full").select(
        "c_custkey", "year", "total", "final_priority", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
        F.nullif("c_nationkey", F.lit(0)).alias("nation"),
    )


FIELDS = ["total", "final_priority", "segment", "nation"]


@query("missing_patterns", OUTER_SQL + """
SELECT concat_ws('&', CASE WHEN total IS NULL OR total = 0 THEN 'total' END, CASE WHEN final_priority IS NULL THEN 'final_priority' END,
  CASE WHEN segment IS NULL THEN 'segment' END, CASE WHEN nation IS NULL OR nation = 0 THEN 'nation' END) AS missing, count(*) AS n FROM p GROUP BY 1""")
def missing_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing_patterns(outer_panel(spark, folder), FIELDS)


@query("missing_summary", OUTER_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*) * 100, 6) AS pct_missing FROM p" for c in FIELDS))
def missing_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.missing_summary(outer_panel(spark, folder), FIELDS)
    return out.withColumn("pct_missing", number(F.col("pct_missing")))


@query("completeness", OUTER_SQL + "SELECT year, " + ", ".join(f"round(count({c}) / count(*), 6) AS {c}" for c in FIELDS) + " FROM p GROUP BY 1")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.completeness(outer_panel(spark, folder), "year", FIELDS)
    return out.select("year", *[number(F.col(c)).alias(c) for c in FIELDS])


@query("distinct_with_value", OUTER_SQL + "SELECT year, " + ", ".join(
    f"count(DISTINCT CASE WHEN {c} IS NOT NULL THEN c_custkey END) AS n_{c}" for c in FIELDS) + " FROM p WHERE c_custkey IS NOT NULL GROUP BY 1")
def distinct_with_value(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_with_value(outer_panel(spark, folder).filter("c_custkey is not null"), "year", "c_custkey", {"n_" + c: c for c in FIELDS})


@query("fillable_keys", OUTER_SQL + """
SELECT DISTINCT c_custkey FROM p WHERE segment IS NULL AND c_custkey IS NOT NULL AND (total IS NOT NULL OR nation IS NOT NULL)""")
def fillable_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = outer_panel(spark, folder)
    return rows.filter(F.col("segment").isNull() & F.col("c_custkey").isNotNull() & (F.col("total").isNotNull() | F.col("nation").isNotNull())).select("c_custkey").distinct()


@query("share_posterior", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, n + 1 AS alpha, ((SELECT count(*) FROM orders) - n + 1)::BIGINT AS beta, round((n + 1) / ((SELECT count(*) FROM orders) + 2), 6) AS mean_share FROM c""")
def share_posterior(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.share_posterior(table(spark, folder, "orders"), "o_orderpriority")
    return out.withColumn("mean_share", number(F.col("mean_share")))
