"""Amounts by year and band: currencies, pivots, quantiles, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import cells
from surveyloom.operators import bands, stats
from surveyloom.operators.ordered import exact_quantiles
from surveyloom.queries.registry import money, number, query, table
from surveyloom.session import literal_frame

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RATES = tuple(
    (year, code, rate + (year - 1995) / 8)
    for year in range(1995, 2001) for code, rate in (("USD", 1.0), ("EUR", 0.75), ("GBP", 0.5), ("CHF", 1.25))
)
SEGMENT_CURRENCY = "CASE c_mktsegment WHEN 'BUILDING' THEN 'EUR(€)' WHEN 'MACHINERY' THEN 'GBP' WHEN 'FURNITURE' THEN 'CHW' ELSE 'XXX' END"


def orders_years(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))


@query("currency_convert", f"""
WITH rates(year, code, rate) AS (VALUES {', '.join(str(r) for r in RATES)}),
o AS (SELECT o_orderkey, year(o_orderdate) AS year, o_totalprice, {SEGMENT_CURRENCY} AS spelling FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, CASE spelling WHEN 'EUR(€)' THEN 'EUR' WHEN 'CHW' THEN 'CHF' WHEN 'XXX' THEN 'USD' ELSE spelling END AS code FROM o)
SELECT o_orderkey, c.year, c.code AS currency, round(o_totalprice / rate::DOUBLE, 6) AS amount FROM c LEFT JOIN rates USING (year, code)""")
def currency_convert(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", F.expr(SEGMENT_CURRENCY).alias("spelling"))
    orders = orders_years(spark, folder).select("o_orderkey", "o_custkey", "year", F.col("o_totalprice").alias("amount"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("currency", cells.currency_code(F.col("spelling")))
    rates = literal_frame(spark, list(RATES), "year int, currency string, rate double")
    out = bands.convert_currency(rows, rates, "amount", "year", "currency", missing="null")
    return out.select("o_orderkey", "year", "currency", number(F.col("amount")).alias("amount"))


@query("stepwise_explode", """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS words, CASE WHEN p_size > 25 THEN [p_brand] ELSE [p_brand, p_type] END AS tags FROM part)
SELECT p_partkey, unnest(words) AS word, unnest(tags) AS tag FROM p WHERE len(words) = len(tags)""")
def stepwise_explode(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        "p_partkey", F.split("p_name", " ").alias("word"), F.when(F.col("p_size") > 25, F.array("p_brand")).otherwise(F.array("p_brand", "p_type")).alias("tag")
    )
    return bands.explode_together(part, ["word", "tag"])


@query("usable_amounts", """
SELECT o_orderkey, o_totalprice AS amount, o_orderpriority AS band FROM orders
WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 0""")
def usable_amounts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    amount = F.when(F.col("o_orderstatus") == "F", "Hidden Answer").otherwise(F.col("o_totalprice").cast("string"))
    band = F.when(F.col("o_orderpriority") == "5-LOW", "Question not applicable").otherwise(F.col("o_orderpriority"))
    return bands.usable_amounts(orders.select("o_orderkey", amount.alias("amount"), band.alias("band")), "amount", ["band"])


def _pivot_sql(cell: str) -> str:
    cols = ", ".join(f"coalesce({cell} FILTER (o_orderpriority = '{p}'), 0) AS \"{p}\"" for p in PRIORITIES)
    total = " + ".join(f'"{p}"' for p in PRIORITIES)
    shares = ", ".join(f'round(CASE WHEN {total} <> 0 THEN "{p}" / ({total}) ELSE 0.0 END, 6) AS "{p}_share"' for p in PRIORITIES)
    return f"WITH w AS (SELECT year(o_orderdate) AS year, {cols} FROM orders GROUP BY 1) SELECT *, {shares} FROM w"


@query("band_pivot_share", _pivot_sql("count(*)"))
def band_pivot_share(spark: SparkSession, folder: str) -> DataFrame:
    out = bands.band_pivot(orders_years(spark, folder), "year", "o_orderpriority", PRIORITIES)
    return out.select("year", *PRIORITIES, *[number(F.col(f"`{p}_share`")).alias(p + "_share") for p in PRIORITIES])


@query("payback_bands", """
SELECT CASE WHEN p_size IS NULL THEN 'No payback' WHEN p_size BETWEEN 4 AND 25 THEN '>3 years' WHEN p_size < 4 THEN '1-3 years' ELSE p_size || ' sizes' END AS band, count(*) AS n
FROM part GROUP BY 1""")
def payback_bands(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size < 4, "1-3 years").when(size <= 10, "4-10 years").when(size <= 15, "11-15 years").when(size <= 20, "16-20 years").when(
        size <= 25, "21-25 years").otherwise(F.concat(size.cast("string"), F.lit(" sizes")))
    return table(spark, folder, "part").select(cells.payback_band(text).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("yearly_strategy", """
SELECT year(o_orderdate) AS year, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 4) AS avg_amount, """ + ", ".join(
    f"round(count(*) FILTER (o_orderpriority = '{p}') / count(*) * 100, 6) AS pct_{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def yearly_strategy(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda p: F.sum((F.col("o_orderpriority") == p).cast("long")) / n * 100
    return orders_years(spark, folder).groupBy("year").agg(
        F.round(F.sum(money("o_totalprice")).cast("double") / n, 4).alias("avg_amount"), *[number(share(p)).alias("pct_" + p[0]) for p in PRIORITIES]
    )


@query("account_investment", """
SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2""")
def account_investment(spark: SparkSession, folder: str) -> DataFrame:
    return orders_years(spark, folder).groupBy("o_custkey", "year").agg(F.sum(money("o_totalprice")).cast("double").alias("total"))


QUARTILE_SQL = """
WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders),
q AS (SELECT max(v) FILTER (k = floor((n - 1) * 0.25 + 0.5)) AS q1, max(v) FILTER (k = floor((n - 1) * 0.5 + 0.5)) AS q2,
             max(v) FILTER (k = floor((n - 1) * 0.75 + 0.5)) AS q3 FROM r)
"""


@query("quartile_bands", QUARTILE_SQL + """
SELECT CASE WHEN o_totalprice <= q1 THEN 'Q1 (Smallest)' WHEN o_totalprice <= q2 THEN 'Q2' WHEN o_totalprice <= q3 THEN 'Q3' ELSE 'Q4 (Largest)' END AS quartile,
       o_orderpriority, count(*) AS n FROM orders, q GROUP BY 1, 2""")
def quartile_bands(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderpriority")
    return bands.quartile_bands(orders, "o_totalprice").groupBy("quartile", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("trim_above", """
WITH p AS (SELECT * FROM orders WHERE o_totalprice > 0),
r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM p)
SELECT o_orderkey, o_totalprice FROM p WHERE o_totalprice <= (SELECT max(v) FROM r WHERE k = floor((n - 1) * 0.99 + 0.5))""")
def trim_above(spark: SparkSession, folder: str) -> DataFrame:
    return bands.trim_above(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.99)


@query("yearly_mean_median", """
SELECT year(o_orderdate) AS year, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 4) AS mean_amount, round(median(o_totalprice), 4) AS median_amount
FROM orders GROUP BY 1""")
def yearly_mean_median(spark: SparkSession, folder: str) -> DataFrame:
    orders = orders_years(spark, folder).select("year", "o_totalprice")
    means = orders.groupBy("year").agg(F.round(F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1)), 4).alias("mean_amount"))
    medians = exact_quantiles(orders, ["year"], "o_totalprice", {"median_amount": "median"})
    return means.join(medians, "year").withColumn("median_amount", F.round("median_amount", 4))


@query("band_year_stats", """
SELECT year(o_orderdate) AS year, o_orderpriority, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 4) AS avg_amount,
       round(stddev_samp(o_totalprice), 3) AS std_amount, count(*) AS n FROM orders GROUP BY 1, 2""")
def band_year_stats(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count(F.lit(1))
    return orders_years(spark, folder).groupBy("year", "o_orderpriority").agg(
        F.round(F.sum(money("o_totalprice")).cast("double") / n, 4).alias("avg_amount"), F.round(F.stddev_samp("o_totalprice"), 3).alias("std_amount"), n.alias("n")
    )


@query("band_returns", """
WITH m AS (SELECT year(o_orderdate) AS year, o_orderpriority AS band, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2),
r AS (SELECT *, m / lag(m) OVER (PARTITION BY band ORDER BY year) - 1 AS r FROM m),
full_years AS (SELECT year FROM r GROUP BY 1 HAVING count(r) = (SELECT count(DISTINCT band) FROM m))
SELECT band AS o_orderpriority, round(stddev_samp(r), 6) AS volatility, round(avg(r), 6) AS mean_return, count(r) AS n_years
FROM r WHERE year IN (SELECT year FROM full_years) GROUP BY 1""")
def band_returns(spark: SparkSession, folder: str) -> DataFrame:
    out = bands.returns_per_band(orders_years(spark, folder), "year", "o_orderpriority", "o_totalprice")
    return out.withColumn("volatility", number(F.col("volatility"))).withColumn("mean_return", number(F.col("mean_return")))


@query("gap_trend", """
SELECT year(l_shipdate) AS year, round(avg(100 - (l_discount * 100)::DECIMAL(18,2)::DOUBLE), 6) AS avg_gap, count(*) AS n FROM lineitem GROUP BY 1""")
def gap_trend(spark: SparkSession, folder: str) -> DataFrame:
    gap = 100 - money(F.col("l_discount") * 100).cast("double")
    return table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(number(F.avg(gap)).alias("avg_gap"), F.count(F.lit(1)).alias("n"))


@query("linear_trend", """
WITH y AS (SELECT l_returnflag, year(l_shipdate) AS year, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(regr_slope(q, year), 6) AS slope, round(regr_intercept(q, year), 4) AS intercept, count(*) AS n FROM y GROUP BY 1""")
def linear_trend(spark: SparkSession, folder: str) -> DataFrame:
    yearly = table(spark, folder, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.avg("l_quantity").alias("q"))
    out = stats.linear_trend(yearly, ["l_returnflag"], "year", "q")
    return out.select("l_returnflag", number(F.col("slope")).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("discrepancy", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS t FROM lineitem GROUP BY 1)
SELECT year(o_orderdate) AS year, count(*) AS n, round(avg(CASE WHEN abs(t - o_totalprice) / o_totalprice > 1 THEN 1.0 ELSE 0.0 END), 6) AS large_share
FROM orders JOIN s ON o_orderkey = l_orderkey WHERE o_totalprice > 0 AND t > 0 GROUP BY 1""")
def discrepancy(spark: SparkSession, folder: str) -> DataFrame:
    from surveyloom.operators.profile import large_discrepancy_share

    sums = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("t"))
    both = orders_years(spark, folder).join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    out = large_discrepancy_share(both, "o_totalprice", "t", ["year"])
    return out.withColumn("large_share", number(F.col("large_share")))


@query("nonzero_stats", """
SELECT year(l_shipdate) AS year, l_returnflag, round(avg(nullif(l_discount, 0)), 6) AS mean_discount, round(stddev_samp(nullif(l_discount, 0)), 6) AS sd_discount
FROM lineitem GROUP BY 1, 2""")
def nonzero_stats(spark: SparkSession, folder: str) -> DataFrame:
    value = F.nullif("l_discount", F.lit(0.0))
    return table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(
        number(F.avg(value)).alias("mean_discount"), number(F.stddev_samp(value)).alias("sd_discount")
    )
