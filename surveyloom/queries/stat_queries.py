"""Tests, regressions, series and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.operators import models, stats
from surveyloom.queries.amounts import PRIORITIES, orders_years
from surveyloom.queries.registry import money, number, query, table

MOMENTS_SQL = "WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var FROM orders GROUP BY 1)"


@query("anova", MOMENTS_SQL + """
, w AS (SELECT sum(n) AS big_n, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum((n - 1) * var) AS ssw FROM m)
SELECT round((SELECT sum(n * (mean - grand) ** 2) FROM m, w) / (k - 1) / (ssw / (big_n - k)), 6) AS f, k - 1 AS df_between, (big_n - k)::BIGINT AS df_within FROM w""")
def anova(spark: SparkSession, folder: str) -> DataFrame:
    return stats.anova(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice").select(number(F.col("f")).alias("f"), "df_between", "df_within")


# With four degrees of freedom above, the tail of F is a finite sum.
@query("anova_p", MOMENTS_SQL + """
, w AS (SELECT sum(n) AS big_n, count(*) AS k, sum(n * mean) / sum(n) AS grand, sum((n - 1) * var) AS ssw FROM m),
f AS (SELECT (SELECT sum(n * (mean - grand) ** 2) FROM m, w) / (k - 1) / (ssw / (big_n - k)) AS f, k - 1 AS a, (big_n - k)::BIGINT AS b FROM w),
x AS (SELECT *, b / (b + a * f) AS x FROM f)
SELECT round(f, 6) AS f, round(x ** (b / 2) * (1 + b / 2 * (1 - x)), 6) AS p FROM x WHERE a = 4""")
def anova_p(spark: SparkSession, folder: str) -> DataFrame:
    return stats.anova(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice").select(number(F.col("f")).alias("f"), number(F.col("p")).alias("p"))


@query("mean_intervals", MOMENTS_SQL + """
SELECT g AS o_orderpriority, n, round(mean, 3) AS mean, round(mean - t * sqrt(var / n), 3) AS ci_lower, round(mean + t * sqrt(var / n), 3) AS ci_upper
FROM (SELECT *, 1.959964 + (1.959964 ** 3 + 1.959964) / (4 * (n - 1)) + (5 * 1.959964 ** 5 + 16 * 1.959964 ** 3 + 3 * 1.959964) / (96 * (n - 1) * (n - 1)) AS t FROM m)""")
def mean_intervals(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.mean_intervals(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", "n", *[F.round(c, 3).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


@query("welch", MOMENTS_SQL + """
SELECT a.g AS group_a, b.g AS group_b, round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t,
  round((a.var / a.n + b.var / b.n) ** 2 / ((a.var / a.n) ** 2 / (a.n - 1) + (b.var / b.n) ** 2 / (b.n - 1)), 3) AS dof FROM m a, m b WHERE a.g < b.g""")
def welch(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.welch_tests(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", PRIORITIES)
    return out.select("group_a", "group_b", number(F.col("t")).alias("t"), F.round("dof", 3).alias("dof"))


@query("mwu", """
WITH c AS (SELECT o_totalprice AS v, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1, 2),
p AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in combinations(PRIORITIES, 2)) + """) p(a, b)),
v AS (SELECT a, b, v, coalesce(sum(n) FILTER (g = a), 0) AS na, coalesce(sum(n) FILTER (g = b), 0) AS nb FROM c, p WHERE g IN (a, b) GROUP BY 1, 2, 3),
r AS (SELECT *, sum(nb) OVER (PARTITION BY a, b ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum FROM v)
SELECT a AS group_a, b AS group_b, sum(na * (cum - nb) + na * nb / 2)::DOUBLE AS u FROM r GROUP BY 1, 2""")
def mwu(spark: SparkSession, folder: str) -> DataFrame:
    return stats.rank_sum_tests(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", PRIORITIES).select("group_a", "group_b", "u")


MONTH_SQL = """
WITH y AS (SELECT o_orderstatus, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS month,
                  round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 2) AS mean, count(*) AS n FROM orders GROUP BY 1, 2)
"""


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    n = F.count(F.lit(1))
    return table(spark, folder, "orders").groupBy("o_orderstatus", month.alias("month")).agg(
        F.round(F.sum(money("o_totalprice")).cast("double") / n, 2).alias("mean"), n.alias("n")
    )


@query("autocorr", MONTH_SQL + """
, k AS (SELECT nullif(o_orderstatus, 'P') AS o_orderstatus, month, mean FROM y),
d AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS t, mean - avg(mean) OVER (PARTITION BY o_orderstatus) AS x FROM k),
c0 AS (SELECT o_orderstatus, sum(x * x) AS c0 FROM d GROUP BY 1)
SELECT a.o_orderstatus, lag::INTEGER AS lag, round(sum(a.x * b.x) / any_value(c0), 6) AS acf
FROM d a, range(0, 11) l(lag), d b, c0 WHERE a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND b.t = a.t + lag AND c0.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus GROUP BY 1, 2""")
def autocorr(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly means by status; one status is emptied, so that a null group is among them."""
    rows = monthly(spark, folder).withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    out = stats.autocorrelation(rows, ["o_orderstatus"], "month", "mean")
    return out.withColumn("acf", number(F.col("acf")))


@query("ar1", MONTH_SQL + """
, l AS (SELECT *, lag(mean) OVER (PARTITION BY o_orderstatus ORDER BY month) AS b FROM y),
m AS (SELECT o_orderstatus, regr_slope(mean, b) AS phi, regr_intercept(mean, b) AS c, max_by(mean, month) AS x, max(month) AS month FROM l GROUP BY 1)
SELECT o_orderstatus, month + k::INTEGER AS month, round(phi, 6) AS phi, round(c, 2) AS const,
  round(CASE k WHEN 1 THEN c + phi * x WHEN 2 THEN c + phi * (c + phi * x) ELSE c + phi * (c + phi * (c + phi * x)) END, 2) AS forecast FROM m, range(1, 4) r(k)""")
def ar1(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.ar1_forecast(monthly(spark, folder), ["o_orderstatus"], "month", "mean")
    return out.select("o_orderstatus", "month", number(F.col("phi")).alias("phi"), F.round("const", 2).alias("const"), F.round("forecast", 2).alias("forecast"))


@query("ols", MONTH_SQL + """
, l AS (SELECT o_orderstatus, mean AS y, lag(mean) OVER w AS a, lag(n) OVER w AS b FROM y WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)),
s AS (SELECT o_orderstatus, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
             covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM l WHERE a IS NOT NULL GROUP BY 1),
k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS k1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS k2 FROM s)
SELECT o_orderstatus, n, round(my - k1 * ma - k2 * mb, 0) AS const, round(k1, 5) AS beta_value, round(k2, 1) AS beta_count, round((k1 * ay + k2 * by_) / yy, 6) AS r2,
  round(sqrt(n * (yy - k1 * ay - k2 * by_) / (n - 3) * bb / (n * (aa * bb - ab * ab))), 5) AS se_value, round(sqrt(n * (yy - k1 * ay - k2 * by_) / (n - 3) * aa / (n * (aa * bb - ab * ab))), 1) AS se_count FROM k""")
def ols(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.lagged_ols(monthly(spark, folder), ["o_orderstatus"], "month", "mean", "n")
    return out.select(
        "o_orderstatus", "n", F.round("const", 0).alias("const"), F.round("beta_value", 5).alias("beta_value"), F.round("beta_count", 1).alias("beta_count"), number(F.col("r2")).alias("r2"),
        F.round("se_value", 5).alias("se_value"), F.round("se_count", 1).alias("se_count"),
    )


@query("glm", MONTH_SQL + """
, g AS (SELECT o_orderstatus, lag(mean) OVER w / mean - 1 AS y, lag(n) OVER w / n - 1 AS x FROM y WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)),
s AS (SELECT o_orderstatus, corr(y, x) AS r, count(*) AS n FROM g WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, n, round(r, 6) AS slope, round(sqrt((1 - r * r) / (n - 2)), 6) AS std_error, round(r / sqrt((1 - r * r) / (n - 2)), 6) AS t FROM s""")
def glm(spark: SparkSession, folder: str) -> DataFrame:
    from surveyloom.operators.panel import lag_growth

    grown = lag_growth(monthly(spark, folder), ["mean", "n"], ["o_orderstatus"], "month")
    out = stats.scaled_regression(grown, "growth_mean", "growth_n", ["o_orderstatus"])
    return out.select("o_orderstatus", "n", *[number(F.col(c)).alias(c) for c in ("slope", "std_error", "t")])


@query("marginal_transitions", """
WITH s AS (SELECT year(o_orderdate) AS year, o_orderpriority AS b, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS s FROM orders GROUP BY 1, 2),
p AS (SELECT year, b, s / sum(s) OVER (PARTITION BY year) AS p FROM s)
SELECT x.b AS from_band, y.b AS to_band, round(sum(x.p * y.p) / (SELECT count(DISTINCT year) - 1 FROM s), 6) AS share FROM p x JOIN p y ON y.year = x.year + 1 GROUP BY 1, 2""")
def marginal_transitions(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.marginal_transitions(orders_years(spark, folder), "year", "o_orderpriority", money("o_totalprice"))
    return out.withColumn("share", number(F.col("share")))


@query("band_edges", "SELECT year(o_orderdate) AS year, o_orderpriority, round(avg(o_totalprice), 4) AS weight FROM orders GROUP BY 1, 2")
def band_edges(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.band_edges(orders_years(spark, folder), "year", "o_orderpriority", "o_totalprice")
    return out.withColumn("weight", F.round("weight", 4))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r_sql(source: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r, count(*) AS n FROM {source}" for a, b in combinations(NUMERIC, 2))
    return f"SELECT var_a, var_b, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM ({rows})"


@query("corr_stars", _r_sql("lineitem"))
def corr_stars(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.correlation_table(table(spark, folder, "lineitem"), NUMERIC)
    return out.select("var_a", "var_b", number(F.col("r")).alias("r"), "n", F.round("t", 4).alias("t"))


@query("corr_stars_p")
def corr_stars_p(spark: SparkSession, folder: str) -> DataFrame:
    return stats.correlation_table(table(spark, folder, "lineitem"), NUMERIC)


@query("corr_ranks", "WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMERIC) + " FROM lineitem) " + _r_sql("k"))
def corr_ranks(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.correlation_table(table(spark, folder, "lineitem"), NUMERIC, "spearman")
    return out.select("var_a", "var_b", number(F.col("r")).alias("r"), "n", F.round("t", 4).alias("t"))


@query("one_hot", "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS log_amount, " + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"band_{p}\"" for p in PRIORITIES) + " FROM orders")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    out = models.one_hot(table(spark, folder, "orders"), "o_orderpriority", PRIORITIES, "band")
    return out.select("o_orderkey", F.round(F.log1p("o_totalprice"), 9).alias("log_amount"), *["band_" + p for p in PRIORITIES])
