"""Scores, maturity, adoption, transitions, clusters, forest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.operators import models, scores, stats
from surveyloom.queries.registry import number, query, table
from surveyloom.session import cut_lineage

# -- labels out of events -------------------------------------------------------------
LABEL_SQL = """
WITH raw AS (
  SELECT CASE WHEN user_id % 17 <> 5 THEN user_id END AS user_id, ts::DATE AS day, hour(ts) // 6 AS q, event_id, event_type,
    CASE event_type WHEN 'click' THEN 'environmental_claims' WHEN 'view' THEN 'climate_sentiment' WHEN 'signup' THEN 'climate_commitment'
                    WHEN 'error' THEN 'climate_specificity' ELSE 'netzero_reduction' END AS model,
    CASE WHEN value < 10 THEN NULL ELSE CASE event_type WHEN 'click' THEN CASE WHEN value > 30 THEN 'yes' ELSE 'no' END
                    WHEN 'view' THEN CASE WHEN value > 60 THEN 'opportunity' WHEN value > 30 THEN 'risk' ELSE 'neutral' END
                    WHEN 'signup' THEN CASE WHEN value > 20 THEN 'yes' ELSE 'no' END
                    WHEN 'error' THEN CASE WHEN value > 40 THEN 'spec' ELSE 'non' END
                    ELSE CASE WHEN value > 60 THEN 'net-zero' WHEN value > 20 THEN 'reduction' ELSE 'none' END END END AS label
  FROM events),
labels AS (SELECT user_id, day, q, model, min_by(label, event_id) FILTER (label IS NOT NULL) AS label FROM raw GROUP BY 1, 2, 3, 4),
keys AS (SELECT DISTINCT user_id, day FROM labels),
rq AS (SELECT user_id, day, q,
    sum(CASE WHEN model = 'environmental_claims' AND label = 'yes' OR model = 'climate_sentiment' AND label = 'opportunity' THEN 1.0 ELSE 0.0 END) AS p,
    sum(CASE WHEN model IN ('environmental_claims', 'climate_sentiment') AND label IS NOT NULL THEN 1 ELSE 0 END) AS n,
    max(label) FILTER (model = 'climate_commitment') AS c, max(label) FILTER (model = 'climate_specificity') AS s
  FROM labels WHERE q < 3 GROUP BY 1, 2, 3),
r AS (SELECT user_id, day, sum(p + CASE WHEN c = 'yes' AND s = 'non' THEN 1 ELSE 0 END) AS p,
             sum(n + CASE WHEN c IS NOT NULL AND s IS NOT NULL THEN 1 ELSE 0 END) AS n FROM rq GROUP BY 1, 2),
a AS (SELECT user_id, day,
    sum(CASE WHEN model = 'netzero_reduction' AND label = 'net-zero' THEN 2.0 WHEN model = 'netzero_reduction' AND label = 'reduction' THEN 1.0
             WHEN model = 'climate_specificity' AND label = 'spec' THEN 1.0 ELSE 0.0 END) AS p,
    sum(CASE WHEN model IN ('netzero_reduction', 'climate_specificity') AND label IS NOT NULL THEN 1 ELSE 0 END) AS n
  FROM labels WHERE q > 0 GROUP BY 1, 2),
g AS (SELECT k.user_id, k.day, coalesce(CASE WHEN r.n > 0 THEN r.p / r.n ELSE 0 END, 0) AS rhetoric, coalesce(CASE WHEN a.n > 0 THEN a.p / a.n ELSE 0 END, 0) AS action
      FROM keys k LEFT JOIN r ON k.user_id IS NOT DISTINCT FROM r.user_id AND k.day = r.day
      LEFT JOIN a ON k.user_id IS NOT DISTINCT FROM a.user_id AND k.day = a.day),
gaps AS (SELECT *, rhetoric - action AS gap, 'sector ' || (user_id % 5) AS sector FROM g)
"""


def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    model = (
        F.when(kind == "click", "environmental_claims").when(kind == "view", "climate_sentiment").when(kind == "signup", "climate_commitment")
        .when(kind == "error", "climate_specificity").otherwise("netzero_reduction")
    )
    label = (
        F.when(kind == "click", F.when(v > 30, "yes").otherwise("no"))
        .when(kind == "view", F.when(v > 60, "opportunity").when(v > 30, "risk").otherwise("neutral"))
        .when(kind == "signup", F.when(v > 20, "yes").otherwise("no"))
        .when(kind == "error", F.when(v > 40, "spec").otherwise("non"))
        .otherwise(F.when(v > 60, "net-zero").when(v > 20, "reduction").otherwise("none"))
    )
    # Small values have no label and some rows no user, so that both kinds of gaps are met.
    rows = table(spark, folder, "events").select(
        F.when(F.col("user_id") % 17 != 5, F.col("user_id")).alias("user_id"), F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).alias("column"),
        F.col("event_id").alias("pos"), model.alias("model"), F.when(v >= 10, label).alias("label")
    )
    return scores.first_labels(rows, ["user_id", "day"])


def user_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps = scores.gap_scores(event_labels(spark, folder), ["user_id", "day"], F.col("column") < 3, F.col("column") > 0)
    return gaps.withColumn("sector", F.concat(F.lit("sector "), (F.col("user_id") % 5).cast("string")))


@query("gap_scores", LABEL_SQL + "SELECT user_id, day, round(rhetoric, 6) AS rhetoric, round(action, 6) AS action, round(gap, 6) AS gap FROM gaps")
def gap_scores(spark: SparkSession, folder: str) -> DataFrame:
    return user_gaps(spark, folder).select("user_id", "day", *[number(F.col(c)).alias(c) for c in ("rhetoric", "action", "gap")])


@query("gap_by_sector", LABEL_SQL + """
SELECT sector, round(avg(rhetoric), 6) AS avg_rhetoric, round(avg(action), 6) AS avg_action, round(avg(gap), 6) AS avg_gap, count(*) AS n
FROM gaps GROUP BY 1 HAVING count(*) >= 50""")
def gap_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.score_means(user_gaps(spark, folder), "sector", ["rhetoric", "action", "gap"], 50)
    return out.select("sector", *[number(F.col("avg_" + c)).alias("avg_" + c) for c in ("rhetoric", "action", "gap")], "n")


@query("gap_by_day", LABEL_SQL + """
SELECT day, round(avg(rhetoric), 6) AS avg_rhetoric, round(avg(action), 6) AS avg_action, round(avg(gap), 6) AS avg_gap, count(*) AS n FROM gaps GROUP BY 1""")
def gap_by_day(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.score_means(user_gaps(spark, folder), "day", ["rhetoric", "action", "gap"])
    return out.select("day", *[number(F.col("avg_" + c)).alias("avg_" + c) for c in ("rhetoric", "action", "gap")], "n")


@query("gap_overall", LABEL_SQL + """
SELECT 'all' AS scope, round(avg(gap) FILTER (day < DATE '2024-01-16'), 6) AS pre, round(avg(gap) FILTER (day >= DATE '2024-01-16'), 6) AS post,
  count(*) FILTER (day < DATE '2024-01-16') AS n_pre, count(*) FILTER (day >= DATE '2024-01-16') AS n_post,
  round(avg(gap) FILTER (day >= DATE '2024-01-16') - avg(gap) FILTER (day < DATE '2024-01-16'), 6) AS change FROM gaps""")
def gap_overall(spark: SparkSession, folder: str) -> DataFrame:
    gaps = user_gaps(spark, folder).withColumn("d", F.datediff("day", F.lit("2024-01-01").cast("date"))).withColumn("scope", F.lit("all"))
    out = scores.before_after(gaps, "scope", "gap", "d", 15, -1)
    return out.select("scope", number(F.col("pre")).alias("pre"), number(F.col("post")).alias("post"), "n_pre", "n_post", number(F.col("change")).alias("change"))


def _action_sql() -> str:
    asked = ", ".join(f"coalesce(max((code = '{code}' AND value = 'Yes')::INTEGER), 0) AS {n}" for n, code in V.ANSWER_QUESTIONS)
    said = ", ".join(f"coalesce(max((model = '{m}' AND label = '{lb}')::INTEGER), 0) AS {n}" for n, m, lb in V.LABEL_INDICATORS)
    codes = " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(V.ANSWER_QUESTIONS))
    models_sql = " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m, _) in enumerate(V.LABEL_INDICATORS))
    hits = " ".join(f"WHEN {i} THEN '{lb}'" for i, (_, _, lb) in enumerate(V.LABEL_INDICATORS))
    return f"""
SELECT o_custkey, year, {asked}, {said} FROM (
  SELECT o_custkey, year(o_orderdate) AS year, CASE o_orderkey % 13 {codes} ELSE 'C9.9' END AS code,
    CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS value,
    CASE o_orderkey // 5 % 5 {models_sql} ELSE 'tcfd' END AS model,
    CASE WHEN o_orderpriority < '3' THEN CASE o_orderkey // 5 % 5 {hits} ELSE 'risk' END ELSE 'none' END AS label FROM orders) GROUP BY 1, 2"""


@query("action_indicators", _action_sql())
def action_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """The 12 answer and 4 label indicators of every customer and year."""
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    code = pick([c for _, c in V.ANSWER_QUESTIONS] + ["C9.9"], F.col("o_orderkey") % 13)
    answers = orders.select(
        "o_custkey", "year", F.concat(code, F.lit("_Question text")).alias("column"),
        F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No").alias("value"))
    at = F.floor(F.col("o_orderkey") / 5) % 5
    labels = orders.select(
        "o_custkey", "year", pick([m for _, m, _ in V.LABEL_INDICATORS] + ["tcfd"], at).alias("model"),
        F.when(F.col("o_orderpriority") < "3", pick([lb for _, _, lb in V.LABEL_INDICATORS] + ["risk"], at)).otherwise("none").alias("label"))
    return scores.action_indicators(answers, labels, ["o_custkey", "year"])


@query("gap_before_after", LABEL_SQL + """
SELECT sector, round(avg(gap) FILTER (day < DATE '2024-01-16'), 6) AS pre, round(avg(gap) FILTER (day >= DATE '2024-01-16'), 6) AS post,
  count(*) FILTER (day < DATE '2024-01-16') AS n_pre, count(*) FILTER (day >= DATE '2024-01-16') AS n_post,
  round(avg(gap) FILTER (day >= DATE '2024-01-16') - avg(gap) FILTER (day < DATE '2024-01-16'), 6) AS change
FROM gaps GROUP BY 1 HAVING n_pre > 10 AND n_post > 10""")
def gap_before_after(spark: SparkSession, folder: str) -> DataFrame:
    gaps = user_gaps(spark, folder).withColumn("d", F.datediff("day", F.lit("2024-01-01").cast("date")))
    out = scores.before_after(gaps, "sector", "gap", "d", 15)
    return out.select("sector", number(F.col("pre")).alias("pre"), number(F.col("post")).alias("post"), "n_pre", "n_post", number(F.col("change")).alias("change"))


def _report_sql() -> str:
    means = "round(avg(rhetoric), 6) AS avg_rhetoric, round(avg(action), 6) AS avg_action, round(avg(gap), 6) AS avg_gap, count(*) AS n"
    parts = [
        f"SELECT 'time' AS kind, day::VARCHAR AS key, NULL AS period, {means} FROM p GROUP BY day",
        f"SELECT 'before_after', NULL, period, {means} FROM p GROUP BY period", f"SELECT 'overall', NULL, NULL, {means} FROM p HAVING count(*) > 0",
    ]
    for g in ("sector", "region"):
        parts.append(f"SELECT '{g}', {g}, NULL, {means} FROM p WHERE {g} IS NOT NULL AND NOT contains({g}, 'None') GROUP BY {g} HAVING count(*) >= 50")
        parts.append(f"SELECT '{g}_change', {g}, period, {means} FROM p WHERE {g} IN (SELECT {g} FROM p GROUP BY 1 HAVING count(*) >= 50 "
                     f"AND count(*) FILTER (period = 'before') > 10 AND count(*) FILTER (period = 'after') > 10) AND NOT contains({g}, 'None') GROUP BY {g}, period")
    regions = "CASE user_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'None, east' END"
    return f", p AS (SELECT *, {regions} AS region, CASE WHEN day < DATE '2024-01-16' THEN 'before' ELSE 'after' END AS period FROM gaps) " + " UNION ALL ".join(parts)


@query("gap_report", LABEL_SQL + _report_sql())
def gap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Gap means by day, sector, region, before and after, and overall, from one scan of the gaps."""
    region = F.when(F.col("user_id") % 4 == 0, "north").when(F.col("user_id") % 4 == 1, "south").when(F.col("user_id") % 4 == 2, "None, east")
    gaps = user_gaps(spark, folder).withColumn("region", region)
    out = scores.score_report(gaps, ["rhetoric", "action", "gap"], "day", ["sector", "region"], F.lit("2024-01-16").cast("date"))
    return out.select("kind", "key", "period", *[number(F.col("avg_" + c)).alias("avg_" + c) for c in ("rhetoric", "action", "gap")], "n")


@query("sentiment_trend", """
WITH l AS (SELECT ts::DATE AS day, CASE event_type WHEN 'click' THEN 'opportunity' WHEN 'error' THEN 'risk' WHEN 'view' THEN 'neutral' END AS label FROM events),
c AS (SELECT day, count(*) FILTER (label = 'opportunity') AS opportunity_count, count(*) FILTER (label = 'risk') AS risk_count,
             count(*) FILTER (label = 'neutral') AS neutral_count, count(*) AS total_count FROM l GROUP BY 1)
SELECT *, round(opportunity_count / total_count * 100, 6) AS opportunity_pct, round(risk_count / total_count * 100, 6) AS risk_pct,
  round(neutral_count / total_count * 100, 6) AS neutral_pct, round(CASE WHEN risk_count <> 0 THEN opportunity_count / risk_count END, 6) AS opportunity_risk_ratio FROM c""")
def sentiment_trend(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "opportunity").when(kind == "error", "risk").when(kind == "view", "neutral")
    out = scores.sentiment_trend(table(spark, folder, "events").select(F.to_date("ts").alias("day"), label.alias("label")), "day", "label")
    rounded = ["opportunity_pct", "risk_pct", "neutral_pct", "opportunity_risk_ratio"]
    return out.select(*[number(F.col(c)).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query("specificity_trend", """
SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS specific_count, count(*) AS total_count,
       round(count(*) FILTER (event_type = 'purchase') / count(*) * 100, 6) AS specificity_pct FROM events GROUP BY 1""")
def specificity_trend(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.label_share_trend(table(spark, folder, "events").withColumn("day", F.to_date("ts")), "day", "event_type", "purchase")
    return out.withColumn("specificity_pct", number(F.col("specificity_pct")))


# -- indicators out of orders -----------------------------------------------------------
FLAGS = (
    ("has_board_oversight", "max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)"),
    ("has_strategy_integration", "max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)"),
    ("uses_scenario_analysis", "max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END)"),
    ("has_risk_process", "max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END)"),
    ("identified_climate_risks", "max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END)"),
    ("identified_climate_opportunities", "max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)"),
    ("has_emissions_target", "max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)"),
    ("has_internal_carbon_price", "max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)"),
    ("has_reduction_initiatives", "CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END"),
    ("has_low_carbon_products", "CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END"),
    ("engages_value_chain", "CASE WHEN max(o_totalprice) > 300000 THEN 1 ELSE 0 END"),
    ("engages_policy", "CASE WHEN min(o_totalprice) < 50000 THEN 1 ELSE 0 END"),
    ("has_netzero_target", "max(CASE WHEN month(o_orderdate) <= 3 THEN 1 ELSE 0 END)"),
    ("has_renewable_initiative", "max(CASE WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 1 ELSE 0 END)"),
    ("has_specific_disclosure", "max(CASE WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 1 ELSE 0 END)"),
    ("makes_environmental_claims", "max(CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END)"),
)
NAMES = [n for n, _ in FLAGS]
MATURITY = " + ".join(NAMES)
FLAG_SQL = f"""
WITH f0 AS (SELECT o_custkey, year(o_orderdate) AS year, {', '.join(f'{e} AS {n}' for n, e in FLAGS)} FROM orders GROUP BY 1, 2),
f AS (SELECT f0.*, {MATURITY} AS maturity, c_mktsegment AS sector FROM f0 JOIN customer ON o_custkey = c_custkey)
"""


def customer_flags(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    flags = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(*[F.expr(e).alias(n) for n, e in FLAGS])
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("sector"))
    joined = flags.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    return scores.maturity(joined, NAMES)


CATEGORY_SQL = ", ".join(f"round(({' + '.join(m)}) / {len(m)} * 100, 6) AS {c}" for c, m in V.INDICATOR_CATEGORIES)


@query("maturity", FLAG_SQL + f"SELECT o_custkey, year, maturity, {CATEGORY_SQL} FROM f")
def maturity(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.category_percentages(customer_flags(spark, folder))
    return out.select("o_custkey", "year", "maturity", *[number(F.col(c)).alias(c) for c, _ in V.INDICATOR_CATEGORIES])


@query("adoption", FLAG_SQL + "SELECT year, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES) + ", count(*) AS n FROM f GROUP BY 1")
def adoption(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.adoption(customer_flags(spark, folder), ["year"], NAMES)
    return out.select("year", *[number(F.col(n)).alias(n) for n in NAMES], "n")


@query("sector_maturity", FLAG_SQL + """
SELECT year, sector, round(avg(maturity), 6) AS maturity, round(avg(has_board_oversight), 6) AS has_board_oversight, count(*) AS n FROM f GROUP BY 1, 2""")
def sector_maturity(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.adoption(customer_flags(spark, folder), ["year", "sector"], ["maturity", "has_board_oversight"])
    return out.select("year", "sector", number(F.col("maturity")).alias("maturity"), number(F.col("has_board_oversight")).alias("has_board_oversight"), "n")


OUTCOMES = ["has_strategy_integration", "has_emissions_target", "has_netzero_target", "has_internal_carbon_price", "has_reduction_initiatives", "has_specific_disclosure"]


@query("governance_impact", FLAG_SQL + ", l AS (SELECT * FROM f WHERE year = (SELECT max(year) FROM f))" + " UNION ALL ".join(
    f"""
SELECT '{o}' AS outcome, round(avg({o}) FILTER (has_board_oversight = 1), 6) AS with_flag, round(avg({o}) FILTER (has_board_oversight = 0), 6) AS without_flag,
  round(CASE WHEN avg({o}) FILTER (has_board_oversight = 0) > 0 THEN (avg({o}) FILTER (has_board_oversight = 1) / avg({o}) FILTER (has_board_oversight = 0) - 1) * 100
        ELSE 'Infinity'::DOUBLE END, 6) AS pct_change FROM l""" for o in OUTCOMES))
def governance_impact(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.governance_impact(customer_flags(spark, folder), "year", "has_board_oversight", OUTCOMES)
    return out.select("outcome", *[number(F.col(c)).alias(c) for c in ("with_flag", "without_flag", "pct_change")])


STATE_SQL = FLAG_SQL + f""", s AS (SELECT o_custkey, sector, year, CASE WHEN k <= 1 THEN 'Beginner' WHEN k <= 3 THEN 'Developing' WHEN k <= 5 THEN 'Advanced' ELSE 'Leader' END AS state
  FROM (SELECT *, {' + '.join(V.KEY_INDICATORS)} AS k FROM f))
"""


def customer_states(spark: SparkSession, folder: str) -> DataFrame:
    flags = scores.maturity(customer_flags(spark, folder), list(V.KEY_INDICATORS), "k")
    return flags.select("o_custkey", "sector", "year", scores.maturity_state(F.col("k")).alias("state"))


@query("transitions", STATE_SQL + """
, m AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY o_custkey ORDER BY year) AS to_state FROM s),
c AS (SELECT from_state, to_state, count(*) AS n FROM m WHERE to_state IS NOT NULL GROUP BY 1, 2)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM c""")
def transitions(spark: SparkSession, folder: str) -> DataFrame:
    out = scores.transitions(customer_states(spark, folder), "o_custkey", "year", "state")
    return out.withColumn("share", number(F.col("share")))


PATH_SQL = STATE_SQL + """, p AS (SELECT o_custkey, min(sector) AS sector, string_agg(state, ' -> ' ORDER BY year) AS path FROM s GROUP BY 1 HAVING count(*) >= 2)
"""


@query("paths", PATH_SQL + "SELECT path, count(*) AS n FROM p GROUP BY 1")
def paths(spark: SparkSession, folder: str) -> DataFrame:
    return scores.path_counts(scores.paths(customer_states(spark, folder), "o_custkey", "year", "state"))


@query("sector_paths", PATH_SQL + """
, c AS (SELECT sector, count(DISTINCT path) AS n_paths FROM p GROUP BY 1)
SELECT sector, path, count(*) AS n FROM p WHERE sector IN (SELECT sector FROM c ORDER BY n_paths DESC, sector LIMIT 5) GROUP BY 1, 2""")
def sector_paths(spark: SparkSession, folder: str) -> DataFrame:
    states = customer_states(spark, folder)
    sectors = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sector"))
    found = scores.paths(states, "o_custkey", "year", "state").join(sectors, "o_custkey")
    counts = scores.path_counts(found, ["sector"])
    top = counts.groupBy("sector").agg(F.count(F.lit(1)).alias("n_paths")).orderBy(F.desc("n_paths"), "sector").limit(5)
    return counts.join(top.select("sector"), "sector", "left_semi")


@query("corr_edges", FLAG_SQL + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 6) AS weight FROM f" for i, a in enumerate(NAMES[:14]) for b in NAMES[i + 1:14]
) + ") WHERE abs(weight) > 0.2")
def corr_edges(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.correlation_edges(customer_flags(spark, folder), NAMES[:14])
    return out.withColumn("weight", number(F.col("weight")))


@query("degree_centrality", FLAG_SQL + ", e AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS w FROM f" for i, a in enumerate(NAMES[:14]) for b in NAMES[i + 1:14]
) + ") WHERE abs(w) > 0.2) SELECT node, round(count(*) / 13, 6) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def degree_centrality(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.degree_centrality(stats.correlation_edges(customer_flags(spark, folder), NAMES[:14]), 14)
    return out.withColumn("degree", number(F.col("degree")))


def _eigenvector_sql() -> str:
    """Eight squarings of the small matrix, written out."""
    edges = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS w FROM f" for i, a in enumerate(NAMES[:14]) for b in NAMES[i + 1:14])
    steps = "".join(
        f", m{k + 1} AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM m{k} x JOIN m{k} y ON x.j = y.i GROUP BY 1, 2)" for k in range(8))
    return f"""
, e AS (SELECT a, b FROM ({edges}) WHERE abs(w) > 0.2), b AS (SELECT a AS i, b AS j FROM e UNION ALL SELECT b, a FROM e),
l AS (SELECT * FROM b UNION ALL SELECT DISTINCT i, i FROM b), s AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM l GROUP BY i)),
m0 AS MATERIALIZED (SELECT i, j, 1.0::DOUBLE / n AS v FROM l, s){steps},
x AS (SELECT i AS node, sum(v) AS x FROM m8 GROUP BY 1)
SELECT node, round(x / sqrt((SELECT sum(x * x) FROM x)), 6) AS centrality FROM x"""


@query("eigenvector_centrality", FLAG_SQL + _eigenvector_sql())
def eigenvector_centrality(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.eigenvector_centrality(stats.correlation_edges(customer_flags(spark, folder), NAMES[:14]))
    return out.withColumn("centrality", number(F.col("centrality")))


CATEGORIES = [c for c, _ in V.INDICATOR_CATEGORIES]


@query("cluster_profile")
def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = scores.category_percentages(customer_flags(spark, folder)).select("sector", "maturity", *CATEGORIES)
    clustered, _ = models.best_kmeans(models.scaled_features(rows, CATEGORIES))
    return models.cluster_profile(clustered, CATEGORIES, "maturity", "sector")


@query("feature_projection")
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled features, four clusters, a four-part mixture and two components, summed up per cluster pair."""
    orders = table(spark, folder, "orders").select("o_totalprice", F.log1p("o_totalprice").alias("log_total"), F.substring("o_orderpriority", 1, 1).cast("double").alias("code"))
    scaled = cut_lineage(models.scaled_features(orders, ["o_totalprice", "log_total", "code"], impute=True))
    projected, _ = models.principal_components(models.mixture(scaled))
    clustered = models.KMeans(k=4, seed=models.SEED, featuresCol="features", predictionCol="cluster").fit(projected).transform(projected)
    return clustered.groupBy("cluster", "mixture").agg(F.count(F.lit(1)).alias("n"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))


ADOPTION_TARGETS = ("has_emissions_target", "has_netzero_target", "has_internal_carbon_price", "has_renewable_initiative")

# Labels of a customer-year's disclosure, out of its orders as the flags are.
DISCLOSURES = (
    ("sentiment", "CASE WHEN max(o_totalprice) > 300000 THEN 'opportunity' WHEN min(o_totalprice) < 50000 THEN 'risk' ELSE 'neutral' END"),
    ("tcfd", "element_at(array('governance', 'strategy', 'risk', 'metrics', 'none'), CAST(max(o_orderkey) % 5 AS int) + 1)"),
    ("specificity", "CASE WHEN count(DISTINCT o_orderdate) >= 2 THEN 1 ELSE 0 END"),
)


def adoption_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customer-years with their flags, sector, region and disclosure labels."""
    labels = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(*[F.expr(e).alias(n) for n, e in DISCLOSURES])
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("region"))
    places = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return customer_flags(spark, folder).join(labels, ["o_custkey", "year"]).join(places.select(F.col("c_custkey").alias("o_custkey"), "region"), "o_custkey", "left")


@query("forest_adoption")
def forest_adoption(spark: SparkSession, folder: str) -> DataFrame:
    """Per target: measures on the later years, feature importances and adoption by year."""
    rows = cut_lineage(adoption_rows(spark, folder))
    numeric = ["has_board_oversight", "has_strategy_integration", "has_risk_process", "identified_climate_risks", "identified_climate_opportunities", "specificity"]
    parts = []
    made = models.forest_adoptions(rows, "year", list(ADOPTION_TARGETS), numeric, ["sector", "region", "sentiment", "tcfd"], 2000, 1995, 2004, 2001)
    for target, (metrics, importances, adopted) in zip(ADOPTION_TARGETS, made):
        entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("accuracy", "precision", "recall", "f1")])
        parts += [
            metrics.select("target", F.explode(entries).alias("e")).select("target", "e.measure", "e.value"),
            importances.select("target", F.concat(F.lit("importance "), F.col("feature")).alias("measure"), F.col("importance").alias("value")),
            adopted.select(F.lit(target).alias("target"), F.concat(F.lit("adoption "), F.col("year").cast("string")).alias("measure"), F.col("adoption_pct").alias("value")),
        ]
    return reduce(DataFrame.unionByName, parts)
