"""Panel joins, lookups, grids, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import cells
from surveyloom.operators import panel
from surveyloom.queries.registry import money, query, table


def orders_with_year(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))


@query("four_way_join", """
WITH o AS (SELECT o_custkey AS account, year(o_orderdate) AS year, * FROM orders),
a AS (SELECT account, year, count(*) AS n_final FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT account, year, count(*) AS n_open FROM o WHERE o_orderstatus = 'O' GROUP BY 1, 2),
c AS (SELECT account, year, count(*) AS n_part FROM o WHERE o_orderstatus = 'P' GROUP BY 1, 2),
d AS (SELECT account, year, count(*) AS n_urgent FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT account, year, n_final, n_open, n_part, n_urgent
FROM a FULL JOIN b USING (account, year) FULL JOIN c USING (account, year) FULL JOIN d USING (account, year)""")
def four_way_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = orders_with_year(spark, folder).withColumnRenamed("o_custkey", "account")
    part = lambda cond, name: orders.filter(cond).groupBy("account", "year").agg(F.count(F.lit(1)).alias(name))
    status = F.col("o_orderstatus")
    return panel.full_join_all(
        [part(status == "F", "n_final"), part(status == "O", "n_open"), part(status == "P", "n_part"), part(F.col("o_orderpriority") == "1-URGENT", "n_urgent")],
        ["account", "year"],
    )


def _supplier_years(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("fiscal_year"), "l_quantity")
    per_supplier = lines.groupBy("l_suppkey", "fiscal_year").agg(F.sum("l_quantity").alias("quantity"))
    return per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.nullif("s_nationkey", F.lit(0)).alias("nation"), "fiscal_year"
    ).agg(F.sum("quantity").alias("quantity"))


def _customer_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = orders_with_year(spark, folder).groupBy("o_custkey", "year").agg(F.count(F.lit(1)).alias("n"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.nullif("c_nationkey", F.lit(0)).alias("nation"), cells.survey_fiscal_year(F.col("year")).alias("fiscal_year")
    ).agg(F.sum("n").alias("n_orders"))


PANEL_SQL = """
WITH p AS (SELECT nullif(c_nationkey, 0) AS nation, year(o_orderdate) - 1 AS fiscal_year, count(*) AS n_orders
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
f AS (SELECT nullif(s_nationkey, 0) AS nation, year(l_shipdate) AS fiscal_year, sum(l_quantity) AS quantity
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
"""


@query("left_panel_join", PANEL_SQL + "SELECT nation, fiscal_year, n_orders, quantity FROM p LEFT JOIN f USING (nation, fiscal_year)")
def left_panel_join(spark: SparkSession, folder: str) -> DataFrame:
    return panel.join_on(_customer_years(spark, folder), _supplier_years(spark, folder), ["nation", "fiscal_year"])


@query("left_panel_join_null_keys", PANEL_SQL + """
SELECT p.nation, p.fiscal_year, n_orders, quantity FROM p LEFT JOIN f
  ON p.nation IS NOT DISTINCT FROM f.nation AND p.fiscal_year = f.fiscal_year""")
def left_panel_join_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    return panel.join_on(_customer_years(spark, folder), _supplier_years(spark, folder), ["nation", "fiscal_year"], null_keys="match")


@query("full_panel_join", PANEL_SQL + """
SELECT coalesce(p.nation, f.nation) AS nation, coalesce(p.fiscal_year, f.fiscal_year) AS fiscal_year, n_orders, quantity
FROM p FULL JOIN f ON p.nation IS NOT DISTINCT FROM f.nation AND p.fiscal_year = f.fiscal_year""")
def full_panel_join(spark: SparkSession, folder: str) -> DataFrame:
    return panel.join_on(_customer_years(spark, folder), _supplier_years(spark, folder), ["nation", "fiscal_year"], "full", "match")


@query("multi_key_union", """
WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer),
n AS (SELECT n_nationkey AS nation, n_name AS nation_name FROM nation),
s AS (SELECT c_mktsegment AS segment, count(*) AS segment_size FROM customer GROUP BY 1)
SELECT DISTINCT * FROM (
  SELECT c_custkey, nation, segment, nation_name, NULL::BIGINT AS segment_size FROM c LEFT JOIN n USING (nation) WHERE nation IS NOT NULL
  UNION ALL SELECT c_custkey, nation, segment, NULL, segment_size FROM c LEFT JOIN s USING (segment) WHERE segment IS NOT NULL
  UNION ALL SELECT c_custkey, nation, segment, NULL, NULL FROM c WHERE nation IS NULL OR segment IS NULL)""")
def multi_key_union(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    rows = customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"))
    segments = customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("segment_size"))
    return panel.union_by_keys(rows, [(nations, ["nation"]), (segments, ["segment"])])


@query("first_match", """
WITH f AS (SELECT l_partkey, min((l_orderkey, l_linenumber, l_suppkey)) AS k FROM lineitem GROUP BY 1)
SELECT p_partkey, p_name, k[3] AS l_suppkey FROM part LEFT JOIN f ON p_partkey = l_partkey""")
def first_match(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", "l_linenumber")
    return panel.first_match(part, lines, "p_partkey", ["l_suppkey"], F.struct("l_orderkey", "l_linenumber", "l_suppkey"))


@query("fallback_lookup", """
WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
c AS (SELECT c_nationkey, min(c_custkey) AS v FROM customer GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v, -c.v) AS found FROM customer
LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k LEFT JOIN c USING (c_nationkey)""")
def fallback_lookup(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("k"), "o_orderstatus"
    )
    by_nation = customer.select("c_nationkey", (-F.col("c_custkey")).alias("v"), F.col("c_custkey").alias("k"))
    out = panel.fallback_lookup(customer.withColumn("found", F.lit(None).cast("long")), "found", [
        (orders.filter("o_orderstatus = 'F'"), "c_custkey", "v", "k"), (orders, "c_custkey", "v", "k"), (by_nation, "c_nationkey", "v", "k"),
    ])
    return out.select("c_custkey", "found")


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    urgent = orders_with_year(spark, folder).filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("account"), "year").agg(
        F.max("o_orderpriority").alias("priority")
    )
    accounts = table(spark, folder, "customer").select(F.col("c_custkey").alias("account"))
    known = accounts.join(urgent, "account", "left")
    return panel.year_grid(known, "account", "year", 1995, 2001)


GRID_SQL = """
WITH known AS (SELECT o_custkey AS account, year(o_orderdate) AS year, max(o_orderpriority) AS priority FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
grid AS (SELECT c_custkey AS account, unnest(range(1995, 2002)) AS year FROM customer),
filled AS (
  SELECT account, year::INTEGER AS year, priority,
    last_value(priority IGNORE NULLS) OVER (PARTITION BY account ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down,
    first_value(priority IGNORE NULLS) OVER (PARTITION BY account ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up
  FROM grid LEFT JOIN known USING (account, year))
"""


@query("grid_fill", GRID_SQL + """
SELECT account, year, priority, down AS filled_down, coalesce(up, down) AS filled_updown, coalesce(down, up) AS filled_downup FROM filled""")
def grid_fill(spark: SparkSession, folder: str) -> DataFrame:
    grid = _grid(spark, folder)
    for direction in ("down", "updown", "downup"):
        grid = grid.withColumn("filled_" + direction, F.col("priority"))
    for direction in ("down", "updown", "downup"):
        grid = panel.fill_panel(grid, ["filled_" + direction], ["account"], "year", direction)
    return grid


@query("row_fill", """
WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS s FROM orders),
known AS (SELECT o_custkey, year, max(s) AS s FROM o GROUP BY 1, 2),
f AS (SELECT o_custkey, year, coalesce(
        first_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS f FROM known)
SELECT o_orderkey, o_custkey, year, coalesce(s, f) AS s FROM o JOIN f USING (o_custkey, year)""")
def row_fill(spark: SparkSession, folder: str) -> DataFrame:
    rows = orders_with_year(spark, folder).select(
        "o_orderkey", "o_custkey", "year", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("s")
    )
    return panel.fill(rows, ["s"], ["o_custkey"], "year", "updown")


@query("semi_anti_overlap", """
WITH early AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995),
late AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 2001)
SELECT c_custkey, 'early' AS slice FROM customer WHERE c_custkey IN (SELECT k FROM early)
UNION ALL SELECT c_custkey, 'not early' FROM customer WHERE c_custkey NOT IN (SELECT k FROM early)
UNION ALL SELECT k, 'both' FROM (SELECT k FROM early INTERSECT SELECT k FROM late)""")
def semi_anti_overlap(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey")
    orders = orders_with_year(spark, folder).select(F.col("o_custkey").alias("c_custkey"), "year")
    early, late = orders.filter("year = 1995"), orders.filter("year = 2001")
    tag = lambda df, name: df.withColumn("slice", F.lit(name))
    return (
        tag(panel.within(customer, early, ["c_custkey"]), "early")
        .unionByName(tag(panel.only_in(customer, early, ["c_custkey"]), "not early"))
        .unionByName(tag(panel.key_overlap(early, late, ["c_custkey"]), "both"))
    )


@query("outer_merge", """
WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE year(o_orderdate) = 1995),
b AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE year(o_orderdate) = 1996)
SELECT o_custkey, o_orderstatus, o_orderpriority, a.o_custkey IS NOT NULL AS in_a, b.o_custkey IS NOT NULL AS in_b
FROM a FULL JOIN b USING (o_custkey, o_orderstatus, o_orderpriority)""")
def outer_merge(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = orders_with_year(spark, folder)
    part = lambda y, name: orders.filter(F.col("year") == y).select(*keys).distinct().withColumn(name, F.lit(True))
    merged = panel.join_on(part(1995, "in_a"), part(1996, "in_b"), keys, "full", "match")
    return merged.fillna(False, subset=["in_a", "in_b"])


@query("name_key_fill", """
WITH known AS (SELECT replace(lower(p_name), ' ', '') AS k, min_by(p_type, p_partkey) AS t FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT p_partkey, coalesce(t, p_type) AS p_type FROM part LEFT JOIN known ON replace(lower(p_name), ' ', '') = k""")
def name_key_fill(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    known = part.filter("p_type <> 'PROMO'")
    return panel.fill_from(part, known, cells.compact_name(F.col("p_name")), "p_type", "p_partkey").select("p_partkey", "p_type")


@query("attach_region", """
WITH first AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1)
SELECT c_custkey, first_priority, r_name FROM customer LEFT JOIN first ON c_custkey = o_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def attach_region(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    first = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("first_priority"), "o_orderkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    out = panel.attach_first(customer, first, "c_custkey", "o_orderkey")
    return out.join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left").select("c_custkey", "first_priority", "r_name")


@query("overwrite_columns", """
WITH o AS (SELECT c_custkey, upper(c_name) AS c_name, c_nationkey + 1 AS extra FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c.c_custkey, o.c_name, c.c_mktsegment, o.extra FROM customer c LEFT JOIN o USING (c_custkey)""")
def overwrite_columns(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    other = customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_nationkey") + 1).alias("extra"))
    return panel.overwrite_columns(customer.select("c_custkey", "c_name", "c_mktsegment"), other, ["c_custkey"])


@query("account_slice", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 10 OFFSET 90)""")
def account_slice(spark: SparkSession, folder: str) -> DataFrame:
    return panel.account_slice(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 90, 100)


def nation_years(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals per nation and year; amounts are summed per customer first."""
    per_customer = orders_with_year(spark, folder).groupBy("o_custkey", "year").agg(
        F.sum(money("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n")
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "year").agg(
        F.sum("total").cast("double").alias("total"), F.sum("n").alias("n")
    )


NATION_SQL = """
WITH y AS (SELECT c_nationkey, year(o_orderdate) AS year, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""


@query("lag_growth", NATION_SQL + """
SELECT c_nationkey, year, total, n, lag(total) OVER w AS next_total, lag(n) OVER w AS next_n,
       round((lag(total) OVER w - total) / total, 9) AS growth_total, round((lag(n) OVER w - n) / n, 9) AS growth_n
FROM y WINDOW w AS (PARTITION BY c_nationkey ORDER BY year)""")
def lag_growth(spark: SparkSession, folder: str) -> DataFrame:
    out = panel.lag_growth(nation_years(spark, folder), ["total", "n"], ["c_nationkey"], "year")
    return out.withColumn("growth_total", F.round("growth_total", 9)).withColumn("growth_n", F.round("growth_n", 9))


@query("percent_change", NATION_SQL + """
SELECT c_nationkey, year, round(total / lag(total) OVER (PARTITION BY c_nationkey ORDER BY year) - 1, 9) AS change FROM y""")
def percent_change(spark: SparkSession, folder: str) -> DataFrame:
    out = panel.percent_change(nation_years(spark, folder), "total", ["c_nationkey"], "year", "change")
    return out.select("c_nationkey", "year", F.round("change", 9).alias("change"))
