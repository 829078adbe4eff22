"""Sheet files, survey files, configs and rates written out of the tables and read back; names and headers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from surveyloom.functions import cells, columns as C
from surveyloom.operators import matching, models, panel, responses
from surveyloom.plans.indicator_table import in_survey
from surveyloom.queries.registry import number, query, table
from surveyloom.session import checkpoint_dir
from surveyloom.sources import files


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def place_file(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The rows as one file of exactly this name, in the file system of the path."""
    spark, made = df.sparkSession, f"{path}.made"
    writer = df.coalesce(1).write
    (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(made) if fmt == "csv" else writer.text(made))
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    part = fs.globStatus(jvm.org.apache.hadoop.fs.Path(made + "/part-*"))[0].getPath()
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(jvm.org.apache.hadoop.fs.Path(made), True)


SHEETS = (("investor", 1996, 1, "C1 Intro", "F"), ("investor", 1996, 2, "C2 Targets", "O"), ("investor", 1997, 3, "C1 Intro", "F"),
          ("supply_chain", 1996, 1, "C1 Intro", "O"), ("supply_chain", 1997, 7, "C9 + Rest", "P"))
WANTED = (("investor", 1996, ((1, 1),)), ("investor", 1997, ((1, 9),)), ("supply_chain", 1997, ((2, 3), (6, 7))))


@query("configured_sheets", "WITH s(label, year, sheet_no, sheet, status) AS (VALUES " + ", ".join(str(x) for x in SHEETS) + """)
SELECT label, year::INTEGER AS year, sheet_no::INTEGER AS sheet_no, sheet, count(*) AS n, sum(o_custkey)::BIGINT AS accounts
FROM s JOIN orders ON o_orderstatus = status AND year(o_orderdate) = year
WHERE (label, year, sheet_no) IN (('investor', 1996, 1), ('investor', 1997, 3), ('supply_chain', 1997, 7)) GROUP BY 1, 2, 3, 4""")
def configured_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet files by label and year, of which a JSON config wants some by their number."""
    path, orders = new_folder(spark, "sheets"), table(spark, folder, "orders")
    for label, year, no, sheet, status in SHEETS:
        own = orders.filter((F.col("o_orderstatus") == status) & (F.year("o_orderdate") == year))
        place_file(own.select(*(["o_orderkey", "o_custkey"] if no % 2 else ["o_custkey", "o_orderpriority", "o_orderkey"])), f"{path}/books/{label}/{year}/{no}_{sheet}.csv")
    entries = F.explode(F.array(*[F.struct(
        F.lit(year).alias("year"), F.lit(label).alias("label"), F.lit("o_custkey").alias("join"),
        F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges]).alias("sheets")) for label, year, ranges in WANTED]))
    listed = spark.range(1).select(entries.alias("e")).agg(F.to_json(F.collect_list("e")).alias("value"))
    place_file(listed, f"{path}/config.json", "text")
    sheets = files.read_sheets(spark, f"{path}/books/*/*/*.csv", "csv")
    kept = responses.filter_sheets(sheets, files.read_config(spark, f"{path}/config.json"))
    return kept.groupBy("label", "year", "sheet_no", "sheet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_custkey").cast("bigint")).alias("accounts"))


CELL = "CASE o_orderkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' WHEN 2 THEN 'Question not applicable' ELSE o_orderpriority END"


def _survey_files(spark: SparkSession, folder: str) -> str:
    """Two files of different layout, the year in their names."""
    path = new_folder(spark, "survey")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("Row"), F.col("o_custkey").alias("Account No"), F.expr(CELL).alias("Answer"), F.year("o_orderdate").alias("_y"))
    place_file(rows.filter("_y = 1996").select("Row", "Account No", "Answer"), f"{path}/1996 CDP answers.csv")
    place_file(rows.filter("_y = 1997").select("Row", "Answer", F.col("Account No"), F.lit("x").alias("Extra")), f"{path}/answers_1997.csv")
    return path


@query("survey_files", f"""
SELECT year(o_orderdate)::INTEGER AS year, CASE year(o_orderdate) WHEN 1996 THEN '1996 CDP answers.csv' ELSE 'answers_1997.csv' END AS filename, o_custkey::VARCHAR AS "account no", {CELL} AS answer,
  CASE year(o_orderdate) WHEN 1997 THEN 'x' END AS extra FROM orders WHERE year(o_orderdate) IN (1996, 1997)""")
def survey_files(spark: SparkSession, folder: str) -> DataFrame:
    """All columns as text without the first, names in lower case, year and name from the file."""
    return files.read_survey_csv(spark, f"{_survey_files(spark, folder)}/*.csv").select("year", "filename", "account no", "answer", "extra")


@query("files_with_nulls", f"""
SELECT o_orderkey::VARCHAR AS "Row", nullif(nullif(nullif({CELL}, 'NA'), ' '), 'Question not applicable') AS "Answer" FROM orders WHERE year(o_orderdate) IN (1996, 1997)""")
def files_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that stand for no answer read as null."""
    return files.read_with_nulls(spark, f"{_survey_files(spark, folder)}/*.csv").select("Row", "Answer")


@query("typed_files", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_custkey AS account, count(*) AS n FROM orders GROUP BY 1, 2""")
def typed_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV under a given schema: dates stay text, keys are numbers."""
    path = new_folder(spark, "typed")
    files.write_csv(table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_custkey").alias("account")), path)
    schema = T.StructType([T.StructField("day", T.StringType()), T.StructField("account", T.LongType())])
    return files.read_csv(spark, path, schema).groupBy("day", "account").agg(F.count(F.lit(1)).alias("n"))


@query("id_list", "SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_orderstatus = 'F'")
def id_list(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ids written one per line and read back."""
    path = new_folder(spark, "ids")
    files.write_ids(table(spark, folder, "orders").withColumn("id", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))), "id", path)
    return spark.read.text(path)


CURRENCIES = ("EUR", "JPY", "GBP")


@query("rate_files", "WITH w AS (SELECT year(o_orderdate)::INTEGER AS year, " + ", ".join(
    f"max(o_orderkey) FILTER (o_orderkey % 3 = {k} AND o_custkey % 7 > year(o_orderdate) % 7) AS {c}" for k, c in enumerate(CURRENCIES)) + """ FROM orders GROUP BY 1)
SELECT year, currency, rate::DOUBLE AS rate FROM (UNPIVOT w ON """ + ", ".join(CURRENCIES) + " INTO NAME currency VALUE rate)")
def rate_files(spark: SparkSession, folder: str) -> DataFrame:
    """One column per currency in a file, one row per year and currency afterwards; missing rates give no row."""
    path, year = new_folder(spark, "rates"), F.year("o_orderdate")
    rates = [F.max(F.when((F.col("o_orderkey") % 3 == k) & (F.col("o_custkey") % 7 > year % 7), F.col("o_orderkey"))).alias(c) for k, c in enumerate(CURRENCIES)]
    files.write_csv(table(spark, folder, "orders").groupBy(year.alias("year")).agg(*rates), path)
    return files.read_rates(spark, path)


@query("header_rules", """
SELECT 2015 AS year, 'investor' AS label, s_suppkey AS account, s_name AS tru_company_name, s_acctbal AS tru_revt, s_nationkey AS climate_spec_sum FROM supplier""")
def header_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Headers by code, prefix, tidied indicator names, a rename with absent names, year and label first, and the order of another frame."""
    rows = table(spark, folder, "supplier").toDF("key", "company name", "climate_spec|value=sum", "Revenue 319522 (USD)")
    rows = C.rename_present(rows, {"key": "account", "not there": "x"})
    rows = C.tidy_indicator_names(rows.withColumnRenamed("climate_spec|value=sum", "model=climate_spec|value=sum"))
    rows = C.rename_by_code(rows, {"319522": "tru_revt"})
    rows = C.prefix_columns(rows, "tru_", keep=("account", "tru_revt", "climate_spec_sum"))
    rows = C.add_year_label(rows, 2015, "investor")
    return C.reorder_like(rows, spark.createDataFrame([], "year int, label string, account long, tru_company_name string, tru_revt double, climate_spec_sum int"))


@query("numbered_properties", """
WITH n AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, 'column=' || p_name || '|sheet=' || p_brand || CASE WHEN k > 0 THEN '|number=' || k ELSE '' END || '|value=response' AS name FROM n""")
def numbered_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats of a structured name told apart by a property."""
    part = table(spark, folder, "part")
    named = part.select("p_partkey", "p_brand", C.create_column(column=F.col("p_name"), sheet=F.col("p_brand"), value="response").alias("name"))
    return C.number_repeats(named, "name", ["p_brand"], "p_partkey").select("p_partkey", "name")


@query("printed_lists", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN NULL ELSE p_size::DOUBLE END AS n, replace(p_brand || ' & ' || p_type, '&', 'and') AS name,
  CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS last FROM part""")
def printed_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers out of printed one-element lists, ampersands, and the last column that has a value."""
    size = F.col("p_size").cast("string")
    printed = F.when(F.col("p_size") % 4 == 0, F.lit("[None]")).when(F.col("p_size") % 4 == 1, F.lit(None)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("['"), size, F.lit("']"))).otherwise(F.concat(F.lit("["), size, F.lit(".0]")))
    third, second = F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    return table(spark, folder, "part").select(
        "p_partkey", cells.to_number(printed).alias("n"), cells.ampersand_to_and(F.concat("p_brand", F.lit(" & "), "p_type")).alias("name"),
        cells.rightmost(F.col("p_name"), second, third).alias("last"))


@query("key_and_year_lookup", """
WITH f AS (SELECT o_custkey % 50 AS isin, year(o_orderdate) AS year, min_by(o_orderstatus, o_orderkey) AS ref FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
g AS (SELECT o_custkey % 50 AS isin, min_by(o_orderpriority, o_orderkey) AS ref FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(f.ref, g.ref) AS ref FROM orders o LEFT JOIN f ON f.isin = o_custkey % 50 AND f.year = year(o_orderdate) LEFT JOIN g ON g.isin = o_custkey % 50""")
def key_and_year_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A value by id and year, else by the id alone."""
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("isin"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    dated = orders.filter("o_orderkey % 3 = 0").select("isin", "year", F.col("o_orderstatus").alias("found"), F.col("o_orderkey").alias("at"))
    single = orders.filter("o_orderkey % 7 = 0").select("isin", F.col("o_orderpriority").alias("found"), F.col("o_orderkey").alias("at"))
    base = orders.select("o_orderkey", "isin", "year").withColumn("ref", F.lit(None).cast("string"))
    return panel.fallback_lookup(base, "ref", [(dated, ["isin", "year"], "found", "at"), (single, "isin", "found", "at")]).select("o_orderkey", "ref")


@query("manual_mapping", """
WITH m AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN 'column=' || p_name || '|sheet=' || p_brand || '|value=response' END AS a,
  CASE WHEN p_partkey % 5 > 0 THEN 'column=' || p_type || '|sheet=' || p_name || '|value=response' END AS b FROM part),
e AS (SELECT 'a' AS t, a AS c FROM m UNION ALL SELECT 'b', b FROM m)
SELECT t AS "table", c AS "column", count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def manual_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """A hand-made mapping read into structured names; entries that it lists more than once."""
    k = F.col("p_partkey")
    manual = table(spark, folder, "part").select(
        F.when(k % 3 > 0, F.col("p_name")).alias("a__column"), F.col("p_brand").alias("a__sheet"), F.col("p_type").alias("b__column"), F.when(k % 5 > 0, F.col("p_name")).alias("b__sheet"))
    return matching.repeated_entries(matching.import_mapping(manual, ["a", "b"]), ["a", "b"])


@query("mapping_accuracy", """
WITH m AS (SELECT 'p' || p_size % 3 AS pair, p_partkey::VARCHAR AS a, CASE WHEN p_size % 4 > 0 THEN p_name END AS b, CASE WHEN p_size % 7 > 0 THEN p_name ELSE p_type END AS t FROM part)
SELECT pair, round(avg(coalesce(b = t, false)::INTEGER), 6) AS accuracy, count(*) AS n FROM m GROUP BY 1""")
def mapping_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of columns mapped as in a hand-made truth, by pair of tables."""
    part, size = table(spark, folder, "part"), F.col("p_size")
    rows = part.select(F.concat(F.lit("p"), (size % 3).cast("string")).alias("pair"), F.col("p_partkey").cast("string").alias("column_a"),
                       F.when(size % 4 > 0, F.col("p_name")).alias("column_b"), F.when(size % 7 > 0, F.col("p_name")).otherwise(F.col("p_type")).alias("truth"))
    out = matching.mapping_accuracy(rows.drop("truth"), rows.select("pair", "column_a", F.col("truth").alias("column_b")))
    return out.withColumn("accuracy", number(F.col("accuracy")))


@query("survey_proper", """
SELECT sheet, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'Summary Data' WHEN 1 THEN '*' ELSE p_brand END AS sheet FROM part)
WHERE NOT starts_with(sheet, 'Summary') AND sheet <> '*' GROUP BY 1""")
def survey_proper(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of the survey proper, without summaries and properties of whole workbooks."""
    sheet = F.when(F.col("p_size") % 4 == 0, "Summary Data").when(F.col("p_size") % 4 == 1, "*").otherwise(F.col("p_brand"))
    return table(spark, folder, "part").select(sheet.alias("sheet")).filter(in_survey(F.col("sheet"))).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


# -- models with the fitted part given: what remains is arithmetic -------------------------
@query("scaled_features", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, avg(o_custkey) AS km, stddev_samp(o_custkey) AS kd FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS price, round((o_custkey - km) / kd, 6) AS account FROM orders, s""")
def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("account"))
    scaled = models.scaled_features(rows, ["o_totalprice", "account"]).withColumn("v", vector_to_array("features"))
    return scaled.select("o_orderkey", number(F.get("v", 0)).alias("price"), number(F.get("v", 1)).alias("account"))


@query("profile_of_groups", """
WITH c AS (SELECT c_nationkey % 5 AS cluster, c_mktsegment AS sector, floor(c_acctbal) AS balance, c_custkey % 9 AS maturity FROM customer),
t AS (SELECT cluster, sector, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, sector DESC) AS r FROM c GROUP BY 1, 2)
SELECT cluster, count(*) AS size, round(avg(balance), 6) AS balance, round(avg(maturity), 6) AS avg_maturity, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS percentage,
  any_value(t.sector) AS dominant_sector, round(any_value(n) * 100.0 / count(*), 6) AS dominant_sector_pct FROM c JOIN t USING (cluster) WHERE r = 1 GROUP BY 1""")
def profile_of_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Size, means, share and leading sector of given groups."""
    rows = table(spark, folder, "customer").select(
        (F.col("c_nationkey") % 5).alias("cluster"), F.col("c_mktsegment").alias("sector"), F.floor("c_acctbal").cast("double").alias("balance"), (F.col("c_custkey") % 9).alias("maturity"))
    out = models.cluster_profile(rows, ["balance"], "maturity", "sector")
    return out.select("cluster", "size", *[number(F.col(c)).alias(c) for c in ("balance", "avg_maturity", "percentage")], "dominant_sector", number(F.col("dominant_sector_pct")).alias("dominant_sector_pct"))


@query("binary_metrics", """
WITH s AS (SELECT (o_totalprice > 150000)::INTEGER AS y, (o_orderkey % 3 = 0)::INTEGER AS h FROM orders),
c AS (SELECT count(*) FILTER (y = 1 AND h = 1) AS tp, count(*) FILTER (y = 0 AND h = 1) AS fp, count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 0 AND h = 0) AS tn FROM s)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select((F.col("o_totalprice") > 150000).cast("int").alias("y"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("h"))
    return models.binary_metrics(rows, "y", "h").select(*[number(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
