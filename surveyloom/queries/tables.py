"""Workbook joins, layouts, column pruning, rule renames, overrides, condensing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from surveyloom.functions import columns as C, fixed_values as V, rename_rules as RR
from surveyloom.operators import condense, eras, responses, rules
from surveyloom.queries.registry import number, query, table
from surveyloom.session import checkpoint_dir, literal_frame
from surveyloom.sources import files


@query("workbook_join", """
WITH lines AS (
  SELECT l_orderkey::VARCHAR AS key, 'lines' AS sheet, unnest(['l_partkey', 'l_returnflag', 'l_linestatus']) AS col,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS pos,
         unnest([l_partkey::VARCHAR, l_returnflag, l_linestatus]) AS value FROM lineitem),
heads AS (
  SELECT o_orderkey::VARCHAR, 'heads', unnest(['o_orderstatus', 'o_orderpriority']), 0, unnest([o_orderstatus, o_orderpriority]) FROM orders)
SELECT key, sheet, col AS "column", pos::INTEGER AS pos, value FROM (SELECT * FROM lines UNION ALL SELECT * FROM heads)""")
def workbook_join(spark: SparkSession, folder: str) -> DataFrame:
    # Row numbers of the sheet as a whole, so that the rows of a key lie in as many blocks as they take.
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"), "l_partkey", "l_returnflag", "l_linestatus"
    )
    heads = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("row_no"), "o_orderstatus", "o_orderpriority"
    )
    return responses.sheet_to_long(lines, "lines", "key", "row_no", order=["l_partkey", "l_returnflag", "l_linestatus"]).unionByName(
        responses.sheet_to_long(heads, "heads", "key", "row_no")
    )


@query("diagonal_union", """
SELECT 'customer' AS filename, c_name AS name, c_nationkey::VARCHAR AS country, c_mktsegment AS "primary industry", NULL::VARCHAR AS ticker FROM customer
UNION ALL SELECT 'supplier', s_name, s_nationkey::VARCHAR, NULL, NULL FROM supplier""")
def diagonal_union(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select(
        F.lit("customer").alias("filename"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("primary industry")
    )
    supplier = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("filename"), F.col("s_nationkey").alias("country"), F.col("s_name").alias("name")
    )
    return responses.union_layouts([customer, supplier], ["filename", "name", "country", "primary industry", "ticker"])


HEADER_TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}

#: A column that is emptied, so that a column without any value is among them.
EMPTIED = ("supplier", "s_acctbal")


def table_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of all tables, one of them emptied."""
    out = None
    for name in HEADER_TABLES:
        rows = table(spark, folder, name)
        if name == EMPTIED[0]:
            rows = rows.withColumn(EMPTIED[1], F.nullif(F.col(EMPTIED[1]), F.col(EMPTIED[1])))
        one = responses.headers(rows, name)
        out = one if out is None else out.unionByName(one)
    return out


def _headers_sql() -> str:
    parts = []
    for name, columns in HEADER_TABLES.items():
        names = columns.split()
        counts = ", ".join("0" if (name, c) == EMPTIED else f"count({c})" for c in names)
        parts.append(f"SELECT '{name}', unnest([{', '.join(repr(c) for c in names)}]), unnest({list(range(len(names)))}), unnest([{counts}]) FROM {name}")
    return "WITH cols(workbook, col, position, filled) AS (" + " UNION ALL ".join(parts) + ")"


@query("drop_redundant", _headers_sql() + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY workbook, regexp_matches(col, '(?i)^._[a-z]*key') ORDER BY position) AS r,
                    regexp_matches(col, '(?i)^._[a-z]*key') AS hit FROM cols)
SELECT workbook, col AS "column", position, filled FROM ranked
WHERE NOT (hit AND r > 1) AND NOT regexp_matches(col, '(?i)^(?:c_acctbal|._retail)') AND filled > 0""")
def drop_redundant(spark: SparkSession, folder: str) -> DataFrame:
    return responses.drop_columns(table_headers(spark, folder), ["._[a-z]*key"], ["c_acctbal", "._retail"])


@query("column_codec", """
SELECT p_partkey, 'column=' || p_name || '|sheet=' || p_brand || '|value=response' AS standard,
       'column=' || p_name || '|sheet=' || p_brand || '|model=' || p_type || '|label=yes|value=score' AS scored,
       p_brand AS sheet, p_type = 'PROMO' AS is_promo FROM part""")
def column_codec(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    name = C.create_column(column=F.col("p_name"), sheet=F.col("p_brand"), value="response")
    scored = C.update_column(F.col("standard"), model=F.col("p_type"), label="yes", value="score")
    return part.withColumn("standard", name).withColumn("scored", scored).select(
        "p_partkey", "standard", "scored", C.column_property(F.col("scored"), "sheet").alias("sheet"),
        C.has_properties(F.col("scored"), model="PROMO", value="score").alias("is_promo"),
    )


RENAME_RULES = (
    ((1995, 1996), "", "small.*ring|red.*ring", "ring"),
    (None, "brand#1", "widget", "first_brand_widget"),
    ((1997, 1998, 1999), "", "widget$", "widget"),
    (None, "", "^hot|^cold", "temperature"),
)


@query("rule_rename", """
WITH headers AS (
  SELECT DISTINCT year(o_orderdate) AS year, p_brand AS file, p_name AS header
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
SELECT year, file, header, CASE
  WHEN year IN (1995, 1996) AND regexp_matches(lower(header), 'small.*ring|red.*ring') THEN 'ring'
  WHEN regexp_matches(lower(file), 'brand#1') AND regexp_matches(lower(header), 'widget') THEN 'first_brand_widget'
  WHEN year IN (1997, 1998, 1999) AND regexp_matches(lower(header), 'widget$') THEN 'widget'
  WHEN regexp_matches(lower(header), '^hot|^cold') THEN 'temperature' ELSE lower(header) END AS topic
FROM headers""")
def rule_rename(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    orders = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey")
    headers = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "year", F.col("p_brand").alias("file"), F.col("p_name").alias("header")
    ).distinct()
    topic = rules.topic_of(F.col("header"), RENAME_RULES, F.col("year"), F.col("file"))
    return headers.withColumn("topic", F.coalesce(topic, F.lower("header")))


def example_header(pattern: str) -> str:
    """A wording that the first alternative of a rule's pattern fits, with a gap for other words."""
    text = rules._alternatives(re.sub(r"^\(\?\w+\)", "", pattern))[0]
    for old, new in ((".*", " {} "), ("\\s*", " "), ("^", ""), ("$", "")):
        text = text.replace(old, new)
    return re.sub(r"\\(.)", r"\1", text)


SURVEY_RULES = RR.TARGET_RULES + RR.EMISSION_RULES


def _worded_headers_sql(rule_list: tuple) -> str:
    """Part names inside the wordings of the rules, in all survey years, half of them in files the rules name."""
    quoted = lambda texts: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"
    n = len(rule_list)
    return f"""
WITH w AS (SELECT p_partkey, p_name, p_brand, {quoted(example_header(r[2]) for r in rule_list)}[p_partkey % {n} + 1] AS w,
             {quoted(example_header(r[1]) for r in rule_list)}[p_partkey % {n} + 1] AS f FROM part),
h AS (SELECT DISTINCT unnest(range(2010, 2021))::INTEGER AS year, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'CC ' || f || '.csv' END AS file,
        CASE WHEN p_partkey % 2 = 0 THEN upper(replace(w, '{{}}', p_name)) ELSE replace(w, '{{}}', p_name) END AS header FROM w)
"""


def worded_headers(spark: SparkSession, folder: str, rule_list: tuple) -> DataFrame:
    pick = lambda texts: F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(rule_list)).cast("int"))
    word = F.replace(pick([example_header(r[2]) for r in rule_list]), F.lit("{}"), F.col("p_name"))
    file = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("CC "), pick([example_header(r[1]) for r in rule_list]), F.lit(".csv")))
    return table(spark, folder, "part").select(
        F.explode(F.sequence(F.lit(2010), F.lit(2020))).alias("year"), file.alias("file"), F.when(F.col("p_partkey") % 2 == 0, F.upper(word)).otherwise(word).alias("header")
    ).distinct()


def _topic_sql(rule_list: tuple) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    cases = []
    for years, file_pattern, pattern, topic in rule_list:
        parts = [f"year IN ({', '.join(map(str, years))})"] if years else []
        parts += [f"regexp_matches(lower(file), {quote(file_pattern)})"] if file_pattern else []
        cases.append(f"WHEN {' AND '.join([*parts, f'regexp_matches(lower(header), {quote(pattern)})'])} THEN {quote(topic)}")
    return "CASE " + " ".join(cases) + " END"


@query("topic_rules", _worded_headers_sql(SURVEY_RULES) + f"""
SELECT year, file, header, {_topic_sql(RR.TARGET_RULES)} AS target_topic, {_topic_sql(RR.EMISSION_RULES)} AS emission_topic FROM h""")
def topic_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All rules for targets and for emissions over question wordings of eleven years."""
    headers = worded_headers(spark, folder, SURVEY_RULES)
    named = rules.topics_by_index(headers, RR.TARGET_RULES).withColumnRenamed("topic", "target_topic")
    return rules.topics_by_index(named, RR.EMISSION_RULES).withColumnRenamed("topic", "emission_topic")


@query("summary_rules", _worded_headers_sql(RR.SUMMARY_RULES) + f"""
, k AS (SELECT file, header, row_number() OVER (PARTITION BY file ORDER BY header) AS position FROM (SELECT DISTINCT file, header FROM h)),
m AS (SELECT k.*, t.topic, t.first_only FROM k JOIN (VALUES {', '.join(f"('{t}', '{p}', {str(f).lower()})" for t, p, f in RR.KEY_HEADERS)}) t(topic, pattern, first_only)
      ON regexp_matches(lower(header), pattern)),
f AS (SELECT file, position, min(topic) AS topic FROM m WHERE NOT first_only OR position = (SELECT min(position) FROM m x WHERE x.file = m.file AND x.topic = m.topic) GROUP BY 1, 2)
SELECT k.file, k.header, k.position, coalesce(f.topic, {_topic_sql(RR.SUMMARY_RULES)}, lower(header)) AS topic FROM k LEFT JOIN f USING (file, position)""")
def summary_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Header synonyms of the summary sheets, keys first."""
    headers = worded_headers(spark, folder, RR.SUMMARY_RULES).select("file", "header").distinct()
    w = Window.partitionBy("file").orderBy("header")
    return rules.rename_headers(headers.withColumn("position", F.row_number().over(w)), RR.SUMMARY_RULES).select("file", "header", F.col("position").cast("long").alias("position"), "topic")


KEYS = (("first_ring", "ring", True), ("any_bolt", "bolt", False))


@query("key_headers", """
WITH matched AS (
  SELECT p_brand AS file, p_name AS header, p_partkey AS position, CASE WHEN contains(p_name, 'ring') THEN 'first_ring' ELSE 'any_bolt' END AS topic
  FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt'))
SELECT file, header, position, topic FROM matched m
WHERE topic = 'any_bolt' OR position = (SELECT min(position) FROM matched n WHERE n.file = m.file AND n.topic = m.topic)""")
def key_headers(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("header"), F.col("p_partkey").alias("position"))
    return rules.key_headers(headers, KEYS)


@query("coalesce_duplicates", """
SELECT l_orderkey, l_returnflag AS topic, min_by(l_partkey, (l_linenumber, l_partkey))::VARCHAR AS value FROM lineitem GROUP BY 1, 2""")
def coalesce_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    long = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("topic"), F.col("l_partkey").cast("string").alias("value"),
        F.struct("l_linenumber", "l_partkey").alias("position"),
    )
    return condense.coalesce_duplicates(long, ["l_orderkey"])


OVERRIDES = (
    (1, 1995, 2001, "o_orderstatus", "X"),
    (2, 1995, 1997, "o_orderstatus", "Y"),
    (2, 1998, 2001, "o_orderpriority", "9-FIXED"),
    (3, 1995, 2001, "o_orderstatus", None),
    (1, 2000, 2001, "o_orderstatus", "Z"),
)


@query("overrides", """
SELECT o_orderkey, o_custkey, year(o_orderdate) AS year,
  CASE WHEN o_custkey = 1 AND year(o_orderdate) BETWEEN 2000 AND 2001 THEN 'Z' WHEN o_custkey = 1 THEN 'X'
       WHEN o_custkey = 2 AND year(o_orderdate) BETWEEN 1995 AND 1997 THEN 'Y' WHEN o_custkey = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_custkey = 2 AND year(o_orderdate) BETWEEN 1998 AND 2001 THEN '9-FIXED' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def overrides(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    fixes = literal_frame(
        spark, [(*row, i) for i, row in enumerate(OVERRIDES)], "key long, year_from int, year_to int, field string, value string, rank int"
    )
    return rules.apply_overrides(orders, fixes, "o_custkey", "year", {"o_orderstatus": "string", "o_orderpriority": "string"})


@query("condense_strings", """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderdate, o_orderpriority AS p, o_orderstatus AS s FROM orders),
p AS (SELECT o_custkey, year, p, min(o_orderdate) AS k FROM o GROUP BY 1, 2, 3),
s AS (SELECT o_custkey, year, s, min(o_orderdate) AS k FROM o GROUP BY 1, 2, 3)
SELECT * FROM (SELECT o_custkey, year, string_agg(p, ', ' ORDER BY k, p) AS priorities FROM p GROUP BY 1, 2)
JOIN (SELECT o_custkey, year, string_agg(s, ', ' ORDER BY k, s) AS statuses FROM s GROUP BY 1, 2) USING (o_custkey, year)""")
def condense_strings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    return condense.condense(orders, ["o_custkey", "year"], {"priorities": "o_orderpriority", "statuses": "o_orderstatus"}, ["o_orderdate"])


@query("condense_sources", """
WITH cells AS (
  SELECT o_custkey, 0 AS rank, (o_orderdate, o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS v FROM orders
  UNION ALL SELECT o_custkey, 1, (o_orderdate, o_orderkey), CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END FROM orders),
seen AS (SELECT o_custkey, v, min((rank, k)) AS k FROM cells WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT c.o_custkey, string_agg(v, ', ' ORDER BY k) AS priorities
FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN seen USING (o_custkey) GROUP BY 1""")
def condense_sources(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    at = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))
    both = orders.withColumn("first_source", at("F")).withColumn("second_source", at("O"))
    return condense.condense(both, ["o_custkey"], {"priorities": ["first_source", "second_source"]}, ["o_orderdate", "o_orderkey"])


def _era_sql(distinct: str) -> str:
    return """
WITH rows AS (
  SELECT """ + distinct + """l_suppkey, year(l_shipdate) AS year, l_quantity AS v, CASE
      WHEN year(l_shipdate) >= 1999 THEN CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Reporting year' WHEN l_returnflag = 'N' THEN 'Row 1' ELSE 'Row 2' END
      WHEN year(l_shipdate) = 1998 THEN (1995 + l_linenumber)::VARCHAR
      ELSE strftime(l_shipdate - to_days((l_linenumber * 100)::INTEGER), '%d %b %Y') END AS tag
  FROM lineitem)
SELECT l_suppkey, year, round(CASE
  WHEN year BETWEEN 1999 AND 2001 THEN coalesce(avg(v) FILTER (tag = 'Reporting year'), avg(v) FILTER (tag = 'Row 1'))
  WHEN year BETWEEN 1995 AND 1997 THEN avg(v) FILTER (try_cast(right(tag, 4) AS INTEGER) = year - 1)
  WHEN year = 1998 THEN avg(v) FILTER (try_cast(tag AS INTEGER) = year - 1) END, 6) AS figure
FROM rows GROUP BY 1, 2"""


def tagged_lines(spark: SparkSession, folder: str) -> DataFrame:
    ship, line = F.col("l_shipdate"), F.col("l_linenumber")
    year = F.year(ship)
    tag = (
        F.when(year >= 1999, F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "Reporting year").when(F.col("l_returnflag") == "N", "Row 1").otherwise("Row 2"))
        .when(year == 1998, (line + 1995).cast("string"))
        .otherwise(F.date_format(F.date_sub(ship.cast("date"), line * 100), "dd MMM yyyy"))
    )
    return table(spark, folder, "lineitem").select("l_suppkey", year.alias("year"), F.col("l_quantity").alias("v"), tag.alias("tag"))


def yearly_figure():
    return number(eras.era_mean(F.col("v"), F.col("tag"), F.col("year"), tagged_years=(1999, 2001), dated_years=(1995, 1997), plain_years=(1998,)))


@query("era_figures", _era_sql(""))
def era_figures(spark: SparkSession, folder: str) -> DataFrame:
    return tagged_lines(spark, folder).groupBy("l_suppkey", "year").agg(yearly_figure().alias("figure"))


@query("era_figures_distinct", _era_sql("DISTINCT "))
def era_figures_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rows = eras.distinct_first(tagged_lines(spark, folder), ["l_suppkey", "year"], ["v", "tag"])
    return rows.groupBy("l_suppkey", "year").agg(yearly_figure().alias("figure"))


UPSTREAM, DOWNSTREAM = V.SCOPE3_UPSTREAM_SEEN, V.SCOPE3_DOWNSTREAM_SEEN
CATEGORIES = (*UPSTREAM, *DOWNSTREAM, "Not a category")


def _figure_sql(value: str, stated: str, tags: tuple, dated: tuple | None, plain: bool) -> str:
    when = []
    if tags:
        when.append("WHEN year BETWEEN 2018 AND 2020 THEN coalesce(" + ", ".join(f"avg({value}) FILTER ({stated} = '{t}')" for t in tags) + ", NULL)")
    if dated:
        when.append(f"WHEN year BETWEEN {dated[0]} AND {dated[1]} THEN avg({value}) FILTER (try_cast(right({stated}, 4) AS INTEGER) = year - 1)")
    if plain:
        when.append(f"WHEN year = 2017 THEN avg({value}) FILTER (try_cast({stated} AS INTEGER) = year - 1)")
    return "CASE " + " ".join(when) + " END"


def _emission_sql() -> str:
    quoted = lambda names: ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    sums = lambda seen, summed: f"CASE WHEN year IN (2010, 2018, 2019, 2020) AND bool_or(cat IN ({quoted(seen)})) THEN coalesce(sum(s3) FILTER (cat IN ({quoted(summed)})), 0.0) END"
    both = ("Reporting year", "Row 1")
    scope2 = f"coalesce({_figure_sql('s2', 'y2', ('Row 1',), (2010, 2010), False)}, {_figure_sql('s2', 'y1', (), (2011, 2015), False)})"
    tag = lambda k: f"CASE WHEN year >= 2018 THEN ['Reporting year', 'Row 1', 'Row 2', 'Row 1'][({k}) % 4 + 1] WHEN year = 2017 THEN (2014 + ({k}) % 4)::VARCHAR ELSE '15 Jun ' || (year - 2 + ({k}) % 3) END"
    return f"""
WITH b AS (SELECT (2010 + l_orderkey % 11)::INTEGER AS year, l_suppkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem),
r AS (SELECT DISTINCT year, l_suppkey, l_quantity AS s1, {tag('l_linenumber')} AS y1, floor(l_extendedprice) AS s2, floor(l_tax * 1000) AS s2l, floor(l_discount * 1000) AS s2m, {tag('l_linenumber + l_partkey')} AS y2,
  l_quantity AS s3, [{quoted(CATEGORIES)}][l_partkey % {len(CATEGORIES)} + 1] AS cat FROM b)
SELECT year, l_suppkey, round({_figure_sql('s1', 'y1', both, (2010, 2016), True)}, 6) AS scope1, round({scope2}, 6) AS scope2,
  round({_figure_sql('s2l', 'y2', both, (2016, 2016), True)}, 6) AS scope2_loc, round({_figure_sql('s2m', 'y2', both, (2016, 2016), True)}, 6) AS scope2_market,
  round({sums(UPSTREAM, V.SCOPE3_UPSTREAM_SUMMED)}, 6) AS scope3_upstream, round({sums(DOWNSTREAM, V.SCOPE3_DOWNSTREAM_SUMMED)}, 6) AS scope3_downstream
FROM r GROUP BY year, l_suppkey"""


@query("emission_figures", _emission_sql())
def emission_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Scope 1, 2 and 3 of each supplier and survey year, in the wording of all eras and with all categories."""
    year = (F.col("l_orderkey") % 11 + 2010).cast("int")

    def tag(k):
        tags = F.array(*[F.lit(t) for t in ("Reporting year", "Row 1", "Row 2", "Row 1")])
        return (F.when(year >= 2018, F.get(tags, (k % 4).cast("int"))).when(year == 2017, (k % 4 + 2014).cast("string"))
                .otherwise(F.concat(F.lit("15 Jun "), (year - 2 + k % 3).cast("string"))))

    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("l_partkey") % len(CATEGORIES)).cast("int"))
    text = lambda c: F.col(c).cast("string")
    # Whole numbers, whose means do not depend on the order of the rows.
    whole = lambda c: F.floor(c).cast("string")
    rows = table(spark, folder, "lineitem").select(
        year.alias("year"), F.col("l_suppkey"), text("l_quantity").alias("scope1"), tag(F.col("l_linenumber")).alias("scope1_which_year"), whole(F.col("l_extendedprice")).alias("scope2"),
        whole(F.col("l_tax") * 1000).alias("scope2_loc"), whole(F.col("l_discount") * 1000).alias("scope2_market"), tag(F.col("l_linenumber") + F.col("l_partkey")).alias("scope2_which_year"),
        text("l_quantity").alias("scope3"), category.alias("scope3_which_category"))
    out = eras.emission_figures(rows, ["year", "l_suppkey"])
    return out.select("year", "l_suppkey", *[number(F.col(c)).alias(c) for c in ("scope1", "scope2", "scope2_loc", "scope2_market", "scope3_upstream", "scope3_downstream")])


@query("category_sums", """
SELECT l_orderkey, year(min(l_shipdate)) AS year,
  CASE WHEN year(min(l_shipdate)) IN (1995, 1999, 2000) AND bool_or(l_returnflag IN ('A', 'N')) THEN coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0.0) END AS upstream
FROM lineitem GROUP BY 1""")
def category_sums(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.year(F.min("l_shipdate")).alias("year"))
    rows = lines.join(first, "l_orderkey")
    total = eras.category_sum(F.col("l_quantity"), F.col("l_returnflag"), F.col("year"), ("A", "N"), ("A",), (1995, 1999, 2000))
    return rows.groupBy("l_orderkey", "year").agg(total.alias("upstream"))


@query("verification_fallback", """
WITH c AS (
  SELECT l_orderkey, l_linenumber AS k, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS s, l_linestatus || l_linenumber AS g FROM lineitem),
s AS (SELECT l_orderkey, string_agg(s, ', ' ORDER BY k, s) AS s FROM (SELECT l_orderkey, s, min(k) AS k FROM c WHERE s IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT l_orderkey, string_agg(g, ', ' ORDER BY k, g) AS g FROM (SELECT l_orderkey, g, min(k) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT l_orderkey, coalesce(s, g) AS specific FROM g LEFT JOIN s USING (l_orderkey)""")
def verification_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("specific"),
        F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("general"),
    )
    return eras.with_fallback(rows, ["l_orderkey"], {"specific": "general"}, ["l_linenumber"])


@query("id_conflicts", """
SELECT l_partkey, count(*) AS n_ids, string_agg(s, ', ' ORDER BY s) AS ids
FROM (SELECT DISTINCT l_partkey, l_suppkey::VARCHAR AS s FROM lineitem) GROUP BY 1 HAVING count(*) >= 2""")
def id_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return condense.list_conflicts(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")


@query("theme_counts", """
WITH items AS (SELECT trim(unnest(string_split(p_type || ': ' || p_name || ', ' || p_brand || ',Size:  ' || p_size, ','))) AS item FROM part)
SELECT regexp_replace(lower(regexp_replace(item, ':.*', '')), '[^a-z0-9 ]', '', 'g') || ': ' ||
       regexp_replace(lower(regexp_replace(item, '.*:\\s*', '')), '[^a-z0-9 ]', '', 'g') AS theme, count(*) AS n
FROM items WHERE contains(item, ':') GROUP BY 1""".replace("\\\\", "\\"))
def theme_counts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("p_type", F.lit(": "), "p_name", F.lit(", "), "p_brand", F.lit(",Size:  "), F.col("p_size").cast("string"))
    return condense.theme_counts(table(spark, folder, "part").select(text.alias("t")), "t")


@query("value_order", """
SELECT p_type AS "column", p_name AS value, min(p_partkey) AS position FROM part GROUP BY 1, 2""")
def value_order(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy(F.col("p_type").alias("column"), F.col("p_name").alias("value")).agg(F.min("p_partkey").alias("position"))


@query("top_and_bottom", """
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT l_suppkey, q, 'top' AS "end" FROM s ORDER BY q DESC, l_suppkey DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT l_suppkey, q, 'bottom' FROM s ORDER BY q, l_suppkey LIMIT 5)""")
def top_and_bottom(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return condense.top_and_bottom(totals, [F.col("q"), F.col("l_suppkey")], 5)


@query("numbered_names", """
WITH n AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '_' || k END AS unique_name FROM n""")
def numbered_names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    return C.make_unique(part, "p_name", ["p_brand"], "p_partkey", "unique_name").select("p_partkey", "unique_name")


@query("mixed_layouts", """
SELECT 'csv' AS kind, c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT 'parquet', c_custkey::VARCHAR, CASE WHEN c_nationkey % 2 = 0 THEN c_name END, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment END FROM customer""")
def mixed_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Two layouts of one table, written to the shared folder and read back by column name."""
    customer, base = table(spark, folder, "customer"), f"{checkpoint_dir(spark)}/layouts-{uuid.uuid4().hex}"
    layouts = [customer.filter("c_nationkey % 2 = 0").select("c_name", "c_custkey"), customer.filter("c_nationkey % 2 = 1").select("c_custkey", "c_mktsegment")]
    for i, part in enumerate(layouts):
        files.write_csv(part, f"{base}/csv/{i}")
        files.write_parquet(part, f"{base}/parquet/{i}")
    read = {"csv": files.read_csv_by_name(spark, f"{base}/csv/*"), "parquet": files.read_parquet(spark, f"{base}/parquet/*")}
    parts = [df.select(F.lit(kind).alias("kind"), F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment") for kind, df in read.items()]
    return parts[0].unionByName(parts[1])


# -- typed wide table, pruned reads, sections ---------------------------------------------
ANSWER_ROWS = """
WITH a AS (SELECT o_custkey AS key, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice, o_orderstatus, o_orderpriority FROM orders),
r AS (
  SELECT key, 'amount' AS col, pos, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice::VARCHAR END AS value FROM a
  UNION ALL SELECT key, 'status', pos, o_orderstatus FROM a
  UNION ALL SELECT key, 'first_amount', 0, o_totalprice::VARCHAR FROM a WHERE pos = 0
  UNION ALL SELECT key, 'first_priority', 0, o_orderpriority FROM a WHERE pos = 0 AND o_orderkey % 5 > 0
  UNION ALL SELECT key, 'sometimes', pos, CASE WHEN o_orderkey % 97 = 0 THEN 'n/a' ELSE (o_orderkey % 10)::VARCHAR END FROM a WHERE o_orderkey % 2 = 0),
f AS (SELECT col, max(n) = 1 AS is_scalar, sum(v) = sum(num) AS is_numeric FROM (
  SELECT col, key, count(*) AS n, count(value) AS v, count(try_cast(value AS DOUBLE)) AS num FROM r GROUP BY 1, 2) GROUP BY 1)
"""


def answer_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a customer in long form: lists and single ones, numbers, texts, and numbers with a text among them."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", (F.row_number().over(w) - 1).alias("pos"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    entry = lambda name, value, there=F.lit(True): F.when(there, F.struct(F.lit(name).alias("column"), value.alias("value")))
    first = F.col("pos") == 0
    cells = F.array_compact(F.array(
        entry("amount", F.when(k % 11 > 0, F.col("o_totalprice").cast("string"))), entry("status", F.col("o_orderstatus")),
        entry("first_amount", F.col("o_totalprice").cast("string"), first), entry("first_priority", F.col("o_orderpriority"), first & (k % 5 > 0)),
        entry("sometimes", F.when(k % 97 == 0, F.lit("n/a")).otherwise((k % 10).cast("string")), k % 2 == 0),
    ))
    return a.select("key", "pos", F.explode(cells).alias("c")).select("key", "c.column", "pos", "c.value")


@query("typed_metrics", ANSWER_ROWS + """
SELECT key, list(try_cast(value AS DOUBLE) ORDER BY pos) FILTER (col = 'amount') AS amount, max(try_cast(value AS DOUBLE)) FILTER (col = 'first_amount') AS first_amount,
  max(value) FILTER (col = 'first_priority') AS first_priority, list(value ORDER BY pos) FILTER (col = 'sometimes') AS sometimes, list(value ORDER BY pos) FILTER (col = 'status') AS status
FROM r GROUP BY 1""")
def typed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table, each column a list or a single value, numbers or texts, as its values allow."""
    return responses.typed_table(answer_rows(spark, folder), ["key"])[0]


@query("typed_schema", ANSWER_ROWS + """
SELECT col AS "column", CASE WHEN is_scalar THEN '' ELSE 'array<' END || CASE WHEN is_numeric THEN 'double' ELSE 'string' END || CASE WHEN is_scalar THEN '' ELSE '>' END AS type FROM f""")
def typed_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The types that the wide table was given."""
    wide, _ = responses.typed_table(answer_rows(spark, folder), ["key"])
    return literal_frame(spark, [(f.name, f.dataType.simpleString()) for f in wide.schema if f.name != "key"], "column string, type string")


@query("pruned_read", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'investor' ELSE 'supply_chain' END AS label, year(o_orderdate)::INTEGER AS year, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2""")
def pruned_read(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written by label and year; of the files only those of one label and two years are read."""
    path = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    label = F.when(F.col("o_orderstatus") == "F", "investor").otherwise("supply_chain")
    files.write_workbooks(table(spark, folder, "orders").select("o_orderkey", label.alias("label"), F.year("o_orderdate").alias("year")), path)
    return files.read_workbooks(spark, path, ["investor"], [1996, 1997]).groupBy("label", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
