"""Company names and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators import resolve
from surveyloom.queries.registry import number, query, table


def _clean_sql(expr: str, rules: tuple) -> str:
    out = f"upper({expr})"
    for pattern, replacement in rules:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), replacement)
    return out


RAW = """p_name || CASE p_size % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Corporation (' || p_type || ')' WHEN 2 THEN ' Co., Limited' WHEN 3 THEN '-Int''l PLC' WHEN 4 THEN ' + Sons, S.A.' ELSE ' Income Trust Ltd.' END"""


@query("clean_names", f"""
WITH r AS (SELECT p_partkey, {RAW} AS raw FROM part)
SELECT p_partkey, {_clean_sql('raw', V.NAME_RULES)} AS cleaned, trim({_clean_sql('raw', V.NAME_RULES_WHOLE_WORD)}) AS cleaned_words,
       regexp_replace(lower(raw), '[^a-z]', '', 'g') AS letters FROM r""")
def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.expr(RAW.replace("''", "\\'"))
    rows = table(spark, folder, "part").select("p_partkey", raw.alias("raw"))
    name = F.col("raw")
    return rows.select(
        "p_partkey", cells.clean_company_name(name).alias("cleaned"), cells.clean_company_name(name, whole_words=True).alias("cleaned_words"),
        cells.letters_only(name).alias("letters"),
    )


POOL = "upper(p_name || ' ' || p_type || ' ' || p_brand) || CASE WHEN p_size % 3 = 0 THEN ' LTD' WHEN p_size % 3 = 1 THEN ' HOLDING COMPANY' ELSE '' END"
SEARCH = "upper(p_name || ' ' || p_type || ' ' || p_brand) || CASE WHEN p_size % 4 = 0 THEN ' LT' WHEN p_size % 4 = 1 THEN ' CORP' ELSE '' END"

MATCH_SQL = f"""
WITH s AS (SELECT {SEARCH} AS name FROM part UNION SELECT upper(substr(p_name, 1, 2 + p_partkey % 2)) FROM part),
p AS (SELECT {POOL} AS match, min(p_partkey) AS o FROM part GROUP BY 1),
c AS (SELECT name, match, o FROM s, p WHERE contains(match, substr(name, 1, length(name) // 5 * 4 + (length(name) % 5 * 4) // 5)))
"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Names to look for, among them some of two and three letters, and the pool."""
    part = table(spark, folder, "part")
    short = F.expr("upper(substr(p_name, 1, 2 + cast(p_partkey % 2 as int)))")
    names = part.select(F.expr(SEARCH).alias("name")).union(part.select(short)).distinct()
    return names, part.select(F.expr(POOL).alias("match"), F.col("p_partkey").alias("pool_order"))


@query("fuzzy_match", MATCH_SQL + """
, e AS (SELECT name, min_by(match, o) AS match FROM c WHERE length(name) = length(match) GROUP BY 1),
r AS (SELECT name, match, o, sqrt(jaro_similarity(match, name) ** 2 + 4 * jaro_similarity(substr(match, 1, length(name)), name) ** 2
        + (1 / abs(length(match) - length(name))) ** 2) AS score FROM c WHERE name NOT IN (SELECT name FROM e))
SELECT name, match FROM e UNION ALL SELECT name, max_by(match, (round(score, 9), -o)) FROM r GROUP BY 1""")
def fuzzy_match(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.best_name_match(*_sides(spark, folder))


@query("fuzzy_match_finite", MATCH_SQL + """
, r AS (SELECT name, match, o, sqrt(jaro_similarity(match, name) ** 2 + 4 * jaro_similarity(substr(match, 1, length(name)), name) ** 2
        + (1 / (1 + abs(length(match) - length(name)))) ** 2) AS score FROM c)
SELECT name, max_by(match, (round(score, 9), -o)) AS match FROM r GROUP BY 1""")
def fuzzy_match_finite(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.best_name_match(*_sides(spark, folder), finite_length=True)


@query("accept_matches", f"""
WITH m AS (SELECT p_partkey, {SEARCH} AS name, {POOL} AS match FROM part),
x AS (SELECT *, jaro_similarity(name, match) AS a, jaro_similarity(name, substr(match, 1, length(name))) AS b,
             jaro_similarity(match, substr(name, 1, length(match))) AS c, name LIKE 'RED%' AS keep FROM m)
SELECT p_partkey, round(a, 6) AS sim_whole, round(b, 6) AS sim_match_prefix, round(c, 6) AS sim_name_prefix,
       CASE WHEN a >= 1 OR b >= 1 OR c >= 1 OR keep THEN 1 ELSE 0 END AS include FROM x""")
def accept_matches(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    rows = part.select("p_partkey", F.expr(SEARCH).alias("name"), F.expr(POOL).alias("match"))
    out = resolve.accept_matches(rows, rows.filter("name like 'RED%'").select("name"))
    return out.select("p_partkey", *[number(F.col(c)).alias(c) for c in ("sim_whole", "sim_match_prefix", "sim_name_prefix")], "include")


@query("resolve_entities", f"""
WITH acc AS (
  SELECT p_partkey AS account, CASE WHEN p_size > 25 THEN 'ID' || (p_partkey // 2) END AS isin,
    CASE WHEN p_partkey % 50 = 0 THEN upper(substr(p_name, 1, 2 + p_partkey // 50 % 2)) ELSE {SEARCH} END AS name FROM part),
ref AS (SELECT p_partkey AS ref_id, CASE WHEN p_size > 15 THEN 'ID' || p_partkey END AS isin, {POOL} AS name FROM part),
i AS (SELECT isin, min(ref_id) AS ref_id FROM ref WHERE isin IS NOT NULL GROUP BY 1),
x AS (SELECT account, name, ref_id FROM acc LEFT JOIN i USING (isin)),
rest AS (SELECT account, name FROM x WHERE ref_id IS NULL),
s AS (SELECT DISTINCT name FROM rest),
p AS (SELECT name AS match, min(ref_id) AS o FROM ref GROUP BY 1),
c AS (SELECT name, match, o FROM s, p WHERE contains(match, substr(name, 1, length(name) // 5 * 4 + (length(name) % 5 * 4) // 5))),
e AS (SELECT name, min_by(match, o) AS match FROM c WHERE length(name) = length(match) GROUP BY 1),
r AS (SELECT name, match, o, sqrt(jaro_similarity(match, name) ** 2 + 4 * jaro_similarity(substr(match, 1, length(name)), name) ** 2
        + (1 / abs(length(match) - length(name))) ** 2) AS score FROM c WHERE name NOT IN (SELECT name FROM e)),
b AS (SELECT name, match FROM e UNION ALL SELECT name, max_by(match, (round(score, 9), -o)) FROM r GROUP BY 1),
ok AS (SELECT * FROM b WHERE jaro_similarity(name, match) >= 1 OR jaro_similarity(name, substr(match, 1, length(name))) >= 1
                         OR jaro_similarity(match, substr(name, 1, length(match))) >= 1)
SELECT account, name, ref_id, 'isin' AS how FROM x WHERE ref_id IS NOT NULL
UNION ALL SELECT account, rest.name, o, 'name' FROM rest JOIN ok USING (name) JOIN p USING (match)""")
def resolve_entities(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    accounts = part.select(
        F.col("p_partkey").alias("account"), F.when(F.col("p_size") > 25, F.concat(F.lit("ID"), F.floor(F.col("p_partkey") / 2).cast("string"))).alias("isin"),
        F.expr(f"CASE WHEN p_partkey % 50 = 0 THEN upper(substr(p_name, 1, 2 + cast(p_partkey div 50 % 2 as int))) ELSE {SEARCH} END").alias("name"),
    )
    reference = part.select(
        F.col("p_partkey").alias("ref_id"), F.when(F.col("p_size") > 15, F.concat(F.lit("ID"), F.col("p_partkey").cast("string"))).alias("isin"), F.expr(POOL).alias("name"), F.col("p_partkey").alias("order")
    )
    return resolve.resolve_entities(accounts, reference)
