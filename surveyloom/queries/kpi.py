"""Indicator table: label counts, text fill, metrics, column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators import indicators, profile, responses
from surveyloom.queries.registry import number, query, table

PAIRS = (("quality", "yes"), ("quality", "no"), ("toxic", "yes"), ("toxic", "no"))


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label cell per document and model: source as year, language as respondent."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels")
    text = lambda c: F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no")
    entries = F.array(*[F.struct(F.lit(m).alias("model"), text(m).alias("label")) for m in ("quality", "toxic")])
    return docs.join(labels, "doc_id", "left").select("source", "lang", "doc_id", F.explode(entries).alias("e")).select(
        "source", "lang", "doc_id", "e.model", "e.label"
    )


def _label_counts(spark: SparkSession, folder: str, null_as_text: bool) -> DataFrame:
    labels = document_labels(spark, folder)
    out = indicators.label_counts(labels, ["source", "lang"], None, "source", PAIRS, null_as_text, {})
    means = [c for c in out.columns if c.endswith("_mean")]
    return out.select(*[c for c in out.columns if c not in means], *[number(F.col(c)).alias(c) for c in means])


def _label_sql(null_hit: int) -> str:
    sums = ", ".join(
        f"sum(CASE WHEN model = '{m}' THEN CASE WHEN label IS NULL THEN {null_hit if lb == 'no' else 0} "
        f"WHEN contains(lower(label), '{lb}') THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS {m}_label_{lb}_sum"
        for m, lb in PAIRS
    )
    means = ", ".join(f"round({m}_label_{lb}_sum / CASE WHEN maxcol = 0 THEN 1 ELSE maxcol END, 6) AS {m}_label_{lb}_mean" for m, lb in PAIRS)
    return f"""
WITH cells AS (
  SELECT source, lang, d.doc_id, m.model,
         CASE m.model WHEN 'quality' THEN CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END
                      ELSE CASE toxic WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('quality'), ('toxic')) m(model)),
filled AS (SELECT source, lang, count(label) AS n FROM cells GROUP BY 1, 2),
cap AS (SELECT source, max(n)::BIGINT AS maxcol FROM filled GROUP BY 1),
counted AS (SELECT source, lang, {sums} FROM cells GROUP BY 1, 2)
SELECT c.*, maxcol, {means} FROM counted c JOIN cap USING (source)"""


@query("kpi_label_counts", _label_sql(0))
def kpi_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _label_counts(spark, folder, False)


@query("kpi_label_counts_null_text", _label_sql(1))
def kpi_label_counts_null_text(spark: SparkSession, folder: str) -> DataFrame:
    return _label_counts(spark, folder, True)


def _indicator_sql() -> str:
    pairs = list(enumerate(V.KPI_LABELS))
    cases = lambda k: " ".join(f"WHEN {i} THEN '{p[k]}'" for i, p in pairs)
    sums = ", ".join(f"sum(CASE WHEN model = '{m}' AND contains(lower(label), '{lb.lower()}') THEN 1 ELSE 0 END)::BIGINT AS \"{m}_label_{lb}_sum\"" for _, (m, lb) in pairs)
    means = ", ".join(f"round(\"{m}_label_{lb}_sum\" / CASE WHEN maxcol = 0 THEN 1 ELSE maxcol END, 6) AS \"{V.KPI_MEAN_NAMES.get((m, lb), f'{m}_label_{lb}_mean')}\"" for _, (m, lb) in pairs)
    return f"""
WITH e AS (
  SELECT user_id AS account, 2010 + user_id % 11 AS year, CASE event_type WHEN 'click' THEN 'Investor' WHEN 'view' THEN 'investor, supply chain' ELSE 'supply chain' END AS respondent,
    hour(ts) AS question, value >= 20 AS answered, event_id // 3 % {len(pairs) + 1} AS k FROM events),
l AS (SELECT *, CASE k {cases(0)} ELSE '{V.KPI_LABELS[0][0]}' END AS model, CASE k {cases(1)} END AS label FROM e WHERE contains(lower(respondent), 'investor')),
q AS (SELECT account, year, respondent, question, count(*) FILTER (answered) AS n FROM l GROUP BY 1, 2, 3, 4),
f AS (SELECT account, year, respondent, count(*) FILTER (n >= 1) AS filled FROM q GROUP BY 1, 2, 3),
cap AS (SELECT year, max(filled)::BIGINT AS maxcol FROM f GROUP BY 1),
c AS (SELECT account, year, respondent, {sums} FROM l GROUP BY 1, 2, 3)
SELECT account, c.year, respondent, maxcol, c.* EXCLUDE (account, year, respondent), {means} FROM c JOIN cap USING (year)"""


@query("kpi_indicator_table", _indicator_sql())
def kpi_indicator_table(spark: SparkSession, folder: str) -> DataFrame:
    """All 20 label counts over the models; the divisor counts questions with an answer, whatever their labels."""
    k = F.floor(F.col("event_id") / 3) % (len(V.KPI_LABELS) + 1)
    pick = lambda part: F.get(F.array(*[F.lit(p[part]) for p in V.KPI_LABELS]), k.cast("int"))
    kind = F.col("event_type")
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("account"), (F.col("user_id") % 11 + 2010).alias("year"),
        F.when(kind == "click", "Investor").when(kind == "view", "investor, supply chain").otherwise("supply chain").alias("respondent"),
        F.hour("ts").alias("question"), (F.col("value") >= 20).cast("int").alias("answered"),
        F.coalesce(pick(0), F.lit(V.KPI_LABELS[0][0])).alias("model"), pick(1).alias("label"),
    )
    rows = indicators.of_respondents(rows, "investor")
    keys = ["account", "year", "respondent"]
    answers = rows.groupBy(*keys, "question").agg(F.sum("answered").alias("n_responses"))
    out = indicators.label_counts(rows, keys, indicators.max_answered(answers, "year", ["account", "respondent"]), "year")
    counted = [*keys, "maxcol", *[c for c in out.columns if c.endswith("_sum")]]
    return out.select(*counted, *[number(F.col(f"`{c}`")).alias(c) for c in out.columns if c not in counted])


@query("kpi_text_fill", r"""
WITH cells AS (
  SELECT role, conv_id, length(regexp_replace(replace(replace(replace(regexp_replace(text, '[\[\]'']', '', 'g'),
         'Question not applicable', ''), 'Hidden Answer', ''), 'None', ''),
         '[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS n
  FROM conversations),
counted AS (SELECT role, conv_id, sum(n)::BIGINT AS nchar_sum, sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END)::BIGINT AS filled FROM cells GROUP BY 1, 2),
cap AS (SELECT role, max(filled) AS maxcol FROM counted GROUP BY 1)
SELECT role, conv_id, maxcol, nchar_sum, round(filled / CASE WHEN maxcol = 0 THEN 1 ELSE maxcol END, 6) AS prop_filled
FROM counted JOIN cap USING (role)""")
def kpi_text_fill(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "conversations").select("role", "conv_id", "text")
    out = indicators.text_fill(answers, ["role", "conv_id"], "text", None, "role")
    return out.withColumn("prop_filled", number(F.col("prop_filled")))


@query("max_answered", """
WITH f AS (SELECT role, conv_id, count(text) FILTER (length(text) > 0) AS n FROM conversations GROUP BY 1, 2)
SELECT role, max(n) AS maxcol FROM f GROUP BY 1""")
def max_answered(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "conversations").select("role", "conv_id", (F.length("text") > 0).cast("int").alias("n_responses"))
    return indicators.max_answered(answers, "role", ["conv_id"])


@query("question_metrics", """
SELECT conv_id, role, round(avg(CASE WHEN contains(text, ',') THEN 1.0 ELSE 0.0 END), 6) AS score_average,
       sum(length(text))::BIGINT AS number_characters, count(text) AS number_responses
FROM conversations GROUP BY 1, 2""")
def question_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("score", F.contains("text", F.lit(",")).cast("double"))
    out = indicators.question_metrics(rows, ["conv_id", "role"], "text", "score")
    return out.withColumn("score_average", number(F.col("score_average")))


def profiled_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    part = table(spark, folder, "part").select(F.col("p_size").alias("year"), "p_name", "p_brand", "p_type")
    docs = table(spark, folder, "documents").select(F.length("source").alias("year"), "lang", "source", "text")
    talk = table(spark, folder, "conversations").select(F.col("turn").cast("int").alias("year"), F.col("role"), F.col("text").alias("turn_text"))
    out = responses.unpivot(orders, ["year"])
    for df in (part, docs, talk):
        out = out.unionByName(responses.unpivot(df, ["year"]))
    return out.drop("col_pos")


PROFILE_SQL = r"""
WITH cells AS (
  SELECT year(o_orderdate) AS y, unnest(['o_orderstatus', 'o_orderpriority']) AS col, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders
  UNION ALL SELECT p_size, unnest(['p_name', 'p_brand', 'p_type']), unnest([p_name, p_brand, p_type]) FROM part
  UNION ALL SELECT length(source), unnest(['lang', 'source', 'text']), unnest([lang, source, text]) FROM documents
  UNION ALL SELECT turn, unnest(['role', 'turn_text']), unnest([role, text]) FROM conversations),
per_year AS (SELECT col, avg(u) AS mean_unique_per_year FROM (SELECT col, y, count(DISTINCT value) AS u FROM cells GROUP BY 1, 2) GROUP BY 1),
marks AS (SELECT col, string_agg(mark, '' ORDER BY mark) AS punctuation
          FROM (SELECT DISTINCT col, unnest(regexp_extract_all(value, '\pP')) AS mark FROM cells) GROUP BY 1),
basics AS (
  SELECT col, count(*) AS n_values, count(DISTINCT value) AS n_unique, avg(length(value)) AS avg_length,
         min(length(value)) AS min_length, max(length(value)) AS max_length,
         sum(CASE WHEN regexp_matches(value, '^Other:\s') THEN 1 WHEN regexp_matches(value, '^Other,\s') THEN 1 ELSE 0 END)::BIGINT AS n_other
  FROM cells GROUP BY 1),
profile AS (SELECT b.*, mean_unique_per_year, coalesce(punctuation, '') AS punctuation, n_unique / n_values AS share_unique
            FROM basics b JOIN per_year USING (col) LEFT JOIN marks USING (col))
"""


@query("column_profile", PROFILE_SQL + """
SELECT col AS "column", n_values, n_unique, round(mean_unique_per_year, 6) AS mean_unique_per_year, round(share_unique, 6) AS share_unique,
       round(avg_length, 6) AS avg_length, min_length, max_length, n_other, punctuation FROM profile""")
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    p = profile.column_profile(profiled_columns(spark, folder))
    return p.select(
        "column", "n_values", "n_unique", number(F.col("mean_unique_per_year")).alias("mean_unique_per_year"),
        number(F.col("share_unique")).alias("share_unique"), number(F.col("avg_length")).alias("avg_length"),
        F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"),
        "n_other", F.array_join("punctuation", "").alias("punctuation"),
    )


@query("free_text_columns", PROFILE_SQL + """
SELECT col AS "column", round(avg_length, 6) AS avg_length FROM profile
WHERE n_other > 0 OR (contains(punctuation, '.') AND contains(punctuation, ',') AND avg_length > 20
  AND mean_unique_per_year > 1 AND max_length > 30)""")
def free_text_columns(spark: SparkSession, folder: str) -> DataFrame:
    p = profile.free_text_columns(profile.column_profile(profiled_columns(spark, folder)))
    return p.select("column", number(F.col("avg_length")).alias("avg_length"))


@query("value_samples", """
WITH cells AS (
  SELECT unnest(['p_name', 'p_brand', 'p_type']) AS col, unnest([p_name, p_brand, p_type]) AS value FROM part
  UNION ALL SELECT unnest(['o_orderstatus', 'o_orderpriority']), unnest([o_orderstatus, o_orderpriority]) FROM orders),
counts AS (SELECT col, value, count(*) AS n FROM cells GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS t,
                  row_number() OVER (PARTITION BY col ORDER BY n, value DESC) AS b FROM counts)
SELECT col AS "column", 'top' AS "end", t AS rank, n || '|' || value AS sample FROM ranked WHERE t <= 3
UNION ALL SELECT col, 'bottom', b, n || '|' || value FROM ranked WHERE b <= 3""")
def value_samples(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_name", "p_brand", "p_type")
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")
    long = responses.unpivot(part, []).unionByName(responses.unpivot(orders, []))
    return profile.value_samples(long).withColumn("rank", F.col("rank").cast("long"))


@query("auto_types", """
WITH cells AS (
  SELECT o_custkey AS k, unnest(['o_orderkey', 'o_totalprice', 'o_orderstatus']) AS col,
         unnest([o_orderkey::VARCHAR, o_totalprice::VARCHAR, o_orderstatus]) AS value FROM orders
  UNION ALL SELECT c_custkey, unnest(['c_name', 'c_nationkey']), unnest([c_name, c_nationkey::VARCHAR]) FROM customer),
per_cell AS (SELECT col, k, count(*) AS n, count(value) AS v, count(try_cast(value AS DOUBLE)) AS num FROM cells GROUP BY 1, 2)
SELECT col AS "column", max(n) = 1 AS is_scalar, sum(v) = sum(num) AS is_numeric, sum(v)::BIGINT AS n_values FROM per_cell GROUP BY 1""")
def auto_types(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice", "o_orderstatus")
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    return responses.auto_types(responses.unpivot(orders, ["key"]).unionByName(responses.unpivot(customer, ["key"])))


@query("clean_cells", r"""
SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS cleaned_md5,
       lower(lang) IN ('question not applicable', 'hidden answer', 'none') AS placeholder,
       trim(regexp_replace(regexp_replace(regexp_replace('NA, ' || source || ', NA', 'NA, ', 'Not Answered, ', 'g'), ', NA', ', Not Answered', 'g'), '^, |, $', '', 'g')) AS source_list
FROM documents""")
def clean_cells(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cleaned = F.element_at(cells.clean_elements(F.array("text")), 1)
    return docs.select(
        "doc_id", F.md5(cleaned).alias("cleaned_md5"), cells.is_placeholder(F.col("lang")).alias("placeholder"),
        cells.clean_na(F.concat(F.lit("NA, "), "source", F.lit(", NA"))).alias("source_list"),
    )
