"""Distinct texts, languages, translation, classification, stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.operators import bayes, textwork
from surveyloom.queries.registry import number, query, table
from surveyloom.session import checkpoint_dir

VOCABULARY = {"length": ("long", "short")}


def load_length_scorer():
    """Stand-in for a model: share of 1,000 characters, capped at one."""
    def score(texts: list[str]) -> list[dict[str, float]]:
        shares = [min(len(t) / 1000.0, 1.0) for t in texts]
        return [{"long": s, "short": 1.0 - s} for s in shares]
    return score


def load_marking_translator():
    """Stand-in for a translation model: marks the source language."""
    return lambda texts, langs: [f"[{lang}] {t}" for t, lang in zip(texts, langs)]


@query("distinct_texts", "SELECT sha256(text) AS text_key, length(any_value(text)) AS n_chars FROM documents WHERE length(text) > 0 GROUP BY 1")
def distinct_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = textwork.distinct_texts(table(spark, folder, "documents"), "text")
    return texts.select("text_key", F.length("text").cast("long").alias("n_chars"))


def earlier_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of an earlier run: the labelled documents."""
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    quality = F.max("quality").cast("double")
    scores = F.create_map(F.lit("long"), F.col("q"), F.lit("short"), 1 - F.col("q"))
    return labelled.groupBy(F.sha2("text", 256).alias("text_key")).agg(quality.alias("q")).select(
        "text_key", F.lit("length").alias("model"), F.when(F.col("q") >= 0.5, "long").otherwise("short").alias("label"), scores.alias("scores")
    )


@query("incremental_scoring", """
WITH t AS (SELECT sha256(text) AS text_key, length(any_value(text)) AS n FROM documents WHERE length(text) > 0 GROUP BY 1),
s AS (SELECT sha256(text) AS text_key, max(quality)::DOUBLE AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT text_key, 'length' AS model, CASE WHEN coalesce(q, least(n / 1000, 1.0)) >= 0.5 THEN 'long' ELSE 'short' END AS label,
  round(coalesce(q, least(n / 1000, 1.0)), 6) AS long_score FROM t LEFT JOIN s USING (text_key)""")
def incremental_scoring(spark: SparkSession, folder: str) -> DataFrame:
    results = textwork.classify(table(spark, folder, "documents"), "text", {"length": load_length_scorer}, earlier_results(spark, folder))
    return results.select("text_key", "model", "label", number(F.try_element_at("scores", F.lit("long"))).alias("long_score"))


@query("classified_answers", """
SELECT conv_id, turn, CASE WHEN length(text) >= 500 THEN 'long' ELSE 'short' END AS label, round(least(length(text) / 1000, 1.0), 6) AS "length|long",
  round(1.0 - least(length(text) / 1000, 1.0), 6) AS "length|short" FROM conversations WHERE length(text) > 0
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL FROM conversations WHERE length(text) = 0 OR text IS NULL""")
def classified_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    results = textwork.classify(rows, "text", {"length": load_length_scorer})
    out = textwork.attach_results(rows, "text", results)
    made = textwork.score_columns(out, VOCABULARY)
    names = [f"{m}|{lb}" for m, labels in VOCABULARY.items() for lb in labels]
    return out.select("conv_id", "turn", "label", *[number(c).alias(n) for c, n in zip(made, names)])


@query("unknown_labels", """
SELECT 'length' AS model, 'long' AS label, count(*) AS n FROM (
  SELECT sha256(text) AS k, length(any_value(text)) AS n FROM documents WHERE length(text) > 0 GROUP BY 1) WHERE n >= 500 HAVING count(*) > 0""")
def unknown_labels(spark: SparkSession, folder: str) -> DataFrame:
    results = textwork.classify(table(spark, folder, "documents"), "text", {"length": load_length_scorer})
    return textwork.check_labels(results, {"length": ("short",)})


DETECT_SQL = """
WITH d AS (SELECT doc_id, text, lang, lower(replace(text, chr(10), ' ')) AS head FROM documents),
g AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(range(1, greatest(length(head) - 1, 1)), lambda i: substr(head, i, 3)))) AS gram FROM d WHERE length(head) >= 3),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM c GROUP BY 1),
p AS (SELECT lang, gram, ln((n + 1) / (total + kinds)) AS logp FROM c JOIN t USING (lang)),
x AS (SELECT sha256(text) AS text_key, any_value(text) AS text, any_value(doc_id) AS doc_id FROM d WHERE length(text) > 0 GROUP BY 1),
s AS (SELECT x.text_key, t.lang, sum(coalesce(p.logp, ln(1.0 / (total + kinds)))) AS score, bool_or(p.logp IS NOT NULL) AS known
      FROM x JOIN g ON g.doc_id = x.doc_id CROSS JOIN t LEFT JOIN p ON p.lang = t.lang AND p.gram = g.gram GROUP BY 1, 2),
b AS (SELECT text_key, max_by(lang, (round(score, 9), lang)) AS lang FROM s WHERE known GROUP BY 1),
found AS (SELECT text_key, text, coalesce(b.lang, 'en') AS lang FROM x LEFT JOIN b USING (text_key))
"""


@query("detect_language", DETECT_SQL + "SELECT text_key, lang FROM found")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profile = textwork.language_profile(docs, "text", "lang")
    return textwork.detect_languages(textwork.distinct_texts(docs, "text"), profile)


@query("translate_texts", DETECT_SQL + """
SELECT d.doc_id, f.lang, md5(CASE WHEN f.lang = 'en' THEN d.text ELSE '[' || f.lang || '] ' || d.text END) AS text_md5
FROM documents d JOIN found f ON sha256(d.text) = f.text_key""")
def translate_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter(F.length("text") > 0)
    profile = textwork.language_profile(docs, "text", "lang")
    translated = textwork.translate(docs, "text", load_marking_translator, profile)
    out = textwork.translate_column(docs.select("doc_id", "text"), "text", translated, extend=False)
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"))


# What each model learns from: labels made of what the tables say about a document.
MODEL_SOURCES = {
    "climate_specificity": "CASE quality WHEN 1 THEN 'spec' ELSE 'non' END",
    "environmental_claims": "CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END",
    "transition": "CASE lang WHEN 'en' THEN 'LABEL_0' WHEN 'fr' THEN 'LABEL_1' ELSE 'LABEL_2' END",
    "climate_commitment": "CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' ELSE 'no' END",
    "tcfd": "CASE doc_id % 5 WHEN 0 THEN 'strategy' WHEN 1 THEN 'governance' WHEN 2 THEN 'risk' WHEN 3 THEN 'metrics' ELSE 'none' END",
    "climate_sentiment": "CASE lang WHEN 'de' THEN 'neutral' WHEN 'es' THEN 'risk' ELSE 'opportunity' END",
    "netzero_reduction": "CASE WHEN toxic = 1 THEN 'net-zero' WHEN quality = 1 THEN 'reduction' ELSE 'none' END",
    "renewable": "CASE WHEN lang IN ('es', 'fr') THEN 'LABEL_1' ELSE 'LABEL_0' END",
}


def label_model(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(V.MODEL_LABELS)) -> bayes.CountModel:
    """All eight models, or some of them, from the labelled documents."""
    known = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return bayes.fit(known.select("text", *[F.expr(MODEL_SOURCES[m]).alias(m) for m in names]), "text", {m: V.MODEL_LABELS[m] for m in names})


def bayes_sql(texts: str) -> str:
    """Probabilities ``q(text_key, model, label, p)`` for the distinct texts of a table."""
    long = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, {e} AS label FROM known" for m, e in MODEL_SOURCES.items())
    return f"""
WITH known AS (SELECT d.doc_id, text, lang, quality, toxic FROM documents d JOIN labels USING (doc_id)),
tr AS ({long}),
kt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM known),
c AS (SELECT model, label, token, count(*) AS c FROM tr JOIN kt USING (doc_id) GROUP BY ALL),
tot AS (SELECT model, label, sum(c) AS total FROM c GROUP BY ALL),
v AS (SELECT model, count(DISTINCT token) AS v FROM c GROUP BY 1),
pr AS (SELECT model, label, ln(n / sum(n) OVER (PARTITION BY model)) AS prior FROM (SELECT model, label, count(*) AS n FROM tr GROUP BY 1, 2)),
x AS (SELECT sha256(text) AS text_key, any_value(text) AS text FROM {texts} WHERE length(text) > 0 GROUP BY 1),
xt AS (SELECT text_key, token, count(*) AS n FROM (SELECT text_key, unnest(regexp_extract_all(lower(text), '\\w+')) AS token FROM x) GROUP BY ALL),
kn AS (SELECT text_key, model, sum(n) AS n FROM xt JOIN (SELECT DISTINCT model, token FROM c) USING (token) GROUP BY ALL),
s AS (SELECT text_key, model, label, sum(n * ln(c + 1)) AS s FROM xt JOIN c USING (token) GROUP BY ALL),
f AS (SELECT x.text_key, pr.model, pr.label, prior + coalesce(s, 0) - coalesce(kn.n, 0) * ln(total + v) AS score
  FROM x CROSS JOIN pr JOIN tot USING (model, label) JOIN v USING (model) LEFT JOIN s ON s.text_key = x.text_key AND s.model = pr.model AND s.label = pr.label
  LEFT JOIN kn ON kn.text_key = x.text_key AND kn.model = pr.model),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY text_key, model)) AS e FROM f),
q AS (SELECT text_key, model, label, e / sum(e) OVER (PARTITION BY text_key, model) AS p FROM e)
"""


@query("classify_docs", bayes_sql("documents") + "SELECT text_key, model, label, round(p, 6) AS score FROM q")
def classify_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every label of the eight models for each distinct document text."""
    scored = bayes.label_scores(textwork.distinct_texts(table(spark, folder, "documents"), "text"), label_model(spark, folder))
    return scored.select("text_key", "model", F.explode("scores").alias("label", "score")).withColumn("score", number(F.col("score")))


@query("top_labels", bayes_sql("documents") + "SELECT text_key, model, max_by(label, p) AS label, round(max(p), 6) AS score FROM q GROUP BY 1, 2")
def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Best label of each model and its score for each distinct document text."""
    scored = bayes.label_scores(textwork.distinct_texts(table(spark, folder, "documents"), "text"), label_model(spark, folder))
    return scored.select("text_key", "model", "label", number(F.col("score")).alias("score"))


WIDE_LABELS = [(m, lb) for m, labels in V.MODEL_LABELS.items() for lb in labels]


@query("labelled_answers", bayes_sql("conversations") + ", w AS (SELECT text_key, " + ", ".join(
    f"round(max(p) FILTER (model = '{m}' AND label = '{lb}'), 6) AS \"{m}|{lb}\"" for m, lb in WIDE_LABELS) + """ FROM q GROUP BY 1)
SELECT conv_id, turn, w.* EXCLUDE (text_key) FROM conversations LEFT JOIN w ON text_key = sha256(text)""")
def labelled_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer with the scores of all labels of the eight models, one column each."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    scored = bayes.label_scores(textwork.distinct_texts(rows, "text"), label_model(spark, folder))
    wide = scored.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("model", "scores"))).alias("m"))
    cell = lambda m, lb: F.try_element_at(F.try_element_at("m", F.lit(m)), F.lit(lb))
    return textwork.attach_results(rows, "text", wide).select("conv_id", "turn", *[number(cell(m, lb)).alias(f"{m}|{lb}") for m, lb in WIDE_LABELS])


@query("unknown_model_labels", bayes_sql("documents") + """
, t AS (SELECT text_key, model, max_by(label, p) AS label FROM q GROUP BY 1, 2)
SELECT model, upper(label) AS label, count(*) AS n FROM t WHERE model IN ('tcfd', 'transition') AND upper(label) <> label GROUP BY 1, 2""")
def unknown_model_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels outside the vocabulary of their model, where two models' labels are written in capitals."""
    scored = bayes.label_scores(textwork.distinct_texts(table(spark, folder, "documents"), "text"), label_model(spark, folder))
    shouted = scored.withColumn("label", F.when(F.col("model").isin("tcfd", "transition"), F.upper("label")).otherwise(F.col("label")))
    return textwork.check_labels(shouted, V.MODEL_LABELS)


@query("stored_scoring", bayes_sql("(SELECT text FROM documents UNION ALL SELECT text FROM conversations)") + """
, t AS (SELECT text_key, model, max_by(label, p) AS label FROM q WHERE model IN ('climate_sentiment', 'renewable') GROUP BY 1, 2)
SELECT model, label, count(*) AS n, count(*) AS n_texts FROM t GROUP BY 1, 2""")
def stored_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over two tables into one store, the first one done twice: one row per text and model."""
    names = ("climate_sentiment", "renewable")
    models, path = {m: label_model(spark, folder, (m,)) for m in names}, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    score = lambda name, texts: bayes.label_scores(texts, models[name])
    docs, answers = table(spark, folder, "documents").select("text"), table(spark, folder, "conversations").select("text")
    for rows, run in ((docs, "first"), (docs, "first"), (docs.unionByName(answers), "second")):
        textwork.score_and_store(rows, "text", list(names), score, path, run)
    return textwork.stored_results(spark, path).groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_key").alias("n_texts"))


@query("name_similarity", """
WITH g AS (SELECT p_partkey, unnest(['a', 'b']) AS side, unnest(['^^' || lower(p_name) || '$$', '^^' || lower(p_type) || '$$']) AS t FROM part),
c AS (SELECT p_partkey, side, gram, count(*) AS n FROM (SELECT p_partkey, side, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM g) GROUP BY ALL),
k AS (SELECT p_partkey, sqrt(sum(n * n) FILTER (side = 'a')) * sqrt(sum(n * n) FILTER (side = 'b')) AS k FROM c GROUP BY 1),
d AS (SELECT a.p_partkey, sum(a.n * b.n) AS d FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND a.gram = b.gram AND a.side = 'a' AND b.side = 'b' GROUP BY 1)
SELECT p_partkey, round(coalesce(d, 0) / k, 6) AS similarity FROM k LEFT JOIN d USING (p_partkey)""")
def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the exact character runs of each part's name and type."""
    return table(spark, folder, "part").select("p_partkey", number(textwork.ngram_cosine(F.col("p_name"), F.col("p_type"))).alias("similarity"))


@query("embedded_names")
def embedded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of the hashed character runs of each part's name and type."""
    from surveyloom.functions.similarity import cosine

    part = table(spark, folder, "part")
    names = textwork.embed(part.select("p_partkey", "p_name", "p_type"), "p_name")
    return textwork.embed(names.withColumnRenamed("emb", "name_emb"), "p_type").select(
        "p_partkey", number(cosine(F.col("name_emb"), F.col("emb"))).alias("similarity")
    )
