"""The operators as registered queries over whole tables, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.llm import language_id, piece_codec, quality_rules, toxicity
from surveyloom.llm.collocations import collocations
from surveyloom.llm.common import shared_table
from surveyloom.llm.exact_dedup import exact_dedup
from surveyloom.llm.kd_shards import kd_shards
from surveyloom.llm.near_join import near_join
from surveyloom.llm.packing import pack
from surveyloom.llm.periodic_runs import periodic_runs
from surveyloom.llm.substring_dedup import substring_dedup
from surveyloom.llm.token_counts import count_tokens
from surveyloom.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.identify(docs, language_id.fit(language_id.training_rows(docs))).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op2_sentencepiece_codec")
def op2_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    encoded = piece_codec.encode(table(spark, folder, "documents"))
    hashed = encoded.select("doc_id", "text_key", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "ids")
    decoded = piece_codec.decode(hashed, "doc_id", "text_key", "n_tokens", "ids_hash")
    return decoded.select("doc_id", "n_tokens", "ids_hash", (F.xxhash64("text") == F.col("text_key")).alias("round_trip"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = shared_table(quality_rules.document_statistics(table(spark, folder, "documents")))
    return quality_rules.judge(stats, quality_rules.fit(stats, table(spark, folder, "labels")))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, folder, "labels")))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS cp, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS s FROM d),
h AS (SELECT doc_id, cp, sha256(s) AS text_sha256 FROM n),
r AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


@query("op5_exact_dedup", EXACT_DEDUP_SQL)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"))


URL_FILTER_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT p.*, action, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN (contains(host, 'ads-track.') AND starts_with(path, '/')) OR contains(path, '/login')
      OR contains(path, '/wp-admin/') OR ends_with(host || path, '.exe') OR ends_with(host || path, '.zip')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE k = 1
"""


@query("op10_url_filters", URL_FILTER_SQL)
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the hash of its id, repeats a stretch of its words from some word on.

    The hash is crc32 of the decimal id (empty for a null id); a text without a word stays
    as it is.
    """
    words = F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    g = F.floor(F.col("h") / 10).cast("bigint")
    start = F.pmod(F.col("g"), F.col("n"))
    period = (1 + F.expr("(n - a) div (3 + g % 8)")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("n") - F.col("a"))), " ")
    hashed = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    counted = hashed.withColumn("g", g).withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, start).cast("int")).withColumn("p", period)
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, folder, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words", "n_dropped")


@query("op12_kd_sharding")
def op12_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = kd_shards(table(spark, folder, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM p
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM p),
f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase),
c AS (
  SELECT f.*, k, array_to_string(f.w[:k], ' ') AS head, array_to_string(f.w[k + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) v(k) WHERE a >= 10 AND m >= 2 AND k < m),
s AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, h.a AS l, t.a AS r, ((c.a::HUGEINT * c.a * 1000000) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(w[:2], ' ') AS part FROM f WHERE m = 3 AND a >= 10 UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') FROM f WHERE m = 3 AND a >= 10)
  GROUP BY lang, part),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
  SELECT b.lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON b.m = 2 AND i.lang = b.lang AND i.part = b.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
