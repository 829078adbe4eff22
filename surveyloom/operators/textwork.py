"""Text stages that run once per distinct text: embed, detect, translate, classify."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from surveyloom.session import cut_lineage

Scorer = Callable[[list[str]], list[dict[str, float]]]
Translator = Callable[[list[str], list[str]], list[str]]


#: Characters of text whose triples a task finds at once; a longer text is handled alone.
TRIPLE_CHARS = 2_000_000

#: Numbers of a language profile up to which every task holds it, 64 MB.
HELD_VALUES = 8_000_000


# -- distinct texts and results ------------------------------------------------
def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """Each non-empty text once, with its hash.

    Grouping is on the hash, so texts are compared by a short key, and copies that one
    task reads meet before they are sent on; one text per task and hash is shuffled.
    """
    key = F.sha2(text, 256)
    rows = df.select(key.alias("text_key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return rows.groupBy("text_key").agg(F.any_value("text").alias("text"))


def unseen(texts: DataFrame, results: DataFrame | None, model: str | None = None) -> DataFrame:
    """Texts that have no stored result yet (for the model, if given)."""
    if results is None:
        return texts
    done = results if model is None else results.filter(F.col("model") == model)
    return texts.join(done.select("text_key").distinct(), "text_key", "left_anti")


def attach_results(df: DataFrame, text: str, results: DataFrame) -> DataFrame:
    """Results of distinct texts mapped back to every row that holds the text."""
    return df.withColumn("text_key", F.sha2(text, 256)).join(results, "text_key", "left").drop("text_key")


RESULT_SCHEMA = "text_key string, model string, label string, scores map<string,double>"


def store_results(results: DataFrame, path: str, run: str) -> None:
    """Publish the results of one run; a run that is repeated replaces what it wrote before.

    Rows go to a folder per (model, run), which a repeated run overwrites as a whole.
    Only then is the run entered in the list of published ones, so what a broken run left is
    not read. ``results``: ``text_key, model, label, scores``.
    """
    spark = results.sparkSession
    dealt = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run").parquet(f"{path}/{name}")
    dealt(results.select("text_key", "label", "scores", "model", F.lit(run).alias("run")), "results")
    written = _read_or_none(spark, f"{path}/results", RESULT_SCHEMA + ", run string")
    if written is not None:
        dealt(written.filter(F.col("run") == run).groupBy("model", "run").agg(F.count(F.lit(1)).alias("n")), "published")


def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def stored_results(spark: SparkSession, path: str, without_run: str | None = None) -> DataFrame:
    """``text_key, model, label, scores`` of all published runs, one row per text and model.

    Should two runs have scored the same text side by side, the first run by name counts.
    ``without_run`` leaves one run out, whose texts are then scored again when it is repeated.
    """
    rows, runs = (_read_or_none(spark, f"{path}/{n}", schema) for n, schema in (("results", RESULT_SCHEMA + ", run string"), ("published", "model string, run string, n bigint")))
    if rows is None or runs is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    if without_run is not None:
        runs = runs.filter(F.col("run") != without_run)
    known = rows.join(runs.select("model", "run"), ["model", "run"], "left_semi")
    return known.groupBy("text_key", "model").agg(F.min_by(F.struct("label", "scores"), "run").alias("r")).select("text_key", "model", "r.label", "r.scores")


def _with_stored(df: DataFrame, text: str, models: list[str], results: DataFrame) -> DataFrame:
    """``text_key, text`` of distinct texts, and ``stored0..``: whether there are results for each model.

    Texts and keys of results meet in one shuffle. Written out; a text that no model asks for is left null.
    """
    rows = df.select(F.sha2(text, 256).alias("text_key"), F.col(text).alias("text"), F.lit(None).cast("string").alias("model")).filter(F.length("text") > 0)
    done = results.filter(F.col("model").isin(*models)).select("text_key", F.lit(None).cast("string").alias("text"), "model")
    stored = [F.coalesce(F.max(F.col("model") == m), F.lit(False)).alias(f"stored{i}") for i, m in enumerate(models)]
    met = rows.unionByName(done).groupBy("text_key").agg(F.any_value("text", ignoreNulls=True).alias("text"), *stored).filter(F.col("text").isNotNull())
    asked = reduce(lambda a, b: a | b, [~F.col(f"stored{i}") for i in range(len(models))], F.lit(False))
    return cut_lineage(met.select("text_key", F.when(asked, F.col("text")).alias("text"), *[f"stored{i}" for i in range(len(models))]))


def score_and_store(df: DataFrame, text: str, models: list[str], score: Callable[[str, DataFrame], DataFrame], path: str, run: str) -> DataFrame:
    """Read, score, write: results for the texts of ``df`` out of the store at ``path``, filled where it lacks them.

    ``score(model, texts)`` gives the results of distinct texts for one model, as
    :func:`score_texts` does. A run may be repeated, and may follow a broken one.
    """
    spark = df.sparkSession
    texts = _with_stored(df, text, models, stored_results(spark, path, run))
    for i, model in enumerate(models):
        todo = texts.filter(~F.col(f"stored{i}")).select("text_key", "text")
        store_results(score(model, todo).select("text_key", "model", "label", "scores"), path, run)
    known = stored_results(spark, path).filter(F.col("model").isin(*models))
    return known.join(texts.select("text_key"), "text_key", "left_semi")


# -- classification --------------------------------------------------------------
def score_texts(texts: DataFrame, scorers: dict[str, Callable[[], Scorer]], batch: int = 512) -> DataFrame:
    """Label (highest score) and all scores per distinct text and model.

    ``scorers`` maps a model name to a function that loads it; it is called once
    per task, so one model is in memory at a time. Result: ``text_key, model,
    label, scores MAP<STRING, DOUBLE>``.
    """
    schema = "text_key string, model string, label string, scores map<string,double>"

    def one(model: str, load: Callable[[], Scorer]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = load()
            for frame in frames:
                for start in range(0, len(frame), batch):
                    part = frame.iloc[start:start + batch]
                    scores = scorer(part["text"].tolist())
                    labels = [max(s, key=s.get) for s in scores]
                    yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "model": model, "label": labels, "scores": scores})
        return run

    out = None
    for model, load in scorers.items():
        scored = texts.select("text_key", "text").mapInPandas(one(model, load), schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def classify(df: DataFrame, text: str, scorers: dict[str, Callable[[], Scorer]], results: DataFrame | None = None) -> DataFrame:
    """All results for the texts of ``df``: stored ones and newly scored ones."""
    # Every model reads the distinct texts, so they are found once.
    texts = cut_lineage(distinct_texts(df, text))
    new = None
    for model, load in scorers.items():
        scored = score_texts(unseen(texts, results, model), {model: load})
        new = scored if new is None else new.unionByName(scored)
    if results is None:
        return new
    known = results.filter(F.col("model").isin(*scorers)).join(texts.select("text_key"), "text_key", "left_semi")
    return known.select("text_key", "model", "label", "scores").unionByName(new)


def check_labels(results: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """Labels that their model does not know, with counts."""
    known = F.lit(False)
    for model, labels in vocabulary.items():
        known = known | ((F.col("model") == model) & F.col("label").isin(*labels))
    return results.filter(~known).groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))


def score_columns(results: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> list[Column]:
    """One column per (model, label) out of the score map, for a wide sink."""
    return [
        F.when(F.col("model") == m, F.try_element_at("scores", F.lit(lb))).alias(f"{m}|{lb}") for m, labels in vocabulary.items() for lb in labels
    ]


# -- languages ---------------------------------------------------------------------
def _triples(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, text, code) of slices: distinct triples of code points of each text as numbers, sorted by text and number.

    21 bits a character, so no triples are confused.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < TRIPLE_CHARS):
            size += len(texts[last].as_py() or "")
            last += 1
        values = [t or "" for t in texts.slice(first, last - first).to_pylist()]
        lengths = np.array([len(v) for v in values], dtype=np.int64)
        points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = np.maximum(lengths - 2, 0)
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat((np.cumsum(lengths) - lengths) - (ends - n), n)
        code = (points[at] << 42) | (points[at + 1] << 21) | points[at + 2]
        for low, high in zip((ends - n).tolist(), ends.tolist()):
            code[low:high].sort()
        text = np.repeat(np.arange(len(values)), n)
        new = np.ones(len(code), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
        yield keys.slice(first, last - first), text[new], code[new]
        first = last


def _triple_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, text, code in _triples(batch.column(0), batch.column(1)):
            offsets = np.searchsorted(text, np.arange(len(keys) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(code))], names=["key", "grams"])


def _triple_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, text, code in _triples(batch.column(0), batch.column(1)):
            names = keys.dictionary_encode()
            group = names.indices.to_numpy()[text]
            for i, name in enumerate(names.dictionary):
                grams, times = np.unique(code[group == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(grams), name.type), pa.array(grams), pa.array(times)], names=["key", "gram", "n"])


def _heads(df: DataFrame, key: str, text: str, characters: int | None) -> DataFrame:
    head = F.lower(F.replace(F.col(text) if characters is None else F.substring(text, 1, characters), F.lit("\n"), F.lit(" ")))
    return df.select(F.col(key).alias("key"), head.alias("head"))


def trigram_rows(df: DataFrame, key: str, text: str, characters: int | None = None) -> DataFrame:
    """``key, n, gram``: distinct character triples, line breaks as blanks.

    Of the whole text, or of its first ``characters`` where a caller wants only those.
    ``n`` is the number of triples of the text; a text without any keeps a row. A triple is
    a number made of its code points. The cost is in proportion to the length of the text.
    """
    rows = _heads(df, key, text, characters)
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("grams", ArrayType(LongType()))])
    found = rows.mapInArrow(_triple_lists, schema)
    return found.select(F.col("key").alias(key), F.nullif(F.size("grams"), F.lit(0)).alias("n"), F.explode_outer("grams").alias("gram"))


def language_profile(known: DataFrame, text: str, lang: str) -> DataFrame:
    """Log probability of each triple per language, add-one smoothed.

    Texts without a language are left out. Tasks count the texts of a slice before anything is
    shuffled. Written out: it is small, read in several places, and its size decides how it
    is met.
    """
    rows = _heads(known.filter(F.col(lang).isNotNull()), lang, text, None)
    schema = StructType([StructField("lang", rows.schema["key"].dataType), StructField("gram", LongType()), StructField("n", LongType())])
    counts = rows.mapInArrow(_triple_counts, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return cut_lineage(counts.join(totals, "lang").select(
        "lang", "gram", F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))).alias("logp"),
        F.log(1.0 / (F.col("total") + F.col("kinds"))).alias("floor"),
    ))


def detect_languages(texts: DataFrame, profile: DataFrame, target: str = "en", held_values: int = HELD_VALUES) -> DataFrame:
    """``text_key, lang`` of distinct texts: best profile, or the target if nothing fits.

    A triple adds its log probability where a language knows it and the
    language's floor where not; scores are compared to nine decimals, the last language by
    name wins a tie. The profile is one row per triple with a column for each of its
    languages. If it has at most ``held_values`` numbers, every task holds it and texts stay
    where they are; a larger one is joined to the texts' triples. Both give the same languages.
    """
    floors = {r["lang"]: r["floor"] for r in profile.groupBy("lang").agg(F.max("floor").alias("floor")).collect()}
    if not floors:
        return texts.select("text_key", F.lit(target).alias("lang"))
    langs = sorted(floors)
    gains = {lang: f"_g{i}" for i, lang in enumerate(langs)}
    by_gram = cut_lineage(profile.groupBy("gram").agg(
        *[F.max(F.when(F.col("lang") == lang, F.col("logp") - F.col("floor"))).alias(g) for lang, g in gains.items()]))
    if by_gram.count() * (1 + len(langs)) <= held_values:
        return _detect_held(texts, by_gram, floors, target)
    met = trigram_rows(texts, "text_key", "text").join(by_gram, "gram", "left")
    totals = met.groupBy("text_key").agg(F.max("n").alias("n"), *[F.sum(g).alias(g) for g in gains.values()])
    scores = [F.when(F.col(g).isNotNull(), F.struct(F.round(F.col(g) + F.lit(floors[lang]) * F.col("n"), 9).alias("score"), F.lit(lang).alias("lang"))) for lang, g in gains.items()]
    best = F.array_max(F.array(*scores))["lang"]
    return totals.select("text_key", F.coalesce(best, F.lit(target)).alias("lang"))


def _detect_held(texts: DataFrame, by_gram: DataFrame, floors: dict[str, float], target: str) -> DataFrame:
    """Languages of texts by a profile whose size the caller has checked."""
    langs = sorted(floors)
    table = by_gram.orderBy("gram").toArrow()
    # A triple that a language knows adds at least log 2, so no gain means not known.
    gains = np.stack([table.column(f"_g{i}").fill_null(0.0).to_numpy() for i in range(len(langs))], axis=1)
    held = texts.sparkSession.sparkContext.broadcast((table.column("gram").to_numpy(), gains))
    floor = np.array([floors[lang] for lang in langs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gains = held.value
        for batch in batches:
            for keys, text, code in _triples(batch.column(0), batch.column(1)):
                at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
                known = grams[at] == code
                n = np.bincount(text, minlength=len(keys))
                gain = np.stack([np.bincount(text, np.where(known, gains[at, i], 0.0), len(keys)) for i in range(len(floor))], axis=1)
                score = np.where(gain > 0, np.round(gain + floor * n[:, None], 9), -np.inf)
                best = len(floor) - 1 - np.argmax(score[:, ::-1], axis=1)
                lang = [langs[b] if s else target for b, s in zip(best.tolist(), (gain > 0).any(axis=1).tolist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(lang, pa.string())], names=["text_key", "lang"])

    return _heads(texts, "text_key", "text", None).mapInArrow(run, StructType([texts.schema["text_key"], StructField("lang", StringType())]))


def translate(
    df: DataFrame, text: str, load: Callable[[], Translator], profile: DataFrame, target: str = "en",
    results: DataFrame | None = None, batch: int = 64,
) -> DataFrame:
    """``text_key, lang, translation`` for the distinct texts of ``df``.

    Texts already in the target language keep their wording and stored
    translations are reused; the rest goes through the supplied translator.
    """
    texts = cut_lineage(distinct_texts(df, text))
    detected = cut_lineage(texts.join(detect_languages(texts, profile, target), "text_key"))
    same = detected.filter(F.col("lang") == target).select("text_key", "lang", F.col("text").alias("translation"))
    todo = unseen(detected.filter(F.col("lang") != target), results)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                done = translator(part["text"].tolist(), part["lang"].tolist())
                yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "lang": part["lang"].to_numpy(), "translation": done})

    new = todo.select("text_key", "lang", "text").mapInPandas(run, "text_key string, lang string, translation string")
    out = same.unionByName(new)
    if results is not None:
        reused = detected.filter(F.col("lang") != target).select("text_key", "lang").join(results.select("text_key", "translation"), "text_key")
        out = out.unionByName(reused)
    return out


def translate_column(df: DataFrame, text: str, translated: DataFrame, extend: bool = True, detected: bool = True) -> DataFrame:
    """Add (``extend``) or replace the text by its translation, and add the language."""
    out = attach_results(df, text, translated)
    if not extend:
        out = out.withColumn(text, F.coalesce("translation", text)).drop("translation")
    return out if detected else out.drop("lang")


def _run_numbers(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the character runs of each text; equal runs of the texts have equal numbers."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    runs = np.maximum(lengths - (n - 1), 0)
    at = np.arange(int(runs.sum())) + np.repeat((np.cumsum(lengths) - lengths) - (np.cumsum(runs) - runs), runs)
    number, bits = points[at], 21
    for k in range(1, n):
        if bits > 42:
            number, bits = np.unique(number, return_inverse=True)[1].astype(np.int64), 42
        number, bits = (number << 21) | points[at + k], bits + 21
    return np.repeat(np.arange(len(texts)), runs), number


def _run_cosines(a: list[str], b: list[str], n: int) -> np.ndarray:
    """Cosine of the counts of runs of a[i] and b[i]; NaN where a text has no run."""
    text, number = _run_numbers([*a, *b], n)
    in_b = text >= len(a)
    row = text - len(a) * in_b
    order = np.lexsort((number, row))
    row, number, in_b = row[order], number[order], in_b[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))[: len(row)])
    times_b = np.add.reduceat(in_b.astype(np.int64), first) if len(first) else np.zeros(0)
    times_a = np.diff(first, append=len(row)) - times_b
    dot = lambda x, y: np.bincount(row[first], weights=x * y, minlength=len(a))
    with np.errstate(invalid="ignore"):
        return dot(times_a, times_b) / np.sqrt(dot(times_a, times_a) * dot(times_b, times_b))


def ngram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of the exact counts of two texts' character runs, framed as in :func:`embed`.

    Runs are numbered and sorted, so the cost is in proportion to the length of the texts.
    """
    framed = lambda c: F.concat(F.lit("^^"), F.coalesce(F.lower(c), F.lit("")), F.lit("$$"))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        part = (x.str.len() + y.str.len()).cumsum().to_numpy(dtype=np.int64) // TRIPLE_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(x)]
        return pd.Series(np.concatenate([_run_cosines(x.iloc[i:j].tolist(), y.iloc[i:j].tolist(), n) for i, j in zip(cuts, cuts[1:])]))

    return cosine(framed(a), framed(b))


# -- vectors -----------------------------------------------------------------------
def embed(df: DataFrame, text: str, out: str = "emb", size: int = 256, n: int = 3) -> DataFrame:
    """Hashed character n-gram vector of length one; any other vectoriser can fill the column instead."""
    chars = RegexTokenizer(inputCol="_t", outputCol="_c", pattern="", gaps=True, minTokenLength=1)
    grams = NGram(n=n, inputCol="_c", outputCol="_g")
    counts = HashingTF(inputCol="_g", outputCol="_f", numFeatures=size)
    scaled = Normalizer(inputCol="_f", outputCol="_e")
    work = df.withColumn("_t", F.concat(F.lit("^^"), F.coalesce(F.lower(text), F.lit("")), F.lit("$$")))
    for stage in (chars, grams, counts, scaled):
        work = stage.transform(work)
    return work.withColumn(out, vector_to_array("_e")).drop("_t", "_c", "_g", "_f", "_e")


def embed_with(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """``text_key, emb`` of the distinct texts by a supplied model, mean-pooled and scaled by it."""
    texts = distinct_texts(df, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                yield pd.DataFrame({"text_key": part["text_key"].to_numpy(), "emb": model(part["text"].tolist())})

    return texts.select("text_key", "text").mapInPandas(run, "text_key string, emb array<double>")
