"""Responses -> labels and per-question metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from surveyloom.operators import indicators, textwork

QUESTION = ["account_no", "year", "respondent", "column", "sheet"]


def label_table(responses: DataFrame, results: DataFrame) -> DataFrame:
    """``labels`` rows: one per answer and model, from results per distinct text."""
    keyed = responses.filter(F.length("value") > 0).withColumn("text_key", F.sha2("value", 256))
    return keyed.join(results, "text_key").select(*QUESTION, "pos", "model", "label", "scores")


def metrics_table(responses: DataFrame, labels: DataFrame, model: str = "climate_specificity", label: str = "spec") -> DataFrame:
    """Mean score of one label, characters and number of answers per question.

    The scores sit on the same key, so both sides are aggregated before they meet.
    """
    written = responses.groupBy(*QUESTION).agg(
        F.sum(F.length("value")).cast("long").alias("number_characters"), F.count("value").alias("number_responses")
    )
    scored = labels.filter(F.col("model") == model).groupBy(*QUESTION).agg(
        F.avg(F.try_element_at("scores", F.lit(label))).alias("score_average")
    )
    return written.join(scored, QUESTION, "left").select(*QUESTION, "score_average", "number_characters", "number_responses")


def enrich(
    responses: DataFrame, scorers: dict[str, Callable], results: DataFrame | None = None,
    translator: Callable | None = None, profile: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Translate (optional), classify, measure. Returns (responses, labels, metrics).

    The metrics count the original wording; labels come from the translation.
    """
    working = responses
    if translator is not None:
        translated = textwork.translate(responses, "value", translator, profile)
        working = textwork.translate_column(responses, "value", translated, extend=False, detected=False)
    found = textwork.classify(working, "value", scorers, results)
    labels = label_table(working, found)
    return responses, labels, metrics_table(responses, labels)


def answered_questions(metrics: DataFrame) -> DataFrame:
    return indicators.max_answered(metrics.withColumnRenamed("number_responses", "n_responses"), "year", ["account_no", "respondent"])
