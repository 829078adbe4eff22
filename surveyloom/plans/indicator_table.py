"""Responses, labels and metrics -> one row of indicators per respondent and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.operators import indicators
from surveyloom.operators.ordered import join_keys
from surveyloom.plans.metrics import answered_questions

KEYS = ["account_no", "year", "respondent"]


def in_survey(sheet: Column) -> Column:
    """Whether a question's sheet belongs to the survey proper: neither a summary nor a property of the whole workbook."""
    return ~sheet.startswith("Summary") & (sheet != "*")


def cell_labels(labels: DataFrame) -> DataFrame:
    """One row per question cell and model with the cell's distinct labels as text.

    A label counts once per cell however often the cell holds it, so repeated
    labels are dropped before the cell text is put together.
    """
    cell = [*KEYS, "column", "sheet", "model"]
    distinct = labels.select(*cell, "label").distinct()
    return distinct.groupBy(*cell).agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("label"))


def indicator_table(responses: DataFrame, labels: DataFrame, metrics: DataFrame, null_as_text: bool = False) -> DataFrame:
    """``maxcol``, text fill and the 20 label counts with their means.

    The summary sheet is not part of the survey proper and is left out of the
    text and label columns.
    """
    maxcol = answered_questions(metrics)
    survey = in_survey(F.col("sheet"))
    cell_text = responses.filter(survey).groupBy(*KEYS, "column", "sheet").agg(
        F.sum(indicators.cell_characters(F.col("value"))).alias("n")
    )
    written = cell_text.groupBy(*KEYS).agg(F.sum("n").cast("long").alias("nchar_sum"), F.sum((F.col("n") >= 1).cast("long")).alias("_filled"))
    counts = indicators.label_counts(cell_labels(labels.filter(survey)), KEYS, maxcol, "year", V.KPI_LABELS, null_as_text)
    divisor = F.when(F.col("maxcol") == 0, 1).otherwise(F.col("maxcol"))
    everyone = join_keys(written, maxcol, ["year"], "left").withColumn("prop_filled", F.col("_filled") / divisor).drop("_filled")
    out = join_keys(everyone, counts.drop("maxcol"), KEYS, "left")
    measures = [c for c in counts.columns if c not in (*KEYS, "maxcol")]
    return out.select(*KEYS, "maxcol", "nchar_sum", "prop_filled", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])
