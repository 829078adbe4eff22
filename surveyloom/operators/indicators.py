"""Respondent-year indicators from labels and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators.ordered import join_keys
from surveyloom.session import cut_lineage


def max_answered(answers: DataFrame, year: str = "year", respondent: list[str] = ("key",), answered: str = "n_responses") -> DataFrame:
    """Per year, the largest number of questions answered by any respondent."""
    per_respondent = answers.groupBy(year, *respondent).agg(F.sum((F.col(answered) >= 1).cast("long")).alias("_filled"))
    return per_respondent.groupBy(year).agg(F.max("_filled").alias("maxcol"))


def of_respondents(df: DataFrame, name: str, respondent: str = "respondent") -> DataFrame:
    """Rows whose respondent holds the name: an entry of a list cell, or a part of a text, case ignored."""
    listed = df.schema[respondent].dataType.typeName() == "array"
    return df.filter(F.array_contains(respondent, name) if listed else F.lower(respondent).contains(name.lower()))


def label_match(label_cell: Column, label: str, null_as_text: bool = False) -> Column:
    """1 where a cell's text holds the label, case ignored; once per cell.

    A cell may be a text or an array. With ``null_as_text`` a missing cell reads
    as the text ``None``, so labels that occur in it count it too.
    """
    needle = label.lower()
    hit = F.lower(label_cell).contains(needle)
    return F.coalesce(hit, F.lit(null_as_text and needle in "none")).cast("int")


def capped(counted: DataFrame, maxcol: DataFrame | None, year: str) -> DataFrame:
    """Add ``maxcol``: a given table, or the largest ``_filled`` of each year.

    In the second case the counts, one row per respondent and year, are written
    out, so that the answers themselves are read once.
    """
    if maxcol is None:
        counted = cut_lineage(counted)
        maxcol = counted.groupBy(year).agg(F.max("_filled").alias("maxcol"))
    # A null year is a year of its own.
    return join_keys(counted, maxcol, [year], "left").withColumn("_divisor", F.when(F.col("maxcol") == 0, 1).otherwise(F.col("maxcol")))


def label_counts(
    labels: DataFrame, keys: list[str], maxcol: DataFrame | None = None, year: str = "year",
    pairs: tuple = V.KPI_LABELS, null_as_text: bool = False, mean_names: dict = V.KPI_MEAN_NAMES, answered: Column | None = None,
) -> DataFrame:
    """Sum and mean (over ``maxcol``) of every (model, label) pair, one row per key.

    ``labels``: ``*keys, model, label`` in long form, where ``label`` holds the
    cell text. One conditional aggregation covers all pairs. Without ``maxcol``
    the rows with ``answered`` set are counted along the way.
    """
    name = lambda m, lb: f"{m}_label_{lb}"
    sums = [
        F.sum(F.when(F.col("model") == m, label_match(F.col("label"), lb, null_as_text)).otherwise(0)).cast("long").alias(name(m, lb) + "_sum")
        for m, lb in pairs
    ]
    filled = F.sum((answered if answered is not None else F.col("label").isNotNull()).cast("long")).alias("_filled")
    counted = capped(labels.groupBy(*keys).agg(filled, *sums), maxcol, year)
    means = [(F.col(name(m, lb) + "_sum") / F.col("_divisor")).alias(mean_names.get((m, lb), name(m, lb) + "_mean")) for m, lb in pairs]
    return counted.select(*keys, "maxcol", *[name(m, lb) + "_sum" for m, lb in pairs], *means)


def cell_characters(text: Column) -> Column:
    """Characters left after removing list marks, placeholders and white space."""
    out = cells.strip_list_marks(text)
    for token in ("Question not applicable", "Hidden Answer", "None"):
        out = F.replace(out, F.lit(token), F.lit(""))
    return F.coalesce(F.length(F.regexp_replace(out, r"(?U)\s+", "")), F.lit(0))


def text_fill(answers: DataFrame, keys: list[str], text: str, maxcol: DataFrame | None = None, year: str = "year") -> DataFrame:
    """Characters written and share of questions filled, one row per key."""
    n = answers.select(*keys, cell_characters(F.col(text)).alias("_n"))
    counted = n.groupBy(*keys).agg(F.sum("_n").cast("long").alias("nchar_sum"), F.sum((F.col("_n") >= 1).cast("long")).alias("_filled"))
    return capped(counted, maxcol, year).select(*keys, "maxcol", "nchar_sum", (F.col("_filled") / F.col("_divisor")).alias("prop_filled"))


def question_metrics(cells_long: DataFrame, keys: list[str], text: str, score: str) -> DataFrame:
    """Mean score, characters and number of answers per key and question.

    Long form: one row per answer, so the list metrics are plain aggregates.
    """
    return cells_long.groupBy(*keys).agg(
        F.avg(F.col(score).cast("double")).alias("score_average"),
        F.sum(F.length(text)).cast("long").alias("number_characters"),
        F.count(text).alias("number_responses"),
    )


def question_metrics_arrays(text: Column, score: Column) -> list[Column]:
    """The same metrics for list cells."""
    return [
        cells.list_mean(score).alias("score_average"),
        cells.list_characters(text).alias("number_characters"),
        cells.list_responses(text).alias("number_responses"),
    ]
