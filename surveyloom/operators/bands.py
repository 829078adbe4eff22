"""Amounts: currencies, payback bands, quantile bands, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators.ordered import exact_quantiles


def explode_together(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from list columns of equal length, element by element; other rows are dropped."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(columns[0]) == F.size(c))
    rest = [c for c in df.columns if c not in columns]
    zipped = F.explode(F.arrays_zip(*columns)).alias("_z")
    return df.filter(same).select(*rest, zipped).select(*rest, *[F.col("_z." + c).alias(c) for c in columns])


def usable_amounts(df: DataFrame, amount: str, others: list[str], positive: bool = True) -> DataFrame:
    """Rows whose amount and other fields are given, no placeholder, and a number (an error otherwise)."""
    out = df.dropna(subset=[amount, *others])
    for c in (amount, *others):
        out = out.filter(~cells.is_placeholder(F.col(c), V.AMOUNT_PLACEHOLDERS))
    out = out.withColumn(amount, F.col(amount).cast("double"))
    return out.filter(F.col(amount) > 0) if positive else out


def rate_table(wide: DataFrame, year: str = "year") -> DataFrame:
    """``year, currency, rate`` from a table with one column per currency."""
    codes = [c for c in wide.columns if c != year]
    entries = F.array(*[F.struct(F.lit(c).alias("currency"), F.col(c).cast("double").alias("rate")) for c in codes])
    return wide.select(F.col(year).cast("int").alias("year"), F.explode(entries).alias("e")).select("year", "e.currency", "e.rate").filter("rate is not null")


def convert_currency(df: DataFrame, rates: DataFrame, amount: str, year: str, currency: str, missing: str = "error", out: str | None = None) -> DataFrame:
    """Amount divided by the rate of its (year, currency); a missing rate is an error or null."""
    table = rates.select(F.col("year").alias("_y"), F.col("currency").alias("_c"), F.col("rate").cast("double").alias("_rate"))
    joined = df.join(table, (F.col(year) == F.col("_y")) & (F.col(currency) == F.col("_c")), "left")
    rate = F.col("_rate")
    if missing == "error":
        text = F.concat(F.lit("no rate for "), F.coalesce(F.col(currency), F.lit("null")), F.lit(" in "), F.coalesce(F.col(year).cast("string"), F.lit("null")))
        rate = F.when(rate.isNull(), F.raise_error(text).cast("double")).otherwise(rate)
    return joined.withColumn(out or amount, F.col(amount) / rate).drop("_y", "_c", "_rate")


def band_pivot(df: DataFrame, by: str, band: str, bands: list[str], value: Column | None = None) -> DataFrame:
    """Rows ``by``, one column per band (0 where absent), and each band's share of the row."""
    cell = F.sum(value) if value is not None else F.count(F.lit(1))
    wide = df.groupBy(by).pivot(band, bands).agg(cell).fillna(0)
    total = F.lit(0)
    for b in bands:
        total = total + F.col(f"`{b}`")
    return wide.select(by, *[F.col(f"`{b}`") for b in bands], *[
        F.when(total != 0, F.col(f"`{b}`") / total).otherwise(0.0).alias(b + "_share") for b in bands
    ])


def quartile_bands(df: DataFrame, value: str, labels: tuple = V.QUARTILE_LABELS, out: str = "quartile") -> DataFrame:
    """Band by the overall quartiles (nearest rank)."""
    q = exact_quantiles(df, [], value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    limits = q.select(F.struct("q1", "q2", "q3").alias("q")).scalar()
    marked = df.withColumn("_q", limits)
    band = F.when(F.col(value) <= F.col("_q.q1"), labels[0]).when(F.col(value) <= F.col("_q.q2"), labels[1]).when(F.col(value) <= F.col("_q.q3"), labels[2]).otherwise(labels[3])
    return marked.withColumn(out, band).drop("_q")


def trim_above(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows with a positive value up to the quantile of the positive values."""
    positive = df.filter(F.col(value) > 0)
    limit = exact_quantiles(positive, [], value, {"q": q}).scalar()
    return positive.filter(F.col(value) <= limit)


def returns_per_band(df: DataFrame, year: str, band: str, value: str) -> DataFrame:
    """Volatility and mean of the yearly change of each band's mean, over years where every band has a change."""
    means = df.groupBy(year, band).agg(F.avg(value).alias("_m"))
    before = F.lag("_m").over(Window.partitionBy(band).orderBy(year))
    changes = means.withColumn("_r", F.when(before != 0, F.col("_m") / before - 1))
    n_bands = means.agg(F.count_distinct(band).alias("k")).scalar()
    complete = changes.groupBy(year).agg(F.count("_r").alias("_k")).filter(F.col("_k") == n_bands).select(year)
    return changes.join(complete, year, "left_semi").groupBy(band).agg(
        F.stddev_samp("_r").alias("volatility"), F.avg("_r").alias("mean_return"), F.count("_r").alias("n_years")
    )
