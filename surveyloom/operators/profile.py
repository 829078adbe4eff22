"""Profiles: what a column, a table or a set of workbooks holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.operators.ordered import join_keys

PUNCTUATION = r"\p{P}"


def column_profile(long: DataFrame, year: str = "year") -> DataFrame:
    """One row per column: counts, uniqueness, lengths, punctuation, ``Other:`` entries.

    A value is replaced by its hash and its few features where it is read, so the
    shuffles carry no text; repeats are counted before they are sent.
    """
    value = F.col("value")
    features = long.filter(value.isNotNull()).select(
        "column", F.col(year).alias("_y"), F.sha2(value, 256).alias("_key"), F.length(value).alias("_len"),
        (value.rlike(r"^Other:\s").cast("int") + value.rlike(r"^Other,\s").cast("int")).alias("_other"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(value, F.lit(PUNCTUATION), 0))).alias("_marks"),
    )
    per_value = features.groupBy("column", "_y", "_key", "_len", "_other", "_marks").agg(F.count(F.lit(1)).alias("n"))
    per_year = per_value.groupBy("column", "_y").agg(F.count(F.lit(1)).alias("u")).groupBy("column").agg(
        F.avg("u").alias("mean_unique_per_year")
    )
    values = per_value.groupBy("column", "_key", "_len", "_other", "_marks").agg(F.sum("n").alias("n"))
    basics = values.groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum(F.col("_len") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.min("_len").alias("min_length"),
        F.max("_len").alias("max_length"),
        F.sum(F.col("_other") * F.col("n")).alias("n_other"),
    )
    marks = values.select("column", F.explode("_marks").alias("mark")).distinct()
    punctuation = marks.groupBy("column").agg(F.sort_array(F.collect_list("mark")).alias("punctuation"))
    return (
        join_keys(join_keys(basics, per_year, ["column"]), punctuation, ["column"], "left")
        .withColumn("punctuation", F.coalesce("punctuation", F.array().cast("array<string>")))
        .withColumn("share_unique", F.col("n_unique") / F.col("n_values"))
    )


def value_samples(long: DataFrame, n: int = 3, width: int | None = None) -> DataFrame:
    """Most and least frequent ``n`` values of each column as ``count|value`` text, cut to ``width`` if given.

    Counts are cut to ``n`` per (column, hash class) first and then per column, so
    no column is sorted whole.
    """
    values = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    salted = values.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))

    def ends(order: list[Column], end: str) -> DataFrame:
        local = Window.partitionBy("column", "_salt").orderBy(*order)
        final = Window.partitionBy("column").orderBy(*order)
        return (
            salted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
            .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
            .select("column", F.lit(end).alias("end"), "rank", "n", "value")
        )

    top = ends([F.desc("n"), F.asc("value")], "top")
    bottom = ends([F.asc("n"), F.desc("value")], "bottom")
    sample = F.concat_ws("|", F.col("n").cast("string"), "value")
    return top.unionByName(bottom).select("column", "end", "rank", (sample if width is None else F.substring(sample, 1, width)).alias("sample"))


def free_text_columns(profile: DataFrame) -> DataFrame:
    """Columns that hold free text: ``Other`` entries, or long varied punctuated values."""
    prose = (
        F.array_contains("punctuation", ".") & F.array_contains("punctuation", ",")
        & (F.col("avg_length") > 20) & (F.col("mean_unique_per_year") > 1) & (F.col("max_length") > 30)
    )
    return profile.filter((F.col("n_other") > 0) | prose)


def completeness(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Share of non-null cells per group and column."""
    return df.groupBy(by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and percentage per column, as rows."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing")) for c in columns])
    return counts.select("_n", F.explode(entries).alias("e")).select(
        "e.variable", "e.n_missing", (F.col("e.n_missing") / F.col("_n") * 100).alias("pct_missing")
    )


def missing_patterns(df: DataFrame, columns: list[str], zero_is_missing: bool = True) -> DataFrame:
    """Rows per combination of missing columns."""
    def gone(c: str) -> Column:
        missing = F.col(c).isNull()
        numeric = dict(df.dtypes)[c] not in ("string", "date", "timestamp", "boolean")
        return missing | (F.col(c) == 0) if zero_is_missing and numeric else missing

    names = F.array_compact(F.array(*[F.when(F.coalesce(gone(c), F.lit(True)), F.lit(c)) for c in columns]))
    return df.select(F.array_join(names, "&").alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def distinct_with_value(df: DataFrame, by: str, entity: str, columns: dict[str, str]) -> DataFrame:
    """Distinct entities per group that have a value, per column.

    One row per (group, entity) first, so the distinct counts need no expansion.
    """
    per_entity = df.groupBy(by, entity).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(out) for out, c in columns.items()])
    return per_entity.groupBy(by).agg(*[F.sum(out).cast("long").alias(out) for out in columns])


def duplicate_headers(columns: DataFrame) -> DataFrame:
    """Names that occur more than once in a sheet after removing blanks and ``_duplicated_k``.

    ``columns``: ``workbook, sheet, column``.
    """
    clean = F.regexp_replace("column", r"(\s+)|(_duplicated_\d+$)", "")
    return (
        columns.select("workbook", "sheet", clean.alias("column")).groupBy("workbook", "sheet", "column")
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def redundant_headers(columns: DataFrame, min_sheets: int | None = None, share: float | None = None) -> DataFrame:
    """Names repeated over at least ``min_sheets`` sheets, or that share of a workbook's sheets."""
    if not (min_sheets or share):
        raise ValueError("min_sheets or share must be given")
    clean = F.trim(F.regexp_replace("column", r"(?U)\s+", " "))
    named = columns.select("workbook", "sheet", clean.alias("column")).filter(~F.col("column").contains("__UNNAMED__"))
    counts = named.groupBy("workbook", "column").agg(F.count(F.lit(1)).alias("n"))
    if not share:
        return counts.filter(F.col("n") >= min_sheets)
    sheets = columns.groupBy("workbook").agg(F.count_distinct("sheet").alias("_sheets"))
    return counts.join(sheets, "workbook").filter(F.col("n") >= share * F.col("_sheets")).drop("_sheets")


def only_in_one(columns: DataFrame, successive: DataFrame) -> DataFrame:
    """Columns of workbook ``a`` that workbook ``b`` lacks, for each listed pair.

    ``successive``: ``a, b``; ``columns``: ``workbook, column``.
    """
    names = columns.select("workbook", "column").distinct()
    left = successive.join(names, F.col("a") == F.col("workbook")).select("a", "b", "column")
    right = names.select(F.col("workbook").alias("b"), "column")
    return left.join(right, ["b", "column"], "left_anti").select("a", "b", "column")


def sheet_listing(columns: DataFrame) -> DataFrame:
    """Sheets of each workbook in order: ``workbook, sheet_no, sheet``."""
    sheets = columns.groupBy("workbook", "sheet").agg(F.min("sheet_no").alias("sheet_no"))
    return sheets.select("workbook", "sheet_no", "sheet")


def column_listing(columns: DataFrame) -> DataFrame:
    """Distinct cleaned column names of each workbook, first-seen order."""
    clean = F.trim(F.regexp_replace("column", r"(?U)\s+", " "))
    first = columns.select("workbook", "position", clean.alias("column")).filter(~F.col("column").contains("__UNNAMED__")).groupBy(
        "workbook", "column"
    ).agg(F.min("position").alias("position"))
    w = Window.partitionBy("workbook").orderBy("position")
    return first.select("workbook", (F.row_number().over(w) - 1).alias("row"), "column")


def large_discrepancy_share(df: DataFrame, base: str, other: str, by: list[str] = (), limit: float = 1.0) -> DataFrame:
    """Share of rows with both figures positive whose relative difference exceeds ``limit``."""
    diff = F.abs(F.col(other) - F.col(base)) / F.col(base)
    return df.filter((F.col(base) > 0) & (F.col(other) > 0)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((diff > limit).cast("double")).alias("large_share")
    )
