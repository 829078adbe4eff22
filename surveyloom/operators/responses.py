"""Long response model: one row per (workbook, key, sheet, column, position)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from surveyloom.functions.cells import as_double
from surveyloom.functions.columns import ANY_SHEET, clean_name, create_column
from surveyloom.operators.ordered import number_rows
from surveyloom.session import literal_frame

BLOCK_ROWS = 100_000


def filter_sheets(sheets: DataFrame, config: DataFrame) -> DataFrame:
    """Keep the sheets whose number lies in a configured inclusive range.

    ``config``: ``year, label, sheets ARRAY<STRUCT<lo, hi>>``.
    """
    wanted = (
        config.select("year", "label", F.explode("sheets").alias("r"))
        .select("year", "label", F.explode(F.sequence("r.lo", "r.hi")).alias("sheet_no"))
        .distinct()
    )
    return sheets.join(wanted, ["year", "label", "sheet_no"], "left_semi")


def sheet_to_long(
    sheet: DataFrame, name: str, key: str, row_no: str, block_rows: int = BLOCK_ROWS, order: list[str] = ()
) -> DataFrame:
    """One sheet as ``key, sheet, column, pos, value``; nulls are kept, order is kept.

    Rows of a key are numbered block by block, so one key may hold any share of
    the sheet.
    """
    questions = [c for c in sheet.columns if c not in (key, row_no)]
    block = F.floor(F.col(row_no) / block_rows)
    rows = number_rows(sheet.withColumn(key, F.col(key).cast("string")).withColumnRenamed(key, "key"), ["key"], [row_no, *order], block)
    cells = F.array(*[F.struct(clean_name(F.lit(c)).alias("column"), F.col(c).cast("string").alias("value")) for c in questions])
    return (
        rows.select("key", clean_name(F.lit(name)).alias("sheet"), "pos", F.explode(cells).alias("cell"))
        .select("key", "sheet", "cell.column", "pos", "cell.value")
    )


def join_workbook(sheets: dict[str, DataFrame], key: str, row_no: str) -> DataFrame:
    """All sheets of a workbook that carry the key, in long form.

    The full outer join of the sheets is implied: a key is present as soon as one
    sheet has it, and a sheet that lacks it has no rows.
    """
    parts = [sheet_to_long(df, name, key, row_no) for name, df in sheets.items() if key in df.columns]
    return reduce(DataFrame.unionByName, parts)


def to_lists(long: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide sink: one row per key, one ordered ``ARRAY<STRING>`` per listed column.

    A list is one cell of one row; where a key may hold very many rows, keep the long
    form, which has no such cell.
    """
    entry = F.struct("pos", "value")
    aggs = []
    for c in columns:
        cell = F.sort_array(F.collect_list(F.when(F.col("column") == c, entry)))
        aggs.append(F.when(F.size(cell) > 0, cell.getField("value")).alias(c))
    return long.filter(F.col("column").isin(*columns)).groupBy(*keys).agg(*aggs)


def structured_column(column: Column, sheet: Column | None = None, value: str = "response") -> Column:
    return create_column(column=column, sheet=sheet if sheet is not None else ANY_SHEET, value=value)


def unpivot(df: DataFrame, keys: list[str], columns: list[str] | None = None, name: str = "column", value: str = "value") -> DataFrame:
    """Columns to rows as text; column number is kept as ``col_pos``."""
    columns = columns or [c for c in df.columns if c not in keys]
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias(name), F.col(c).cast("string").alias(value))
        for i, c in enumerate(columns)
    ])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, f"_c.col_pos", f"_c.{name}", f"_c.{value}")


def headers(df: DataFrame, workbook: str) -> DataFrame:
    """Column list of a frame as rows, with the number of filled cells."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return unpivot(counts, []).select(
        F.lit(workbook).alias("workbook"), "column", F.col("col_pos").alias("position"), F.col("value").cast("long").alias("filled")
    )


def columns_to_drop(columns: DataFrame, patterns: list[str], keep_first: bool) -> DataFrame:
    """Columns of each workbook that match a pattern from the start, case ignored.

    With ``keep_first`` the first match by position of each pattern stays.
    ``columns``: ``workbook, column, position``.
    """
    hits = F.filter(
        F.array(*[F.struct(F.lit(i).alias("k"), F.col("column").rlike(f"(?i)^(?:{p})").alias("hit")) for i, p in enumerate(patterns)]),
        lambda x: x["hit"],
    )
    matched = columns.select("workbook", "column", "position", F.explode(hits).alias("h")).select("workbook", "column", "position", "h.k")
    if keep_first:
        w = Window.partitionBy("workbook", "k").orderBy("position")
        matched = matched.withColumn("r", F.row_number().over(w)).filter("r > 1")
    return matched.select("workbook", "column").distinct()


def drop_columns(columns: DataFrame, redundant: list[str] = (), drop: list[str] = ()) -> DataFrame:
    """Column list left after dropping redundant, unwanted, unnamed and empty columns.

    ``columns``: ``workbook, column, position, filled``.
    """
    out = columns
    if redundant:
        out = out.join(columns_to_drop(out, list(redundant), True), ["workbook", "column"], "left_anti")
    if drop:
        out = out.join(columns_to_drop(out, list(drop), False), ["workbook", "column"], "left_anti")
    unnamed = F.col("column").contains("__UNNAMED__") | F.col("column").contains("column_")
    return out.filter(~unnamed & (F.col("filled") > 0))


def union_layouts(frames: list[DataFrame], schema: list[str] | None = None) -> DataFrame:
    """Stack frames with differing columns as text; fixed output schema if given."""
    as_text = [f.select(*[F.col(c).cast("string").alias(c) for c in f.columns]) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), as_text)
    if schema is None:
        return out
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in schema])


def process_workbook(
    sheets: dict[str, DataFrame], year: int, label: str, key: str, row_no: str = "row_no",
    renames: dict[str, str] | None = None, redundant: list[str] = (), drop: list[str] = (),
) -> DataFrame:
    """Clean, rename and prune one workbook; result in long form with year and label."""
    long = join_workbook(sheets, key, row_no)
    long = long.withColumn("value", F.trim(F.regexp_replace("value", r"(?U)\s+", " ")))
    if renames:
        table = literal_frame(long.sparkSession, list(renames.items()), "column string, _new string")
        long = long.join(table, "column", "left").withColumn("column", F.coalesce("_new", "column")).drop("_new")
    names = [
        (i, c) for i, c in enumerate(dict.fromkeys(q for s in sheets.values() for q in s.columns if q not in (key, row_no)))
    ]
    order = literal_frame(long.sparkSession, names, "position int, raw string").select("position", clean_name(F.col("raw")).alias("column"))
    if renames:
        order = order.join(table, "column", "left").select("position", F.coalesce("_new", "column").alias("column"))
    filled = long.groupBy("column").agg(F.count("value").alias("filled"))
    columns = filled.join(order.groupBy("column").agg(F.min("position").alias("position")), "column").withColumn("workbook", F.lit(f"{year}_{label}"))
    kept = drop_columns(columns, redundant, drop).select("column")
    return long.join(kept, "column", "left_semi").select(
        F.lit(year).cast("int").alias("year"), F.lit(label).alias("label"), "key", "sheet", "column", "pos", "value"
    )


RESPONSES = T.StructType([
    T.StructField("account_no", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("respondent", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("value", T.StringType()),
])


def auto_types(long: DataFrame) -> DataFrame:
    """Per column: whether it is scalar, and whether every value is a number.

    ``long``: ``key, column, pos, value``. One pass gives the facts from which a
    wide sink picks scalar or list, number or text.
    """
    per_cell = long.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("v"), F.count(as_double(F.col("value"))).alias("num")
    )
    return per_cell.groupBy("column").agg(
        (F.max("n") == 1).alias("is_scalar"),
        (F.sum("v") == F.sum("num")).alias("is_numeric"),
        F.sum("v").alias("n_values"),
    )


def typed_table(long: DataFrame, keys: list[str], column: str = "column") -> tuple[DataFrame, dict[str, str]]:
    """(one row per key with a typed column per question, the types by column).

    ``long``: ``*keys, column, pos, value``. The facts of :func:`auto_types` are found
    first, one row per question; from them follows the schema: a question that never has
    two rows for a key becomes a single value, others a list in order of ``pos`` (nulls
    stay in it); values become numbers where every one of them is one. A question
    without any value is a text. Null keys are a key.
    """
    cell = long.select(F.struct(*keys).alias("key"), F.col(column).alias("column"), "value")
    facts = {r["column"]: r for r in auto_types(cell).orderBy("column").collect()}
    types, aggs = {}, []
    for name, f in facts.items():
        kind = "double" if f["is_numeric"] and f["n_values"] else "string"
        value = as_double(F.col("value")) if kind == "double" else F.col("value")
        here = F.col(column) == name
        if f["is_scalar"]:
            types[name] = kind
            aggs.append(F.max(F.when(here, value)).alias(name))
        else:
            types[name] = f"array<{kind}>"
            listed = F.sort_array(F.collect_list(F.when(here, F.struct("pos", value.alias("value"))))).getField("value")
            aggs.append(F.when(F.size(listed) > 0, listed).alias(name))
    if not aggs:
        return long.select(*keys).distinct(), types
    return long.groupBy(*keys).agg(*aggs), types
