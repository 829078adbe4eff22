"""Reading sheet tables and configs, writing results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from surveyloom.functions import cells, fixed_values as V

CONFIG = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("join", T.StringType()),
    T.StructField("sheets", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))),
    T.StructField("merges", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("redundant", T.ArrayType(T.StringType())),
    T.StructField("drop", T.ArrayType(T.StringType())),
    T.StructField("renames", T.MapType(T.StringType(), T.StringType())),
])


def decoded(c: Column) -> Column:
    """A percent-encoded name as it is; a plus sign stands for itself."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def file_name() -> Column:
    return decoded(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def _csv(spark: SparkSession, multi_line: bool):
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with header; text columns unless a schema is given (types are never guessed by a scan).

    All files have the same header; :func:`read_csv_by_name` takes differing ones.
    ``multi_line``: cells may hold line breaks, for which a file is read by one task.
    """
    reader = _csv(spark, multi_line)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def csv_layouts(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """Files by header line. Only the first block of each file is read; names reach the driver."""
    start = F.col("_metadata.file_block_start") == 0
    name = decoded(F.col("_metadata.file_path"))
    lines = spark.read.text(path).filter(start).select(name.alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    headers = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    listed = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [r.files for r in listed.orderBy("header").collect()]


def read_csv_by_name(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, each: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """CSV files whose headers may differ, stacked by column name; a file lacks what its header lacks.

    One scan per distinct header. ``each`` is applied to every layout before the rows are
    stacked, where a rule depends on the place of a column.
    """
    parts = [each(_csv(spark, multi_line).csv(files)) for files in csv_layouts(spark, path)]
    if not parts:
        raise ValueError(f"no CSV file in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet files stacked by column name; a file may lack columns that others have."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_sheets(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Sheet tables laid out as ``.../<label>/<year>/<sheet no>_<sheet>.<ext>``, tagged by their path, stacked by column name."""
    part = lambda i: F.regexp_extract(F.input_file_name(), r"([^/]+)/(\d{4})/(\d+)_([^/]+)\.[^./]+$", i)

    def tagged(df: DataFrame) -> DataFrame:
        return df.select(
            part(2).cast("int").alias("year"), part(1).alias("label"), part(3).cast("int").alias("sheet_no"), decoded(part(4)).alias("sheet"), "*"
        )

    return read_csv_by_name(spark, path, multi_line, tagged) if fmt == "csv" else tagged(read_parquet(spark, path))


def read_survey_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """All columns as text, first column of each file dropped, names in lower case, year and file name from the path; stacked by name."""
    def one_layout(df: DataFrame) -> DataFrame:
        name = file_name()
        year = F.regexp_extract(name, r"(\d{4})", 1).cast("int")
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c.lower()) for c in df.columns[1:]], year.alias("year"), name.alias("filename"))

    return read_csv_by_name(spark, path, multi_line, one_layout)


def read_with_nulls(spark: SparkSession, path: str | list[str], tokens: tuple[str, ...] = V.NULL_TOKENS, multi_line: bool = False) -> DataFrame:
    """CSV in which the given cell texts mean null; stacked by name."""
    df = read_csv_by_name(spark, path, multi_line)
    return df.select(*[cells.null_if_in(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns])


def select_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths below a folder whose name matches the pattern, case ignored (a listing, no content)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = decoded(F.regexp_extract("path", r"([^/]+)$", 1))
    return [r.path for r in listing.filter(name.rlike("(?i)" + pattern)).collect()]


def read_selected(spark: SparkSession, folder: str, pattern: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Files below a folder whose name matches the pattern, case ignored, of one layout.

    The condition is on the file's metadata, so Spark passes over the other files, and no
    list of paths is made.
    """
    reader = spark.read.format(fmt).option("recursiveFileLookup", True)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).load(folder)
    return df.filter(F.col("_metadata.file_name").rlike("(?i)" + pattern))


def read_workbooks(spark: SparkSession, path: str, labels: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """What :func:`write_workbooks` wrote; only the folders of the given labels and years are listed and read."""
    df = spark.read.option("basePath", path).parquet(path)
    if labels is not None:
        df = df.filter(F.col("label").isin(list(labels)))
    return df if years is None else df.filter(F.col("year").isin(list(years)))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Workbook configuration, one record per (label, year)."""
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Exchange rates as ``year, currency, rate`` from one column per currency."""
    from surveyloom.operators.bands import rate_table

    return rate_table(read_csv(spark, path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """zstd parquet; column statistics stay on, since they let later scans skip row groups."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_workbooks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_parquet(df, path, mode, ("label", "year"))


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    write_parquet(df, path, mode, ("model",))


def write_ids(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Distinct non-null ids, one per line."""
    df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().write.mode(mode).text(path)
