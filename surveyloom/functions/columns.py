"""Structured column names: ``column=X|sheet=Y|model=M|label=L|value=V``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions.fixed_values import COLUMN_PROPERTIES

JOIN, SEPARATOR, ANY_SHEET = "=", "|", "*"


def create_column(**props: Column | str) -> Column:
    """Name built from the given properties, in the order given; null ones are left out."""
    parts = []
    for key, value in props.items():
        value = value if isinstance(value, Column) else F.lit(value)
        parts.append(F.concat(F.lit(key + JOIN), value))
    return F.concat_ws(SEPARATOR, *parts)


def column_properties(name: Column) -> Column:
    """Map of properties; each pair is split at its first ``=`` only."""
    return F.str_to_map(name, F.lit("\\|"), F.lit(JOIN))


def column_property(name: Column, key: str) -> Column:
    return F.try_element_at(column_properties(name), F.lit(key))


def has_properties(name: Column, **props: str) -> Column:
    """True where every given property has the given value."""
    parsed = column_properties(name)
    hits = [F.coalesce(F.try_element_at(parsed, F.lit(k)) == F.lit(v), F.lit(False)) for k, v in props.items()]
    out = F.lit(True)
    for hit in hits:
        out = out & hit
    return out


def update_column(name: Column, **props: Column | str) -> Column:
    """Set properties, keep the others, and put ``value`` last."""
    parsed = column_properties(name)
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in props.items()}
    parts = []
    for key in COLUMN_PROPERTIES:
        value = given.get(key, F.try_element_at(parsed, F.lit(key)))
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(key + JOIN), value)))
    return F.concat_ws(SEPARATOR, *parts)


def clean_name(name: Column) -> Column:
    """Collapse white space (line and paragraph separators included) and trim."""
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def strip_line_breaks(name: Column) -> Column:
    return F.regexp_replace(name, "[\r\n]", "")


def is_unnamed(name: Column) -> Column:
    return name.contains("__UNNAMED__") | name.contains("column_")


def repeat_number(df: DataFrame, name: str, within: list[str], position: str, out: str, block: int = 100_000) -> DataFrame:
    """How many times the name occurred before, along a numeric position."""
    from surveyloom.operators.ordered import number_rows

    return number_rows(df, [*within, name], [position], F.floor(F.col(position) / block), out)


def make_unique(df: DataFrame, name: str, within: list[str], position: str, out: str | None = None) -> DataFrame:
    """Suffix ``_k`` on the k-th repeat of a name."""
    made = F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_k").cast("string")))
    return repeat_number(df, name, within, position, "_k").withColumn(out or name, made).drop("_k")


def number_repeats(df: DataFrame, name: str, within: list[str], position: str, out: str | None = None) -> DataFrame:
    """Like :func:`make_unique`, but adds a ``number=k`` property."""
    numbered = update_column(F.col(name), number=F.col("_k").cast("string"))
    made = F.when(F.col("_k") == 0, F.col(name)).otherwise(numbered)
    return repeat_number(df, name, within, position, "_k").withColumn(out or name, made).drop("_k")


def prefix_columns(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else prefix + c.replace(" ", "_") for c in df.columns])


def rename_by_code(df: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Rename headers that carry a known six-digit code."""
    import re

    names = []
    for c in df.columns:
        hit = re.search(r"\d{6}", c)
        names.append(codes.get(hit.group(0), c) if hit else c)
    return df.toDF(*names)


def tidy_indicator_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("model=", "").replace("|value=", "_") for c in df.columns])


def reorder_like(df: DataFrame, reference: DataFrame) -> DataFrame:
    return df.select(*reference.columns)


def rename_present(df: DataFrame, mapping: dict[str, str], strict: bool = False) -> DataFrame:
    """Rename; absent names are ignored unless ``strict``."""
    missing = [k for k in mapping if k not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k not in missing})


def add_year_label(df: DataFrame, year: int, label: str) -> DataFrame:
    """Year and label as first columns."""
    return df.select(F.lit(year).alias("year"), F.lit(label).alias("label"), *[c for c in df.columns if c not in ("year", "label")])
