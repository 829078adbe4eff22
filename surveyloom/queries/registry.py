"""Name -> Spark query, and name -> the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Two-decimal amount as an exact number, so that sums do not depend on row order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def number(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
