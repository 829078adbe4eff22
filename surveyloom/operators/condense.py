"""Condensing repeated answers to one text per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def condense(df: DataFrame, keys: list[str], columns: dict[str, list[str] | str], order: list[str], sep: str = ", ") -> DataFrame:
    """Distinct non-null values per group, first-seen order, joined by ``sep``; null for none.

    ``columns`` maps an output name to one or several source columns, which are
    read as one list (source by source, each in row order; rows that tie in the
    order follow the value). Values are made
    distinct by a combining aggregation before anything is collected, so a key
    with many rows sends each of its values once.
    """
    sources = {out: [src] if isinstance(src, str) else list(src) for out, src in columns.items()}
    cells = F.array(*[
        F.struct(F.lit(out).alias("out"), F.lit(i).alias("rank"), F.col(c).cast("string").alias("value"))
        for out, srcs in sources.items() for i, c in enumerate(srcs)
    ])
    # One empty entry per row keeps groups without any value.
    present = F.array(F.struct(F.lit("").alias("out"), F.lit(0).alias("rank"), F.lit("").alias("value")))
    # A single order column stays a plain value, so that its minimum fits a hash aggregation.
    row = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    seen = (
        df.select(*keys, row.alias("_row"), F.explode(F.concat(present, cells)).alias("_c")).filter(F.col("_c.value").isNotNull())
        .groupBy(*keys, F.col("_c.out").alias("_out"), F.col("_c.rank").alias("_rank"), F.col("_c.value").alias("_value"))
        .agg(F.min("_row").alias("_first"))
    )
    aggs = []
    for out in sources:
        entry = F.when(F.col("_out") == out, F.struct("_rank", "_first", "_value"))
        listed = F.array_distinct(F.sort_array(F.collect_list(entry)).getField("_value"))
        aggs.append(F.when(F.size(listed) > 0, F.array_join(listed, sep)).alias(out))
    return seen.groupBy(*keys).agg(*aggs)


def coalesce_duplicates(long: DataFrame, keys: list[str], topic: str = "topic", value: str = "value", position: str = "position") -> DataFrame:
    """First non-null value by column position for headers that became the same topic."""
    return long.filter(F.col(value).isNotNull()).groupBy(*keys, topic).agg(F.min_by(value, position).alias(value))


def list_conflicts(df: DataFrame, key: str, ids: str, min_ids: int = 2) -> DataFrame:
    """Keys that carry several ids, with their number and the ids in ascending order."""
    return (
        df.filter(F.col(ids).isNotNull()).select(key, ids).distinct()
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_ids"), F.array_join(F.sort_array(F.collect_list(F.col(ids).cast("string"))), ", ").alias("ids"))
        .filter(F.col("n_ids") >= min_ids)
    )


def frequency(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(out))


def theme_counts(df: DataFrame, text: str) -> DataFrame:
    """Counts of ``main: theme`` entries in comma lists, letters and digits only."""
    item = F.explode(F.split(text, ",")).alias("item")
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    themes = df.select(item).select(F.trim("item").alias("item")).filter(F.col("item").contains(":")).select(
        F.concat_ws(": ", clean(F.regexp_replace("item", ":.*", "")), clean(F.regexp_replace("item", r".*:\s*", ""))).alias("theme")
    )
    return frequency(themes, "theme")


def split_rows(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    return df.withColumn(column, F.explode(F.split(column, sep))).withColumn(column, F.trim(column))


def top_and_bottom(df: DataFrame, order: list, n: int, m: int | None = None) -> DataFrame:
    """Best ``n`` and worst ``m`` rows by the given order expressions."""
    best = df.orderBy(*[o.desc() for o in order]).limit(n).withColumn("end", F.lit("top"))
    worst = df.orderBy(*[o.asc() for o in order]).limit(m or n).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst)


