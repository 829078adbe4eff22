"""Harmonising wording and values with rule tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveyloom.functions.rename_rules import KEY_HEADERS
from surveyloom.operators.ordered import join_keys
from surveyloom.session import literal_frame

#: Characters by which headers and rules are brought together.
GRAM = 3


def topic_of(header: Column, rules: tuple, year: Column | None = None, file: Column | None = None) -> Column:
    """Topic of the first rule that fits the year, the file name and the header; null for none.

    One ordered CASE expression, so it runs inside the scan stage without a join.
    """
    header, name = F.lower(header), F.lower(file) if file is not None else None
    out = None
    for years, file_pattern, header_pattern, topic in rules:
        cond = header.rlike(header_pattern)
        if file_pattern and name is not None:
            cond = name.rlike(file_pattern) & cond
        if years is not None and year is not None:
            cond = year.isin(*years) & cond
        out = F.when(cond, topic) if out is None else out.when(cond, topic)
    return out


def _alternatives(pattern: str) -> list[str]:
    """The parts between bars outside of groups."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def needed_texts(pattern: str) -> list[str]:
    """For each alternative of a pattern the longest text that every match of it holds; empty if there is none.

    Groups, classes and what a star, a question mark or a count makes optional are left out.
    """
    out = []
    for part in _alternatives(re.sub(r"^\(\?\w+\)", "", pattern)):
        pieces, piece, depth, i = [], "", 0, 0
        while i < len(part):
            c, step = part[i], 1
            if c == "\\" and i + 1 < len(part):
                step = 2
                c = part[i + 1] if not part[i + 1].isalnum() else ""
                literal = bool(c)
            else:
                literal = c not in ".^$*+?{}()[]|"
            if depth == 0 and literal:
                piece += c
            elif depth == 0 and part[i] in "*?{":
                pieces.append(piece[:-1])
                piece = ""
            else:
                pieces.append(piece)
                piece = ""
            if step == 1 and part[i] in "([{":
                depth += 1
            elif step == 1 and part[i] in ")]}":
                depth -= 1
            i += step
        out.append(max([*pieces, piece], key=len))
    return out


def rule_table(spark: SparkSession, rules: tuple) -> DataFrame:
    """``rule_no, rule_year, file_pattern, pattern, topic, piece, gram``: a row per rule, year and alternative.

    ``rule_year`` is null for a rule of all years.
    """
    rows = []
    for k, (years, file_pattern, pattern, topic) in enumerate(rules):
        for piece in dict.fromkeys(needed_texts(pattern)):
            rows += [(k, year, file_pattern, pattern, topic, piece, piece[:GRAM]) for year in (years or (None,))]
    return literal_frame(spark, rows, "rule_no int, rule_year int, file_pattern string, pattern string, topic string, piece string, gram string")


def topics_by_index(headers: DataFrame, rules: tuple) -> DataFrame:
    """``headers`` with ``topic``, as :func:`topic_of` finds it; null for none.

    Rules are a table under the first characters of a text that a match must hold, so a
    distinct header meets only those rules of its year that can fit, however many there
    are; only these patterns are tried. Rules that need no text of ``GRAM`` characters are
    tried on every header. ``headers`` has ``header`` and may have ``year`` and ``file``.
    """
    spark, keys = headers.sparkSession, [c for c in ("year", "file", "header") if c in headers.columns]
    open_rules = tuple((k, r) for k, r in enumerate(rules) if min(map(len, needed_texts(r[2]))) < GRAM)
    indexed = {k: r for k, r in enumerate(rules) if k not in dict(open_rules)}
    distinct = headers.select(*keys).distinct().filter(F.col("header").isNotNull()).withColumn("_low", F.lower("header"))
    chars = distinct.withColumn("_c", F.split("_low", ""))
    starts = F.sequence(F.lit(0), F.size("_c") - GRAM)
    gram = lambda i: F.concat(*[F.get("_c", i + j) for j in range(GRAM)])
    grams = chars.select(*keys, "_low", F.explode(F.when(F.size("_c") >= GRAM, F.array_distinct(F.transform(starts, gram)))).alias("gram"))
    table = rule_table(spark, tuple(indexed.values())).withColumn("rule_no", F.get(F.array(*[F.lit(k) for k in indexed] or [F.lit(0)]), F.col("rule_no")))
    fits = F.contains(F.col("_low"), F.col("piece")) & F.rlike(F.col("_low"), F.col("pattern"))
    if "year" in keys:
        fits = fits & (F.col("rule_year").isNull() | (F.col("rule_year") == F.col("year")))
    if "file" in keys:
        fits = fits & ((F.col("file_pattern") == "") | F.rlike(F.lower("file"), F.col("file_pattern")))
    found = grams.join(table, "gram").filter(fits).select(*keys, F.struct("rule_no", "topic").alias("r"))
    if open_rules:
        tried = [F.when(topic_of(F.col("header"), (r,), F.col("year") if "year" in keys else None, F.col("file") if "file" in keys else None).isNotNull(),
                        F.struct(F.lit(k).alias("rule_no"), F.lit(r[3]).alias("topic"))) for k, r in open_rules]
        found = found.unionByName(distinct.select(*keys, F.explode(F.array_compact(F.array(*tried))).alias("r")))
    first = found.groupBy(*keys).agg(F.min("r").alias("r")).select(*keys, F.col("r.topic").alias("topic"))
    return join_keys(headers, first, keys, "left")


def key_headers(headers: DataFrame, keys: tuple = KEY_HEADERS) -> DataFrame:
    """Canonical key per header: the first matching header of a file, or all of them.

    ``headers``: ``file, header, position``.
    """
    hits = F.array(*[
        F.struct(F.lit(topic).alias("topic"), F.lit(first).alias("first_only"), F.lower("header").rlike(pattern).alias("hit"))
        for topic, pattern, first in keys
    ])
    matched = headers.select("*", F.explode(F.filter(hits, lambda h: h["hit"])).alias("h")).select(
        "file", "header", "position", "h.topic", "h.first_only"
    )
    first = matched.groupBy("file", "topic").agg(F.min("position").alias("_first"))
    kept = matched.join(first, ["file", "topic"]).filter(~F.col("first_only") | (F.col("position") == F.col("_first")))
    return kept.select("file", "header", "position", "topic")


def rename_headers(headers: DataFrame, rules: tuple, keys: tuple = KEY_HEADERS) -> DataFrame:
    """``file, header, position, topic``: key headers first, then the topic rules, else the header itself."""
    named = key_headers(headers, keys).groupBy("file", "position").agg(F.min("topic").alias("key_topic"))
    return (
        topics_by_index(headers.join(named, ["file", "position"], "left"), rules)
        .withColumn("topic", F.coalesce("key_topic", "topic", F.lower("header")))
        .drop("key_topic")
    )


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, year: str, fields: dict[str, str]) -> DataFrame:
    """Set ``field`` to ``value`` where key and year range match; a null value clears the field.

    ``overrides``: ``key, year_from, year_to, field, value`` with closed ranges
    inside the panel's years; later rows (``rank``) win. ``fields`` maps a field
    name to its SQL type.
    """
    per_year = (
        overrides.select(F.col("key").alias("_set_key"), "rank", "field", "value", F.explode(F.sequence("year_from", "year_to")).alias("_set_year"))
        .groupBy("_set_key", "_set_year")
        .agg(*[
            F.max_by(F.struct("value"), F.when(F.col("field") == f, F.col("rank"))).alias("_new_" + f) for f in fields
        ])
    )
    out = df.join(per_year, (F.col(key) == F.col("_set_key")) & (F.col(year) == F.col("_set_year")), "left")
    for f, sql_type in fields.items():
        new = F.col("_new_" + f)
        out = out.withColumn(f, F.when(new.isNotNull(), new["value"].try_cast(sql_type)).otherwise(F.col(f)))
    return out.drop("_set_key", "_set_year", *["_new_" + f for f in fields])
