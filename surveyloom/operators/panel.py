"""Panel joins, grids, fills, lags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


# -- joins -------------------------------------------------------------------
def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", null_keys: str = "skip") -> DataFrame:
    """Equi join with coalesced keys; ``null_keys='match'`` lets null keys meet each other."""
    if null_keys == "skip":
        return left.join(right, keys, how)
    renamed = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    out = left.join(renamed, [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys], how)
    if how in ("left_semi", "left_anti"):
        return out
    rest = [c for c in out.columns if c not in keys and c not in ["_r_" + k for k in keys]]
    return out.select(*[F.coalesce(k, "_r_" + k).alias(k) for k in keys], *rest)


def full_join_all(frames: list[DataFrame], keys: list[str], null_keys: str = "skip") -> DataFrame:
    return reduce(lambda a, b: join_on(a, b, keys, "full", null_keys), frames)


def stack_sources(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Union of several keyed sources, absent columns null, with a source rank.

    For condensing, a union followed by one aggregation gives the same groups as
    a chain of full outer joins, and needs one shuffle instead of one per join.
    """
    ranked = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def first_match(df: DataFrame, lookup: DataFrame, key: str | list[str], values: list[str], order: str | Column) -> DataFrame:
    """Left lookup that takes the first row of ``lookup`` (by ``order``) per key."""
    keys = [key] if isinstance(key, str) else list(key)
    first = (
        lookup.dropna(subset=keys).groupBy(*keys)
        .agg(F.min_by(F.struct(*values), order).alias("_first")).select(*keys, "_first.*")
    )
    return df.join(first, keys, "left")


def fallback_lookup(df: DataFrame, target: str, lookups: list[tuple[DataFrame, str | list[str], str, str]]) -> DataFrame:
    """Fill ``target`` where still null from lookups tried in turn: (frame, key, value, order)."""
    out = df
    for frame, key, value, order in lookups:
        found = frame.withColumnRenamed(value, "_found")
        out = first_match(out, found, key, ["_found"], order)
        out = out.withColumn(target, F.coalesce(target, "_found")).drop("_found")
    return out


def union_by_keys(df: DataFrame, routes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left join ``df`` by each route where all its keys are known, add the rows that
    lack a key of any route, and keep distinct rows."""
    parts, incomplete = [], F.lit(False)
    for right, keys in routes:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        parts.append(df.filter(known).join(right.dropna(subset=keys), keys, "left"))
        incomplete = incomplete | ~known
    parts.append(df.filter(incomplete))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()


def fill_from(df: DataFrame, lookup: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """Replace ``value`` by the lookup's value under a normalised key where it has one."""
    first = lookup.groupBy(key.alias("_key")).agg(F.min_by(F.col(value), order).alias("_found"))
    out = df.withColumn("_key", key).join(first, "_key", "left")
    return out.withColumn(value, F.coalesce("_found", value)).drop("_key", "_found")


def overwrite_columns(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``other`` replace those of the same name; rows are matched by key."""
    common = [c for c in other.columns if c in df.columns and c not in keys]
    return df.drop(*common).join(other, keys, "left").select(*df.columns, *[c for c in other.columns if c not in df.columns])


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``; the key list is made distinct first."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def within(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def attach_first(df: DataFrame, attributes: DataFrame, key: str, order: str) -> DataFrame:
    """One row of attributes per key, the first by ``order``."""
    return first_match(df, attributes, key, [c for c in attributes.columns if c not in (key, order)], order)


# -- grid and fill -----------------------------------------------------------
def year_grid(df: DataFrame, key: str, year: str, first: int, last: int) -> DataFrame:
    """Every key of ``df`` with every year of the range, the rows of ``df`` joined back."""
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year)
    grid = df.select(key).filter(F.col(key).isNotNull()).distinct().select(key, years)
    return grid.join(df, [key, year], "left")


def fill(df: DataFrame, columns: list[str], key: list[str], order: str, direction: str = "updown") -> DataFrame:
    """Fill nulls inside a key along ``order``: ``down``, ``up``, ``downup`` or ``updown``.

    ``updown`` takes the value from below first, then from above. Rows that share
    a key and an order value share a fill value. The window runs over one row per
    (key, order value), so its size is the number of years, whatever number of
    rows a key holds.
    """
    if direction not in ("down", "up", "downup", "updown"):
        raise ValueError(direction)
    known = df.groupBy(*key, order).agg(*[F.max(c).alias(c) for c in columns])
    w = Window.partitionBy(*key).orderBy(order)
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    below = w.rowsBetween(0, Window.unboundedFollowing)

    def filled(c: str) -> Column:
        down, up = F.last(c, ignorenulls=True).over(above), F.first(c, ignorenulls=True).over(below)
        return {"down": down, "up": up, "downup": F.coalesce(down, up), "updown": F.coalesce(up, down)}[direction]

    values = known.select(*[F.col(k).alias("_k_" + k) for k in [*key, order]], *[filled(c).alias("_f_" + c) for c in columns])
    out = df.join(values, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in [*key, order]], "left")
    return out.select(*[F.coalesce(c, "_f_" + c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_panel(df: DataFrame, columns: list[str], key: list[str], order: str, direction: str = "updown") -> DataFrame:
    """:func:`fill` for a panel that already has one row per (key, order value)."""
    w = Window.partitionBy(*key).orderBy(order)
    above = w.rowsBetween(Window.unboundedPreceding, 0)
    below = w.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for c in columns:
        down, up = F.last(c, ignorenulls=True).over(above), F.first(c, ignorenulls=True).over(below)
        out[c] = {"down": down, "up": up, "downup": F.coalesce(down, up), "updown": F.coalesce(up, down)}[direction]
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


# -- lags --------------------------------------------------------------------
def lag_growth(df: DataFrame, measures: list[str], key: list[str], order: str, direction: str = "lag") -> DataFrame:
    """Neighbouring year's value ``next_<m>`` and ``growth_<m> = (next - m) / m``.

    ``direction='lag'`` takes the year before, ``'lead'`` the year after. One row
    per (key, year) is expected.
    """
    w = Window.partitionBy(*key).orderBy(order)
    shift = F.lag if direction == "lag" else F.lead
    out = df
    for m in measures:
        out = out.withColumn("next_" + m, shift(m).over(w))
    for m in measures:
        out = out.withColumn("growth_" + m, F.when(F.col(m) != 0, (F.col("next_" + m) - F.col(m)) / F.col(m)))
    return out


def percent_change(df: DataFrame, measure: str, key: list[str], order: str, out: str) -> DataFrame:
    """Change against the row before, relative to it."""
    before = F.lag(measure).over(Window.partitionBy(*key).orderBy(order))
    return df.withColumn(out, F.when(before != 0, F.col(measure) / before - 1))


def pair_differences(df: DataFrame, keys: list[str], respondent: str, pair: tuple[str, str], measures: list[str]) -> DataFrame:
    """Difference of each measure between two respondent kinds, where both are given and differ.

    One row per (key, respondent kind) is expected. Result: ``*keys, variable, difference``.
    """
    long = df.unpivot([*keys, respondent], measures, "variable", "value")
    wide = long.groupBy(*keys, "variable").pivot(respondent, list(pair)).agg(F.max("value"))
    both = wide.dropna(subset=list(pair)).withColumn("difference", F.col(pair[0]) - F.col(pair[1]))
    return both.filter("difference <> 0").select(*keys, "variable", "difference")


def account_slice(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows of the accounts whose position in ascending id order lies in the range.

    Only the first ``last`` distinct ids are ordered.
    """
    wanted = df.select(key).distinct().orderBy(key).offset(first).limit(last - first)
    return df.join(wanted, key, "left_semi")
