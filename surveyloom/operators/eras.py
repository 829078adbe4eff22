"""Yearly figures whose tagging changed between survey eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions import cells, fixed_values as V
from surveyloom.operators.condense import condense


def tagged_mean(value: Column, tag: Column, tag_text: str) -> Column:
    """Mean over the rows with the tag; null when the tag does not occur."""
    return F.avg(F.when(tag == tag_text, value))


def era_mean(
    value: Column, which_year: Column, year: Column, tagged: tuple[str, ...] = ("Reporting year", "Row 1"),
    tagged_years: tuple[int, int] = (2018, 2020), dated_years: tuple[int, int] | None = (2010, 2016),
    plain_years: tuple[int, ...] = (2017,),
) -> Column:
    """Aggregate expression for one figure of a (year, account) group.

    Tagged era: mean over the first tag that occurs at all. Dated era: rows whose
    accounting date lies in the year before. Plain era: the same with a bare year.
    """
    value = cells.as_double(value)
    tag_branch = F.lit(None).cast("double")
    for tag in reversed(tagged):
        tag_branch = F.when(F.coalesce(F.max((which_year == tag).cast("int")), F.lit(0)) == 1, tagged_mean(value, which_year, tag)).otherwise(tag_branch)
    out = F.when(F.max(year).between(*tagged_years), tag_branch)
    if dated_years:
        # Only rows of the dated years are parsed.
        stated = F.when(year.between(*dated_years), F.year(cells.parse_date(which_year, "d MMM yyyy")))
        out = out.when(F.max(year).between(*dated_years), F.avg(F.when(stated == year - 1, value)))
    if plain_years:
        stated = F.when(year.isin(*plain_years), cells.as_double(which_year))
        out = out.when(F.max(year).isin(*plain_years), F.avg(F.when(stated == year - 1, value)))
    return out


def category_sum(value: Column, category: Column, year: Column, seen: tuple, summed: tuple, years: tuple[int, ...] = (2010, 2018, 2019, 2020)) -> Column:
    """Sum over named categories; null when the year or none of the categories applies."""
    any_seen = F.coalesce(F.max(category.isin(*seen).cast("int")), F.lit(0)) == 1
    total = F.sum(F.when(category.isin(*summed), cells.as_double(value)))
    return F.when(F.max(year).isin(*years) & any_seen, F.coalesce(total, F.lit(0.0)))


EMISSION_COLUMNS = (
    "scope1", "scope1_which_year", "scope2", "scope2_loc", "scope2_market", "scope2_which_year", "scope3", "scope3_which_category",
)


def distinct_first(rows: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """Rows that repeat both key and figures once, so that a figure filed twice weighs once."""
    return rows.select(*dict.fromkeys([*keys, *figures])).distinct()


def emission_figures(rows: DataFrame, keys: list[str] = ("year", "account no")) -> DataFrame:
    """Scope 1, 2 and 3 figures of each (year, account), over rows that differ in name or figures."""
    c = F.col
    named = ["name"] if "name" in rows.columns else []
    rows = distinct_first(rows, [*keys, *named], EMISSION_COLUMNS)
    year = c(keys[0])
    s1, s2 = c("scope1_which_year"), c("scope2_which_year")
    scope2 = F.coalesce(
        era_mean(c("scope2"), s2, year, tagged=("Row 1",), dated_years=(2010, 2010), plain_years=()),
        era_mean(c("scope2"), s1, year, tagged=(), dated_years=(2011, 2015), plain_years=()),
    )
    return rows.groupBy(*keys).agg(
        era_mean(c("scope1"), s1, year).alias("scope1"),
        scope2.alias("scope2"),
        era_mean(c("scope2_loc"), s2, year, dated_years=(2016, 2016)).alias("scope2_loc"),
        era_mean(c("scope2_market"), s2, year, dated_years=(2016, 2016)).alias("scope2_market"),
        category_sum(c("scope3"), c("scope3_which_category"), year, V.SCOPE3_UPSTREAM_SEEN, V.SCOPE3_UPSTREAM_SUMMED).alias("scope3_upstream"),
        category_sum(c("scope3"), c("scope3_which_category"), year, V.SCOPE3_DOWNSTREAM_SEEN, V.SCOPE3_DOWNSTREAM_SUMMED).alias("scope3_downstream"),
    )


def with_fallback(df: DataFrame, keys: list[str], specific: dict[str, str], order: list[str], extra: dict[str, str] | None = None) -> DataFrame:
    """Condensed specific field, or the condensed generic field where the specific one is empty.

    ``specific`` maps an output column (and source) to its generic source.
    """
    generics = {f"_generic_{g}": g for g in specific.values()}
    columns = {**{s: s for s in specific}, **generics, **(extra or {})}
    out = condense(df, keys, columns, order)
    chosen = [F.coalesce(F.col(s), F.col(f"_generic_{g}")).alias(s) for s, g in specific.items()]
    return out.select(*keys, *chosen, *(extra or {}))


VERIFICATION_FALLBACK = {
    f"verification_{scope}_{part}": f"verification_{part}"
    for scope in ("s1", "s2") for part in ("quality", "standard", "percent")
}


def verification_summary(rows: DataFrame, keys: list[str], order: list[str], others: list[str]) -> DataFrame:
    """Verification answers per (year, account), scope-specific first."""
    return with_fallback(rows, keys, VERIFICATION_FALLBACK, order, {c: c for c in others})
