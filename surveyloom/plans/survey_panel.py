"""Sheet files -> condensed survey panel -> panel with reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions import cells, columns as C, fixed_values as V
from surveyloom.operators import condense, eras, panel, resolve, responses, rules

KEYS = ["year", "account no"]
FIRST_YEAR, LAST_YEAR = 2009, 2019

TARGET_FIELDS = (
    "active_target", "absolute_target_scope", "science_based_absolute_target", "absolute_target_comment", "intensity_target_scope",
    "science_based_intensity_target", "intensity_target_comment", "why_no_target", "reduction_initiatives", "why_no_initiatives",
    "initiative_type", "payback_period", "initiative_details",
)
VERIFICATION_EXTRAS = ("verification_s3_percent", "change_reason", "change_dir", "change_detail", "change_%", "change_mtco2e", "excluded_sources", "excluded_reason")
INDUSTRY_FIELDS = ("primary industry", "primary activity", "primary sector", "primary questionnaire sector", "activities", "sectors", "industries")


def topic_cells(sheet_cells: DataFrame, rule_table: tuple) -> DataFrame:
    """Cells of survey files under their topic, first column wins where several became one topic.

    ``sheet_cells``: ``file, year, row_no, header, position, value``. Headers are
    renamed once per file and joined back.
    """
    headers = sheet_cells.select("file", "year", "position", "header").distinct()
    named = rules.rename_headers(headers, rule_table).select("file", "position", "topic")
    return condense.coalesce_duplicates(sheet_cells.join(named, ["file", "position"]), ["file", "year", "row_no"])


def topic_rows(cells_long: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """One row per file row with one column per listed topic."""
    wide = cells_long.groupBy("file", "year", "row_no").pivot("topic", ["account no", *topics]).agg(F.first("value"))
    return wide.filter(F.col("account no").isNotNull())


def targets(rows: DataFrame) -> DataFrame:
    return condense.condense(rows, KEYS, {c: c for c in TARGET_FIELDS if c in rows.columns}, ["file", "row_no"])


def verification(rows: DataFrame) -> DataFrame:
    return eras.verification_summary(rows, KEYS, ["file", "row_no"], [c for c in VERIFICATION_EXTRAS if c in rows.columns])


def survey_panel(sources: dict[str, DataFrame], fields: dict[str, list[str]], order: list[str] = ("_source",)) -> DataFrame:
    """Keyed source tables -> one condensed row per (year, account).

    The sources are stacked and condensed in one aggregation, which gives the
    groups of a chain of full outer joins without the joins. ``fields`` maps an
    output column to the source columns that feed it.
    """
    cleaned = {
        name: df.select(*[cells.ampersand_to_and(F.col(f"`{c}`")).alias(c) if c in INDUSTRY_FIELDS else F.col(f"`{c}`") for c in df.columns])
        for name, df in sources.items()
    }
    stacked = panel.stack_sources(cleaned, KEYS)
    return condense.condense(stacked, KEYS, fields, list(order))


def recode(panel_df: DataFrame) -> DataFrame:
    """Initiative flags, target codes, primary identifier and fiscal year."""
    out = panel_df.select("*", *cells.initiative_flags(F.col("initiative_type")))
    out = out.withColumns({
        "science_based_intensity_target_code": cells.ordinal_code(F.col("science_based_intensity_target"), V.SCIENCE_BASED_INTENSITY_CODES),
        "science_based_absolute_target_code": cells.ordinal_code(F.col("science_based_absolute_target"), V.SCIENCE_BASED_ABSOLUTE_CODES),
        "active_target_code": cells.ordinal_code(F.col("active_target"), V.ACTIVE_TARGET_CODES),
        "isin_used": cells.primary_isin(F.col("`primary isin`"), F.col("isin")),
        "fiscal_year": cells.survey_fiscal_year(F.col("year")),
    })
    known = out.filter(F.col("account no").isNotNull())
    return panel.fill_panel(known, ["isin_used"], ["account no"], "year", "updown")


def company_ids(accounts: DataFrame, reference: DataFrame, overrides: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``account no, fiscal_year, ref_id`` over the full year range.

    Identifier and year first, then the account's resolved entity, hand
    corrections last, gaps filled from the neighbouring years.
    ``accounts``: ``account no, fiscal_year, isin, name``; ``reference``:
    ``ref_id, isin, fiscal_year, name, order``.
    """
    entities = resolve.resolve_entities(
        accounts.select(F.col("account no").alias("account"), "isin", cells.clean_company_name(F.col("name")).alias("name")).distinct(),
        reference.select("ref_id", "isin", cells.clean_company_name(F.col("name")).alias("name"), "order"), keep=keep,
    ).groupBy(F.col("account").alias("account no")).agg(F.min("ref_id").alias("ref_id"))
    dated = reference.select("isin", "fiscal_year", "ref_id", "order")
    base = accounts.select("account no", "fiscal_year", "isin").withColumn("ref_id", F.lit(None).cast("string"))
    ids = panel.fallback_lookup(base, "ref_id", [
        (dated.withColumn("ref_id", F.col("ref_id").cast("string")), ["isin", "fiscal_year"], "ref_id", "order"),
        (entities.withColumn("ref_id", F.col("ref_id").cast("string")).withColumn("order", F.lit(0)), "account no", "ref_id", "order"),
    ])
    per_year = ids.groupBy("account no", "fiscal_year").agg(F.min("ref_id").alias("ref_id"))
    if overrides is not None:
        per_year = rules.apply_overrides(per_year, overrides, "account no", "fiscal_year", {"ref_id": "string"})
    grid = panel.year_grid(per_year, "account no", "fiscal_year", FIRST_YEAR, LAST_YEAR)
    return panel.fill_panel(grid, ["ref_id"], ["account no"], "fiscal_year", "downup")


def with_reference(panel_df: DataFrame, ids: DataFrame, financial: DataFrame, environmental: DataFrame, indicators_df: DataFrame) -> DataFrame:
    """Panel, financial rows, environmental rows (by either id) and indicators, one wide row each.

    ``financial``: keyed ``ref_id, fiscal_year``; ``environmental``: keyed
    ``ref_id, institution_id, fiscal_year``.
    """
    base = panel.join_on(panel_df, ids, ["account no", "fiscal_year"], "full", "match")
    by_ref = environmental.drop("institution_id")
    by_institution = environmental.drop("ref_id")
    routes = [(by_ref, ["ref_id", "fiscal_year"])]
    if "institution_id" in base.columns:
        routes.append((by_institution, ["institution_id", "fiscal_year"]))
    merged = panel.union_by_keys(base, routes)
    merged = panel.join_on(merged, financial, ["ref_id", "fiscal_year"])
    keyed = indicators_df.withColumn("fiscal_year", cells.survey_fiscal_year(F.col("year"))).drop("year").withColumnRenamed("account_no", "account no")
    return panel.join_on(merged, keyed, ["account no", "fiscal_year"], "full", "match")


def prefixed(financial: DataFrame, environmental: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source prefixes, header codes and fiscal years of the two reference tables."""
    fin = C.prefix_columns(financial, "comp_")
    fin = fin.withColumn("fiscal_year", cells.fiscal_year(cells.parse_date(F.col("comp_datadate"), "MM/dd/yy")))
    env = C.rename_by_code(environmental, V.HEADER_CODES)
    env = C.prefix_columns(env, "tru_", keep=tuple(V.HEADER_CODES.values()))
    return fin, env.withColumn("fiscal_year", cells.fiscal_year(F.to_date("tru_periodenddate")))


def summary_rows(frames: list[DataFrame]) -> DataFrame:
    """Summary sheets of all files on the fixed output schema."""
    renamed = []
    for df in frames:
        taken, names = set(), {}
        for c in df.columns:
            topic = summary_topic(c)
            if topic in taken:
                continue
            taken.add(topic)
            names[c] = topic
        renamed.append(df.select(*[F.col(f"`{c}`").alias(t) for c, t in names.items()]))
    return responses.union_layouts(renamed, list(V.SUMMARY_COLUMNS))


def summary_topic(header: str) -> str:
    """Canonical name of one summary header (schema level, no data)."""
    import re

    from surveyloom.functions.rename_rules import SUMMARY_RULES

    name = header.lower().replace(".", "")
    for _, _, pattern, topic in SUMMARY_RULES:
        if re.search(pattern, name):
            return topic
    return name
