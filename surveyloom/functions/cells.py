"""Cell-level functions: cleaning, recoding, dates, small arrays."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from surveyloom.functions import fixed_values as V


# -- placeholders and text ---------------------------------------------------
def is_placeholder(c: Column, tokens: tuple[str, ...] = V.PLACEHOLDERS) -> Column:
    return F.lower(c).isin(*tokens)


def null_if_in(c: Column, tokens: tuple[str, ...] = V.NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def clean_elements(arr: Column) -> Column:
    """Trim, collapse white space and drop line separators in every element; nulls stay."""
    return F.transform(arr, lambda e: F.trim(F.regexp_replace(e, r"(?U)\s+", " ")))


def strip_list_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\]']", "")


NUMERIC = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+|(?i:nan|inf|infinity))(?:[eE][+-]?\d+)?\s*$"


def as_double(c: Column) -> Column:
    """Number in a text, null when there is none.

    The shape is checked before the cast, because a failing cast raises inside
    and costs many times more than the check on columns full of words.
    """
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def to_number(c: Column) -> Column:
    """Number out of a printed one-element list; null when it is not one."""
    return as_double(strip_list_marks(c.cast("string")))


def clean_na(c: Column) -> Column:
    out = F.regexp_replace(c.cast("string"), "NA, ", "Not Answered, ")
    out = F.regexp_replace(out, ", NA", ", Not Answered")
    return F.trim(F.regexp_replace(out, "^, |, $", ""))


def letters_only(c: Column) -> Column:
    """Lower-case letters of a name, all else removed."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def compact_name(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def clean_company_name(c: Column, whole_words: bool = False) -> Column:
    """Upper-case and apply the ordered company-name rules.

    The standard list rewrites company forms wherever they start a word; with
    ``whole_words`` only a whole word is rewritten.
    """
    out = F.upper(c)
    for pattern, replacement in (V.NAME_RULES_WHOLE_WORD if whole_words else V.NAME_RULES):
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out) if whole_words else out


def dedupe_list_text(c: Column, lower: bool = False) -> Column:
    """Distinct entries of a ``", "`` list, first-seen order, NA marks removed."""
    out = F.replace(F.regexp_replace(c, r"^NA$|NA, |, NA|, n/a|\*", ""), F.lit("&"), F.lit("and"))
    out = F.lower(out) if lower else out
    return F.array_join(F.array_distinct(F.transform(F.split(out, ", "), lambda e: F.trim(e))), ", ")


def ampersand_to_and(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit("and"))


# -- arrays ------------------------------------------------------------------
def first_present(arr: Column) -> Column:
    return F.get(F.filter(arr, lambda e: e.isNotNull()), 0)


def list_mean(arr: Column) -> Column:
    """Mean of the numeric, non-null elements; null for none."""
    nums = F.filter(F.transform(arr, as_double), lambda e: e.isNotNull())
    total = F.aggregate(nums, F.lit(0.0), lambda acc, e: acc + e)
    return F.when(F.size(nums) > 0, total / F.size(nums))


def list_characters(arr: Column) -> Column:
    return F.length(F.array_join(F.filter(arr, lambda e: e.isNotNull()), ""))


def list_responses(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda e: e.isNotNull()))


def rightmost(*cols: Column) -> Column:
    """Value of the last non-null column."""
    return F.coalesce(*reversed(cols))


# -- lookups -----------------------------------------------------------------
def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Replace known values, keep the others."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, c), c)


def currency_code(c: Column) -> Column:
    return map_values(c, V.CURRENCY_ALIASES)


def payback_band(c: Column) -> Column:
    return F.when(c.isNull(), "No payback").when(c.isin(*V.LONG_PAYBACK), ">3 years").otherwise(c)


def found_any(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether any alternative of ``a|b|c`` occurs in the text.

    Plain alternatives are looked up as byte runs, which is far cheaper on long
    texts than a case-insensitive regex; the others stay a regex.
    """
    items = [(item, re.sub(r"\\([()])", r"\1", item)) for item in pattern.split("|")]
    is_plain = lambda item: not re.search(r"[.^$*+?{}\[\]()\\]", re.sub(r"\\[()]", "", item))
    plain = [text for item, text in items if is_plain(item)]
    others = [item for item, _ in items if not is_plain(item)]
    text = F.lower(c) if ignore_case else c
    hits = [F.contains(text, F.lit(p.lower() if ignore_case else p)) for p in plain]
    if others:
        hits.append(c.rlike(("(?i)" if ignore_case else "") + "|".join(others)))
    return reduce(lambda a, b: a | b, hits)


def first_rule(c: Column, rules: tuple, default: str | None = None) -> Column:
    """Value of the first ``(pattern, value)`` whose pattern is found, case ignored."""
    out = None
    for pattern, value in rules:
        hit = found_any(c, pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(default))


def industry_category(c: Column) -> Column:
    return first_rule(c, V.INDUSTRY_RULES)


def region_exact(c: Column, regions: tuple = V.REGIONS_EXACT) -> Column:
    out = None
    for name, members in regions:
        hit = c.isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def region_partial(c: Column, regions: tuple = V.REGIONS_PARTIAL) -> Column:
    """Region whose first member name occurs anywhere in the text, in table order."""
    out = F.when(c.isNull(), "Unknown")
    for name, members in regions:
        out = out.when(found_any(c, "|".join(members), ignore_case=False), name)
    return out.otherwise("Unknown")


def initiative_flags(c: Column, prefix: str = "initiative_type_") -> list[Column]:
    """One 0/1 column per initiative type, plus one for an unanswered cell."""
    flags = [
        F.coalesce(found_any(c, pattern), F.lit(False)).cast("int").alias(prefix + name)
        for name, pattern in V.INITIATIVE_FLAGS
    ]
    missing = c.isNull() | found_any(c, V.INITIATIVE_NOT_ANSWERED)
    return flags + [F.coalesce(missing, F.lit(True)).cast("int").alias(prefix + "NA")]


def ordinal_code(c: Column, codes: tuple) -> Column:
    """Code of the first matching pattern; null text gets the first code."""
    out = F.when(c.isNull(), F.lit(codes[0][0]))
    for code, pattern in codes:
        out = out.when(c.rlike("(?i)" + pattern), F.lit(code))
    return out


def recipient_flags(filename: Column) -> list[Column]:
    inv, sc = filename.rlike(V.INVESTOR_PATTERN), filename.rlike(V.SUPPLY_CHAIN_PATTERN)
    flag = lambda cond, name: F.coalesce(cond, F.lit(False)).cast("int").alias(name)
    return [
        flag(inv & ~sc, "recipient_investor"),
        flag(sc & ~inv, "recipient_supply_chain"),
        flag(inv & sc, "recipient_both"),
    ]


def respondent_type(respondents: Column) -> Column:
    inv, sc = respondents.rlike("(?i)investor"), respondents.rlike("(?i)supply_chain")
    return F.when(inv & sc, "both").when(inv, "inv_only").when(sc, "sc_only").otherwise("other")


def verified_flag(year: Column, value: Column, scope_text: Column | None = None, scope: str = "scope 1") -> Column:
    """1 unless the year's own field says the figure was not verified."""
    missing_2020 = value.isNull() | value.isin(*V.NOT_VERIFIED_2020)
    missing_old = value.isNull() | value.isin(*V.NOT_VERIFIED)
    text = scope_text if scope_text is not None else F.lit(None).cast("string")
    missing_mid = text.isNull() | (text == "Hidden Answer") | ~text.rlike("(?i)" + scope)
    missing = (
        F.when(year == 2020, missing_2020)
        .when(year.isin(2018, 2019), missing_mid)
        .when(year.between(2010, 2017), missing_old)
        .otherwise(F.lit(False))
    )
    return F.when(missing, 0).otherwise(1)


def primary_isin(primary: Column, isin_list: Column) -> Column:
    first = F.regexp_replace(F.regexp_replace(isin_list, "NA, ", ""), ", .*$", "")
    return F.nullif(F.coalesce(primary, first), F.lit("0"))


# -- dates and numbers -------------------------------------------------------
def fiscal_year(d: Column) -> Column:
    """Calendar year, or the year before when the month is before June."""
    return F.year(d) - (F.month(d) < 6).cast("int")


def survey_fiscal_year(survey_year: Column) -> Column:
    return survey_year.cast("int") - 1


def parse_date(c: Column, *formats: str) -> Column:
    """First format that parses; null when none does. Two-digit years from 69 on are of the last century."""
    formats = formats or ("yyyy-MM-dd", "MM/dd/yy", "dd MMM yyyy", "d MMM yyyy")

    def parsed(f: str) -> Column:
        day = F.try_to_timestamp(c, F.lit(f)).cast("date")
        if f.count("y") != 2:
            return day
        return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*[parsed(f) for f in formats])


def year_in_text(*cols: Column) -> Column:
    """First ``20xx`` found in the first column that holds one."""
    hits = [F.nullif(F.regexp_extract(c, r"20\d\d", 0), F.lit("")) for c in cols]
    return F.coalesce(*hits).cast("int")


def market_cap(shares: Column, price: Column) -> Column:
    return shares * price


def ticker_root(c: Column) -> Column:
    return F.regexp_replace(c, " [A-Z]{2}$", "")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)
