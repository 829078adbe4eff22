from __future__ import annotations

import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import tuples
from surveyloom.functions import cells, columns as C, fixed_values as V
from surveyloom.functions.distributions import incomplete_beta
from surveyloom.functions.similarity import accept_scores, cosine, jaro, jaro_batch, unit


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_codec_round_trip(spark):
    name = C.create_column(column="a=b", sheet="S 1", value="response")
    got = one(
        spark, name, C.column_property(name, "column"), C.update_column(name, model="m", label="yes", value="score"),
        C.update_column(C.update_column(name, model="m", value="label"), value="response"), C.has_properties(name, value="response", sheet="S 1"),
        C.has_properties(name, model="m"), C.column_property(name, "model"),
    )
    assert got == (
        "column=a=b|sheet=S 1|value=response", "a=b", "column=a=b|sheet=S 1|model=m|label=yes|value=score",
        "column=a=b|sheet=S 1|model=m|value=response", True, False, None,
    )


def test_names(spark, frame):
    assert one(spark, C.clean_name(F.lit(" a  b\n\tc  "))) == ("a b c",)
    df = frame("t string, n string, p int", [("x", "a", 0), ("x", "a", 1), ("x", "b", 2), ("x", "a", 3), ("y", "a", 0)])
    assert tuples(C.make_unique(df, "n", ["t"], "p").select("t", "p", "n")) == [
        ("x", 0, "a"), ("x", 1, "a_1"), ("x", 2, "b"), ("x", 3, "a_2"), ("y", 0, "a"),
    ]
    numbered = C.number_repeats(df.withColumn("n", C.create_column(column=F.col("n"), value="response")), "n", ["t"], "p")
    assert ("x", "column=a|number=2|value=response", 3) in tuples(numbered.select("t", "n", "p"))


def test_frame_renames(frame):
    df = frame("a int, b int", [(1, 2)])
    assert C.rename_present(df, {"a": "x", "zz": "y"}).columns == ["x", "b"]
    with pytest.raises(ValueError):
        C.rename_present(df, {"zz": "y"}, strict=True)
    assert C.prefix_columns(df.toDF("a b", "c"), "p_", keep=("c",)).columns == ["p_a_b", "c"]
    assert C.rename_by_code(df.toDF("x 319413 y", "b"), V.HEADER_CODES).columns == ["tru_scope1_absolute", "b"]
    assert C.tidy_indicator_names(df.toDF("model=m|value=label_no_sum", "b")).columns == ["m_label_no_sum", "b"]
    assert C.add_year_label(df, 2015, "investor").columns == ["year", "label", "a", "b"]
    assert C.reorder_like(df, df.select("b", "a")).columns == ["b", "a"]


def test_text_cells(spark):
    assert one(spark, cells.to_number(F.lit("['2019']")), cells.to_number(F.lit("['x']"))) == (2019.0, None)
    assert one(spark, cells.clean_na(F.lit("NA, a, NA"))) == ("Not Answered, a, Not Answered",)
    assert one(spark, cells.letters_only(F.lit("3i Group-PLC"))) == ("igroupplc",)
    assert one(spark, cells.dedupe_list_text(F.lit("A & B, NA, a, A & B"), lower=True)) == ("a and b, a",)
    assert one(spark, cells.null_if_in(F.lit("NA")), cells.null_if_in(F.lit("x"))) == (None, "x")
    assert one(spark, cells.is_placeholder(F.lit("Hidden ANSWER"))) == (True,)
    assert one(spark, cells.clean_elements(F.array(F.lit(" a  b "), F.lit(None).cast("string")))) == (["a b", None],)


@pytest.mark.parametrize("raw,cleaned,words", [
    ("Apple, Inc.", "APPLE INCORPORATED", "APPLE INCORPORATED"),
    ("Foo Corporation (US)", "FOO CORP", "FOO CORP"),
    ("Bar Co Ltd", "BAR COMPANY LTD", "BAR COMPANY LTD"),
    # Doubled blanks are merged before the plus sign is written out.
    ("Int'l + Sons Limited", "INTL  PLUS  SONS LTD", "INTL PLUS SONS LTD"),
    ("A-B/C S.A.", "ABC SA", "ABC SA"),
    # The standard list also rewrites words that merely start like a company form.
    ("Some Income Trust", "SOME INCORPORATEDME TRUST", "SOME INCOME TRUST"),
])
def test_company_names(spark, raw, cleaned, words):
    assert one(spark, cells.clean_company_name(F.lit(raw)), cells.clean_company_name(F.lit(raw), whole_words=True)) == (cleaned, words)


def test_arrays(spark):
    a = F.array(F.lit(None).cast("string"), F.lit("1"), F.lit("x"), F.lit("3"))
    assert one(spark, cells.first_present(a), cells.list_mean(a), cells.list_characters(a), cells.list_responses(a)) == ("1", 2.0, 3, 3)
    empty = F.array().cast("array<string>")
    assert one(spark, cells.first_present(empty), cells.list_mean(empty), cells.list_characters(empty)) == (None, None, 0)
    assert one(spark, cells.rightmost(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))) == ("b",)


def test_recodes(spark):
    assert one(spark, cells.currency_code(F.lit("EUR(€)")), cells.currency_code(F.lit("NOK"))) == ("EUR", "NOK")
    assert one(spark, cells.payback_band(F.lit("11-15 years")), cells.payback_band(F.lit(None).cast("string")), cells.payback_band(F.lit("<1 year"))) == (">3 years", "No payback", "<1 year")
    assert one(spark, cells.industry_category(F.lit("Oil and Software")), cells.industry_category(F.lit("zzz"))) == ("Technology and Telecommunications", None)
    assert one(spark, cells.region_exact(F.lit("Canada")), cells.region_exact(F.lit("Panama")), cells.region_partial(F.lit("Panama, x")), cells.region_partial(F.lit(None).cast("string"))) == ("North America", "Unknown", "Caribbean", "Unknown")
    flags = one(spark, *cells.initiative_flags(F.lit("SOLAR; Heating, Ventilation and Air Conditioning (HVAC)")))
    assert flags == (0, 1, 1, 0, 0, 0, 0, 0)
    assert one(spark, *cells.initiative_flags(F.lit(None).cast("string"))) == (0, 0, 0, 0, 0, 0, 0, 1)
    code = lambda t: one(spark, cells.ordinal_code(F.lit(t).cast("string"), V.SCIENCE_BASED_ABSOLUTE_CODES))[0]
    assert [code(t) for t in (None, "No", "Yes, but not yet approved", "Yes", "Maybe")] == [0, 0, 2, 3, None]
    assert one(spark, *cells.recipient_flags(F.lit("Investor 2015"))) == (1, 0, 0)
    assert one(spark, *cells.recipient_flags(F.lit("Supply Chain Inv"))) == (0, 0, 1)
    assert one(spark, cells.respondent_type(F.lit("supply_chain, investor")), cells.respondent_type(F.lit("x"))) == ("both", "other")
    assert one(spark, cells.primary_isin(F.lit(None).cast("string"), F.lit("NA, US1, US2")), cells.primary_isin(F.lit("0"), F.lit("US1"))) == ("US1", None)
    flag = lambda y, v, s=None: one(spark, cells.verified_flag(F.lit(y), F.lit(v).cast("string"), F.lit(s).cast("string")))[0]
    assert [flag(2020, "0.0"), flag(2020, "ok"), flag(2019, None, "Scope 1"), flag(2018, "ok", "scope 3"), flag(2012, "Not verified"), flag(2012, "0.0")] == [0, 1, 1, 0, 0, 1]


def test_dates(spark):
    d = lambda t: one(spark, cells.parse_date(F.lit(t)))[0]
    assert d("2015-03-31") == datetime.date(2015, 3, 31)
    assert d("03/31/15") == datetime.date(2015, 3, 31)
    assert d("31 Dec 2013") == datetime.date(2013, 12, 31)
    assert d("5 Jan 2013") == datetime.date(2013, 1, 5)
    assert d("nonsense") is None
    fy = lambda t: one(spark, cells.fiscal_year(F.to_date(F.lit(t))))[0]
    assert (fy("2015-05-31"), fy("2015-06-01")) == (2014, 2015)
    assert one(spark, cells.year_in_text(F.lit("no"), F.lit("in 2014, 2016"))) == (2014,)
    assert one(spark, cells.survey_fiscal_year(F.lit("2016"))) == (2015,)
    assert one(spark, cells.safe_ratio(F.lit(1.0), F.lit(0.0)), cells.ticker_root(F.lit("ABC US"))) == (None, "ABC")


def test_found_any_matches_regex(spark, frame):
    df = frame("t string", [("A SOLAR roof",), ("electric fast charging station",), ("electricc",), ("leeed certificate",), ("nothing",), (None,)])
    for _, pattern in V.INITIATIVE_FLAGS:
        got = tuples(df.select("t", cells.found_any(F.col("t"), pattern)))
        assert got == tuples(df.select("t", F.col("t").rlike("(?i)" + pattern)))


def brute_jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    second = [b[j] for j in range(len(b)) if used[j]]
    m = len(first)
    if m == 0:
        return 0.0
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd é", max_size=12), st.text("abcd é", max_size=12)), min_size=1, max_size=8))
def test_jaro_against_definition(pairs):
    got = jaro_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - brute_jaro(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs))


def test_similarity_columns(spark, frame):
    assert abs(one(spark, jaro(F.lit("MARTHA"), F.lit("MARHTA")))[0] - 0.944444) < 1e-6
    assert one(spark, jaro(F.lit(None).cast("string"), F.lit("A"))) == (None,)
    got = one(spark, *accept_scores(F.lit("GRP"), F.lit("GRP LTD")))
    assert got[1] == 1.0 and got[2] < 1.0 and got[0] < 1.0
    v = unit(F.array(F.lit(3.0), F.lit(4.0)))
    assert one(spark, v, cosine(v, v), cosine(v, F.array().cast("array<double>"))) == ([0.6, 0.8], pytest.approx(1.0), 0.0)


def test_incomplete_beta_known_values():
    assert abs(incomplete_beta(0.5, 0.5, 0.25) - 1 / 3) < 1e-10
    assert abs(incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-10
    # Two-sided t: t = 2.228139 with 10 degrees of freedom is the 5 % point.
    assert abs(incomplete_beta(5, 0.5, 10 / (10 + 2.2281389**2)) - 0.05) < 1e-8
    assert abs(incomplete_beta(50_000, 0.5, 100_000 / (100_000 + 1.96**2)) - 0.05) < 2e-4
