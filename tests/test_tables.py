from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from surveyloom.functions.rename_rules import EMISSION_RULES, SUMMARY_RULES, TARGET_RULES
from surveyloom.operators import condense, eras, profile, responses, rules
from surveyloom.operators.ordered import exact_quantiles, number_rows, running_totals


# -- order without whole groups in one task ---------------------------------------------
def test_number_rows_over_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    got = number_rows(df, ["k"], ["id"], F.floor(F.col("id") / 64))
    for key in ("hot", "k1"):
        mine = sorted((r.id, r.pos) for r in got.filter(F.col("k") == key).collect())
        assert [p for _, p in mine] == list(range(len(mine)))


def test_running_totals(spark):
    random.seed(3)
    values = sorted({round(random.gauss(0, 5), 3) for _ in range(500)})
    counts = [random.randint(1, 4) for _ in values]
    df = spark.createDataFrame(list(zip(values, counts)), "v double, n long")
    got = {r.v: r.cum_n for r in running_totals(df, "v", ["n"], range_rows=70).collect()}
    total = 0
    for v, n in zip(values, counts):
        total += n
        assert got[v] == total


def test_running_totals_per_key(spark):
    """Keys that begin and end anywhere in a part, a null key, one key over many parts."""
    random.seed(4)
    rows = [(random.choice(["a", "a", "a", "b", "c", None]), float(v), random.randint(0, 3), random.randint(0, 9)) for v in range(700)]
    df = spark.createDataFrame(rows, "k string, v double, n long, m long")
    got = {(r.k, r.v): (r.cum_n, r.cum_m) for r in running_totals(df, "v", ["n", "m"], ["k"], range_rows=60).collect()}
    totals: dict = {}
    for k, v, n, m in rows:
        before = totals.get(k, (0, 0))
        totals[k] = (before[0] + n, before[1] + m)
        assert got[k, v] == totals[k]
    assert running_totals(df.limit(0), "v", ["n"], ["k"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_exact_quantiles(spark, n):
    random.seed(n)
    data = [round(random.expovariate(0.1), 1) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in data] + [("b", 1.0)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q": 0.25, "p99": 0.99, "m": "median"}, last_rows=9, steps=32).collect()}
    ordered = sorted(data)
    at = lambda q: ordered[int((n - 1) * q + 0.5)]
    assert got["a"].q == at(0.25) and got["a"].p99 == at(0.99)
    assert got["a"].m == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert got["b"].m == 1.0
    whole = exact_quantiles(df.filter("g = 'a'"), [], "v", {"q": 0.25, "m": "median"}, last_rows=9, steps=32).collect()
    assert [(r.q, r.m) for r in whole] == [(at(0.25), got["a"].m)]


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(20,6)"])
def test_exact_quantiles_of_awkward_values(spark, kind):
    """Hot values, far apart ones, the ends of the type, infinite ones."""
    random.seed(9)
    if kind == "double":
        data = [1e300, -1e300, 5e-324, 0.0, float("inf"), float("-inf")] + [0.1] * 300 + [random.gauss(0, 1) * 10 ** random.randint(-30, 30) for _ in range(300)]
    elif kind == "bigint":
        data = [2 ** 63 - 1, -(2 ** 63), 0] + [7] * 300 + [random.randint(-(2 ** 62), 2 ** 62) for _ in range(200)] + list(range(100))
    else:
        data = [Decimal(v) / 1000 for v in [10 ** 12, -(10 ** 12), 0] + [5] * 300 + [random.randint(0, 10 ** 9) for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in data], f"v {kind}")
    qs = {f"q{i}": i / 10 for i in range(11)}
    got = exact_quantiles(df, [], "v", qs, last_rows=9, steps=256).first()
    ordered = sorted(data)
    assert [got[q] for q in qs] == [ordered[int((len(data) - 1) * p + 0.5)] for p in qs.values()]
    assert exact_quantiles(df.limit(0), [], "v", {"q": 0.5}).collect()[0].q is None


# -- responses ---------------------------------------------------------------------------
def test_join_workbook_keeps_order_and_nulls(frame):
    one = frame("k string, row_no long, q1 string", [("1", 0, "a"), ("2", 1, "b")])
    two = frame("k string, row_no long, q2 string", [("3", 0, "x"), ("1", 1, "y"), ("3", 2, None), ("3", 3, "z")])
    long = responses.join_workbook({"s 1": one, "s2": two, "no key": frame("z string", [("q",)])}, "k", "row_no")
    wide = responses.to_lists(long, ["key"], ["q1", "q2"])
    assert tuples(wide) == [("1", ["a"], ["y"]), ("2", ["b"], None), ("3", None, ["x", None, "z"])]


def test_null_keys_and_row_numbers_stay(frame):
    sheet = frame("k string, row_no long, q string", [(None, 0, "a"), ("1", None, "b"), (None, 1, "c")])
    long = responses.sheet_to_long(sheet, "s", "k", "row_no")
    assert tuples(long.select("key", "pos", "value")) == [("1", 0, "b"), (None, 0, "a"), (None, 1, "c")]
    numbered = number_rows(frame("k string, id long", [(None, 5), (None, 3), ("a", 1), ("a", None)]), ["k"], ["id"], F.floor(F.col("id") / 2))
    assert tuples(numbered) == [("a", 1, 1), ("a", None, 0), (None, 3, 0), (None, 5, 1)]
    quantiles = exact_quantiles(frame("g string, v double", [(None, 1.0), (None, 3.0), ("a", 5.0)]), ["g"], "v", {"m": "median"})
    assert tuples(quantiles) == [("a", 5.0), (None, 2.0)]


def test_filter_sheets(frame):
    sheets = frame("year int, label string, sheet_no int", [(2010, "i", k) for k in range(6)])
    config = frame("year int, label string, sheets array<struct<lo int, hi int>>", [(2010, "i", [(0, 1), (4, 4)])])
    assert [r.sheet_no for r in responses.filter_sheets(sheets, config).orderBy("sheet_no").collect()] == [0, 1, 4]


def test_drop_columns(frame):
    cols = frame("workbook string, column string, position int, filled long", [
        ("w", "Account", 0, 5), ("w", "account 2", 1, 5), ("w", "__UNNAMED__3", 2, 5), ("w", "empty", 3, 0), ("w", "Draft note", 4, 5), ("w", "keep", 5, 1),
    ])
    got = responses.drop_columns(cols, ["account"], ["draft"])
    assert [r[1] for r in tuples(got)] == ["Account", "keep"]


def test_process_workbook(frame):
    sheet = frame("acc string, row_no long, `Old  name` string, note string, void string", [("1", 0, " a  b ", "n", None), ("1", 1, "c", "n", None)])
    got = responses.process_workbook({"S": sheet}, 2015, "investor", "acc", renames={"Old name": "New"}, drop=["note"])
    assert tuples(got) == [(2015, "investor", "1", "S", "New", 0, "a b"), (2015, "investor", "1", "S", "New", 1, "c")]


def test_auto_types(frame):
    long = frame("key int, column string, value string", [(1, "n", "1"), (2, "n", "2.5"), (1, "t", "x"), (1, "l", "1"), (1, "l", "2")])
    assert tuples(responses.auto_types(long)) == [("l", False, True, 2), ("n", True, True, 2), ("t", True, False, 1)]


# -- condensing ----------------------------------------------------------------------------
def test_condense_rules(frame):
    df = frame("k string, i int, a string, b string", [
        ("x", 2, "p", None), ("x", 0, "q", None), ("x", 1, "q", None), ("x", 3, None, None), ("y", 0, None, None), (None, 0, "n", "m"),
    ])
    got = condense.condense(df, ["k"], {"a": "a", "b": "b", "both": ["b", "a"]}, ["i"])
    assert tuples(got) == [("x", "q, p", None, "q, p"), ("y", None, None, None), (None, "n", "m", "m, n")]
    struct_order = condense.condense(df, ["k"], {"a": "a"}, ["i", "a"])
    assert ("x", "q, p") in tuples(struct_order)


def test_condense_small_tools(frame):
    df = frame("k int, id string", [(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, None)])
    assert tuples(condense.list_conflicts(df, "k", "id")) == [(1, 2, "a, b")]
    themes = frame("t string", [("Energy: Solar!, other, energy:  SOLAR",)])
    assert tuples(condense.theme_counts(themes, "t")) == [("energy: solar", 2)]
    assert tuples(condense.split_rows(frame("c string", [("a, b ,c",)]), "c")) == [("a",), ("b",), ("c",)]
    long = frame("f string, topic string, value string, position int", [("f", "t", None, 0), ("f", "t", "x", 1), ("f", "t", "y", 2)])
    assert tuples(condense.coalesce_duplicates(long, ["f"])) == [("f", "t", "x")]


# -- eras -----------------------------------------------------------------------------------
def test_emission_figures(frame):
    schema = "year int, `account no` string, scope1 string, scope1_which_year string, scope2 string, scope2_loc string, scope2_market string, scope2_which_year string, scope3 string, scope3_which_category string"
    df = frame(schema, [
        (2019, "a", "10", "Reporting year", None, "1", "2", "Row 1", "5", "Business travel"),
        (2019, "a", "99", "Past year 1", None, "7", "8", "Past", "7", "Capital equipment"),
        (2018, "b", "4", "Row 1", "3", None, None, "Row 1", None, None),
        (2014, "c", "8", "31 Dec 2013", "6", None, None, None, None, None),
        (2014, "c", "9", "31 Dec 2012", "7", None, None, None, None, None),
        (2017, "d", "1", "2016", None, "5", None, "2016", None, None),
        (2016, "e", "x", "1 Jan 2015", None, None, "3", "01 Jan 2015", None, None),
        (2020, "f", "1", None, None, None, None, None, None, None),
    ])
    got = {r["account no"]: tuple(r)[2:] for r in eras.emission_figures(df).collect()}
    assert got["a"] == (10.0, 	None, 1.0, 2.0, 5.0, None)
    assert got["b"] == (4.0, 3.0, None, None, None, None)
    assert got["c"] == (8.0, 6.0, None, None, None, None)
    assert got["d"] == (1.0, None, 5.0, None, None, None)
    assert got["e"] == (None, None, None, 3.0, None, None)
    assert got["f"] == (None, None, None, None, None, None)


def test_fallback(frame):
    df = frame("k int, i int, s string, g string", [(1, 0, None, "g1"), (1, 1, "s1", "g2"), (2, 0, None, "g3"), (3, 0, None, None)])
    assert tuples(eras.with_fallback(df, ["k"], {"s": "g"}, ["i"])) == [(1, "s1"), (2, "g3"), (3, None)]


# -- rules ----------------------------------------------------------------------------------
@pytest.mark.parametrize("rule_table,year,file,header,topic", [
    (TARGET_RULES, 2015, "x", "CC3.1. Did you have an emissions reduction target that was active?", "active_target"),
    (TARGET_RULES, 2019, "x", "C4.3b_C1_Provide details on the initiatives - Initiative type", "initiative_type"),
    (TARGET_RULES, 2010, "x", "9.7 Please describe the actions", "initiative_details"),
    (EMISSION_RULES, 2010, "inv_20.1A.csv", "20.1C1. Scope 1 (Q12.1)", "verification_s1_percent"),
    (EMISSION_RULES, 2016, "8.6a", "CC8.6a Relevant standard", "verification_s1_standard"),
    (EMISSION_RULES, 2016, "other", "CC8.6a Relevant standard", None),
    (EMISSION_RULES, 2019, "C6.1", "RowName", "scope1_which_year"),
    (SUMMARY_RULES, 2012, "x", "Response received date", "submitted date"),
])
def test_topics(spark, rule_table, year, file, header, topic):
    got = spark.range(1).select(rules.topic_of(F.lit(header), rule_table, F.lit(year), F.lit(file))).first()[0]
    assert got == topic


def test_rule_counts():
    assert len(EMISSION_RULES) >= 90 and len({t for *_, t in EMISSION_RULES}) >= 30


def test_headers(frame):
    df = frame("file string, year int, header string, position int", [
        ("f", 2015, "Account number", 0), ("f", 2015, "accounting_year", 1), ("f", 2015, "Organisation", 2), ("f", 2015, "Other", 3), ("f", 2015, "HQ country", 4), ("f", 2015, "country 2", 5),
    ])
    got = {r.position: r.topic for r in rules.rename_headers(df, TARGET_RULES).collect()}
    assert got == {0: "account no", 1: "accounting_year", 2: "name", 3: "other", 4: "country", 5: "country"}


def test_overrides(frame):
    df = frame("acc int, y int, v string", [(1, 2010, "a"), (1, 2012, "a"), (2, 2010, "b"), (3, 2010, "c")])
    fix = frame("key int, year_from int, year_to int, field string, value string, rank int", [(1, 2010, 2015, "v", "x", 0), (1, 2012, 2012, "v", "y", 1), (2, 2009, 2019, "v", None, 2)])
    assert tuples(rules.apply_overrides(df, fix, "acc", "y", {"v": "string"})) == [(1, 2010, "x"), (1, 2012, "y"), (2, 2010, None), (3, 2010, "c")]
    clashing = df.withColumn("key", F.lit("k")).withColumn("_year", F.lit(1))
    assert rules.apply_overrides(clashing, fix, "acc", "y", {"v": "string"}).columns == clashing.columns


# -- profile --------------------------------------------------------------------------------
def test_profile(frame):
    long = frame("column string, year int, value string", [
        ("a", 1, "Long text, with marks. And more than thirty characters."), ("a", 1, "Another text, also with marks. Long enough, yes, it is."), ("a", 2, "Third, one. " * 5), ("a", 2, "Fourth, one. " * 4),
        ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "Other: y"), ("c", 1, None),
    ])
    p = {r["column"]: r for r in profile.column_profile(long).collect()}
    assert (p["b"].n_values, p["b"].n_unique, p["b"].share_unique, p["b"].mean_unique_per_year) == (2, 1, 0.5, 1.0)
    assert p["c"].n_other == 1 and p["a"].punctuation == [",", "."]
    assert sorted(r["column"] for r in profile.free_text_columns(profile.column_profile(long)).collect()) == ["a", "c"]


def test_header_checks(frame):
    cols = frame("workbook string, sheet string, column string", [("w", "s1", "A b"), ("w", "s1", "A b_duplicated_1"), ("w", "s2", "A  b"), ("w", "s2", "c"), ("v", "s1", "c")])
    assert tuples(profile.duplicate_headers(cols)) == [("w", "s1", "Ab", 2)]
    assert tuples(profile.redundant_headers(cols, min_sheets=2)) == [("w", "A b", 2)]
    pairs = frame("a string, b string", [("w", "v")])
    assert [r[2] for r in tuples(profile.only_in_one(cols, pairs))] == ["A  b", "A b", "A b_duplicated_1"]
    with pytest.raises(ValueError):
        profile.redundant_headers(cols)


# -- rules by index --------------------------------------------------------------------------
def test_needed_texts():
    from surveyloom.operators.rules import needed_texts

    assert needed_texts(r"(?s)3\.1a.*comment") == ["comment"] and needed_texts(r"9\.6.*target type") == ["target type"]
    assert needed_texts("cc8.*emissions|cc8.1|8.csv") == ["emissions", "cc8", "csv"]
    assert needed_texts("abc?d") == ["ab"] and needed_texts("ab+cd") == ["ab"] and needed_texts("x{2}long[a-z]tail(y|zz)?") == ["long"]
    assert needed_texts("^isin$") == ["isin"] and needed_texts(r"\s*\d") == [""]


def test_rules_by_index_are_the_rules_in_order(spark, frame):
    """Every rule list over wordings that fit several rules, none, and null headers, years and files."""
    extra = (((2015,), "", "co?", "short"), (None, "", r"\d{4}", "digits"))
    words = ["3.1a", "target", "active", "comment", "scope", "why", "forecast", "cc8 emissions", "8.2a", "gross global scope 1", "metric tonnes co2e", "name", "isin", "9.6", "Target Type"]
    rng = random.Random(8)
    rows = [(rng.choice([2010, 2011, 2015, 2018, 2020, None]), rng.choice(["cc8.1 x.csv", "8.6a.csv", None, "f"]), " ".join(rng.choices(words, k=rng.randint(0, 5))).upper()) for _ in range(300)] + [(2015, "f", None)]
    df = frame("year int, file string, header string", rows)
    for rule_list in (TARGET_RULES + EMISSION_RULES + extra, SUMMARY_RULES, extra):
        got = rules.topics_by_index(df, rule_list).select("year", "file", "header", "topic")
        want = df.select("*", rules.topic_of(F.col("header"), rule_list, F.col("year"), F.col("file")).alias("topic"))
        assert tuples(got) == tuples(want)
    got = rules.topics_by_index(df.select("header"), SUMMARY_RULES)
    assert tuples(got) == tuples(df.select("header", rules.topic_of(F.col("header"), SUMMARY_RULES).alias("topic")))


def test_typed_table(frame):
    rows = [(1, "list", 1, "2"), (1, "list", 0, None), (2, "list", 0, "1.5"), (1, "one", 0, "7"), (2, "one", 0, None), (1, "text", 0, "7"), (2, "text", 0, "x"),
            (1, "words", 0, "a"), (1, "words", 1, "3"), (None, "one", 0, "4"), (2, "empty", 0, None)]
    wide, types = responses.typed_table(frame("k int, column string, pos int, value string", rows), ["k"])
    assert types == {"empty": "string", "list": "array<double>", "one": "double", "text": "string", "words": "array<string>"}
    assert {f.name: f.dataType.simpleString() for f in wide.schema} == {"k": "int"} | types
    assert tuples(wide.select("k", "list", "one", "text", "words")) == [(1, [None, 2.0], 7.0, "7", ["a", "3"]), (2, [1.5], None, "x", None), (None, None, 4.0, None, None)]
    assert responses.typed_table(frame("k int, column string, pos int, value string", []), ["k"])[0].count() == 0
