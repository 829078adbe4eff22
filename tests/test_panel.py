from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from surveyloom.operators import bands, indicators, panel


# -- joins --------------------------------------------------------------------------------
def test_null_keys(frame):
    a = frame("k int, y int, a string", [(1, 1, "a1"), (None, 1, "a0"), (2, 1, "a2")])
    b = frame("k int, y int, b string", [(1, 1, "b1"), (None, 1, "b0"), (3, 1, "b3")])
    assert tuples(panel.join_on(a, b, ["k", "y"])) == [(1, 1, "a1", "b1"), (2, 1, "a2", None), (None, 1, "a0", None)]
    assert tuples(panel.join_on(a, b, ["k", "y"], "left", "match")) == [(1, 1, "a1", "b1"), (2, 1, "a2", None), (None, 1, "a0", "b0")]
    assert tuples(panel.join_on(a, b, ["k", "y"], "full", "match")) == [(1, 1, "a1", "b1"), (2, 1, "a2", None), (3, 1, None, "b3"), (None, 1, "a0", "b0")]
    assert len(tuples(panel.full_join_all([a, b, b.withColumnRenamed("b", "c")], ["k", "y"]))) == 6


def test_first_match(frame):
    df = frame("k string", [("x",), ("y",), (None,)])
    lookup = frame("k string, v string, o int", [("x", "late", 5), ("x", "early", 1), (None, "null", 0)])
    assert tuples(panel.first_match(df, lookup, "k", ["v"], "o")) == [("x", "early"), ("y", None), (None, None)]


def test_fallback_and_fill_from(frame):
    df = frame("k string, j string, t string", [("a", "x", None), ("b", "x", "kept"), ("c", "z", None)])
    one, two = frame("k string, v string, o int", [("a", None, 0), ("b", "no", 0)]), frame("j string, v string, o int", [("x", "second", 0)])
    got = panel.fallback_lookup(df, "t", [(one, "k", "v", "o"), (two, "j", "v", "o")])
    assert tuples(got.select("k", "t")) == [("a", "second"), ("b", "kept"), ("c", None)]
    named = frame("n string, c string", [("A b", "old"), ("zz", "keep")])
    known = frame("n string, c string, o int", [("a B", "new", 1)])
    assert tuples(panel.fill_from(named, known, F.replace(F.lower("n"), F.lit(" "), F.lit("")), "c", "o")) == [("A b", "new"), ("zz", "keep")]


def test_union_by_keys(frame):
    df = frame("id int, a int, b int", [(1, 1, 1), (2, None, 1), (3, 1, None), (4, None, None)])
    ra, rb = frame("a int, ra string", [(1, "A")]), frame("b int, rb string", [(1, "B")])
    assert tuples(panel.union_by_keys(df, [(ra, ["a"]), (rb, ["b"])]).select("id", "ra", "rb")) == [
        (1, "A", None), (1, None, "B"), (2, None, "B"), (2, None, None), (3, "A", None), (3, None, None), (4, None, None),
    ]


def test_overwrite_overlap_attach(frame):
    df = frame("k int, a string, b string", [(1, "x", "p"), (2, "y", "q")])
    other = frame("k int, a string, c string", [(1, "new", "c")])
    assert tuples(panel.overwrite_columns(df, other, ["k"])) == [(1, "new", "p", "c"), (2, None, "q", None)]
    assert tuples(panel.key_overlap(df, other, ["k"])) == [(1,)]
    assert tuples(panel.only_in(df, other, ["k"]).select("k")) == [(2,)]
    assert tuples(panel.within(df, other, ["k"]).select("k")) == [(1,)]
    attrs = frame("k int, r string, o int", [(1, "late", 2), (1, "early", 1)])
    assert tuples(panel.attach_first(df.select("k"), attrs, "k", "o")) == [(1, "early"), (2, None)]


# -- fill ------------------------------------------------------------------------------------
def slow_fill(values, direction):
    def down(vs):
        out, last = [], None
        for v in vs:
            last = v if v is not None else last
            out.append(last)
        return out
    d, u = down(values), down(values[::-1])[::-1]
    first, second = {"down": (d, d), "up": (u, u), "downup": (d, u), "updown": (u, d)}[direction]
    return [a if a is not None else b for a, b in zip(first, second)]


@pytest.mark.parametrize("direction", ["down", "up", "downup", "updown"])
def test_fill_against_definition(spark, direction):
    random.seed(7)
    rows = [(k, y, random.choice([None, None, f"{k}{y}"])) for k in "abcd" for y in range(8)] + [("e", y, None) for y in range(3)]
    df = spark.createDataFrame(rows, "k string, y int, v string")
    want = []
    for k in "abcde":
        mine = [r for r in rows if r[0] == k]
        want += [(k, y, f) for (_, y, _), f in zip(mine, slow_fill([v for *_, v in mine], direction))]
    want.sort(key=repr)
    assert tuples(panel.fill(df, ["v"], ["k"], "y", direction)) == want
    once = panel.fill_panel(df, ["v"], ["k"], "y", direction)
    assert tuples(once) == want
    assert tuples(panel.fill_panel(once, ["v"], ["k"], "y", direction)) == want


def test_fill_several_rows_per_year(frame):
    df = frame("k int, y int, v string", [(1, 1, "a"), (1, 1, None), (1, 2, None), (None, 1, None), (None, 2, "n")])
    assert tuples(panel.fill(df, ["v"], ["k"], "y", "downup")) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (None, 1, "n"), (None, 2, "n")]


def test_grid_and_slice(frame):
    df = frame("k int, y int, v string", [(1, 2010, "a"), (2, 2011, "b"), (None, 2010, "c")])
    assert tuples(panel.year_grid(df, "k", "y", 2010, 2011)) == [(1, 2010, "a"), (1, 2011, None), (2, 2010, None), (2, 2011, "b")]
    assert tuples(panel.account_slice(frame("k int", [(i,) for i in (5, 1, 3, 3, 9)]), "k", 1, 3)) == [(3,), (3,), (5,)]


def test_lag_growth(frame):
    df = frame("r string, y int, m double", [("e", 1, 10.0), ("e", 2, 20.0), ("e", 3, 0.0)])
    got = {r.y: (r.next_m, r.growth_m) for r in panel.lag_growth(df, ["m"], ["r"], "y").collect()}
    assert got == {1: (None, None), 2: (10.0, -0.5), 3: (20.0, None)}
    lead = {r.y: r.next_m for r in panel.lag_growth(df, ["m"], ["r"], "y", "lead").collect()}
    assert lead == {1: 20.0, 2: 0.0, 3: None}


# -- indicators --------------------------------------------------------------------------------
def test_label_counts_null_rule(frame):
    labels = frame("k int, year int, model string, label string", [
        (1, 1, "m", "yes"), (1, 1, "m", "no, yes"), (1, 1, "m", None), (1, 1, "m", "None"), (2, 1, "m", None),
    ])
    maxcol = frame("year int, maxcol long", [(1, 4)])
    pairs = (("m", "yes"), ("m", "no"))
    clean = indicators.label_counts(labels, ["k", "year"], maxcol, "year", pairs, False, {})
    assert tuples(clean) == [(1, 1, 4, 2, 2, 0.5, 0.5), (2, 1, 4, 0, 0, 0.0, 0.0)]
    as_text = indicators.label_counts(labels, ["k", "year"], maxcol, "year", pairs, True, {})
    assert [r[4] for r in tuples(as_text)] == [3, 1]


def test_text_fill(frame):
    df = frame("k int, year int, t string", [(1, 1, "['ab c']"), (1, 1, "Hidden Answer"), (1, 1, None), (2, 1, "  \n ")])
    cap = indicators.max_answered(df.withColumn("n_responses", F.lit(1)), "year", ["k"])
    assert tuples(indicators.text_fill(df, ["k", "year"], "t", cap)) == [(1, 1, 3, 3, 1 / 3), (2, 1, 3, 0, 0.0)]


def test_question_metrics_lists_and_rows_agree(frame):
    rows = frame("k int, i int, t string, s string", [(1, 0, "ab", "0.5"), (1, 1, None, None), (1, 2, "c", "1.0"), (2, 0, None, None)])
    flat = indicators.question_metrics(rows, ["k"], "t", "s")
    lists = rows.groupBy("k").agg(F.array(*[F.max(F.when(F.col("i") == j, F.col("t"))) for j in range(3)]).alias("t"), F.array(*[F.max(F.when(F.col("i") == j, F.col("s"))) for j in range(3)]).alias("s"))
    got = {r.k: tuple(r)[1:] for r in lists.select("k", *indicators.question_metrics_arrays(F.col("t"), F.col("s"))).collect()}
    want = {r.k: tuple(r)[1:] for r in flat.collect()}
    assert got[1] == want[1] == (0.75, 3, 2)
    assert got[2] == (None, 0, 0) and want[2] == (None, None, 0)


# -- amounts -----------------------------------------------------------------------------------
def test_amount_filters(frame):
    df = frame("y int, c string, p array<string>, a array<string>", [
        (2015, "EUR(€)", ["<1 year", "1-3 years"], ["10", "Hidden answer"]), (2015, "USD", ["x"], ["1", "2"]), (2016, "EUR", ["Question not applicable"], ["5"]), (2016, "USD", ["1-3 years"], ["0"]),
    ])
    rows = bands.explode_together(df, ["p", "a"])
    assert len(tuples(rows)) == 4
    assert tuples(bands.usable_amounts(rows, "a", ["p", "c"]).select("y", "a")) == [(2015, 10.0)]
    bad = frame("a string, b string", [("ten", "x")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bands.usable_amounts(bad, "a", ["b"]).collect()


def test_convert_currency(frame):
    df = frame("y int, c string, a double", [(2015, "EUR", 10.0), (2015, "NOK", 1.0)])
    rates = bands.rate_table(frame("year int, EUR string, USD string", [(2015, "0.5", "1")]))
    assert tuples(bands.convert_currency(df, rates, "a", "y", "c", missing="null")) == [(2015, "EUR", 20.0), (2015, "NOK", None)]
    with pytest.raises(Exception, match="no rate for NOK in 2015"):
        bands.convert_currency(df, rates, "a", "y", "c").collect()


def test_quartiles_and_trim(frame):
    df = frame("v double", [(float(v),) for v in range(1, 101)])
    got = {r.quartile: r["count"] for r in bands.quartile_bands(df, "v").groupBy("quartile").count().collect()}
    assert got == {"Q1 (Smallest)": 26, "Q2": 25, "Q3": 24, "Q4 (Largest)": 25}
    assert bands.trim_above(df.union(frame("v double", [(-5.0,)])), "v").agg(F.max("v"), F.min("v")).first() == (99.0, 1.0)


def test_pair_differences(frame):
    df = frame("k int, y int, r string, m double", [(1, 1, "investor", 3.0), (1, 1, "supply_chain", 1.0), (2, 1, "investor", 3.0), (3, 1, "investor", 2.0), (3, 1, "supply_chain", 2.0)])
    assert tuples(panel.pair_differences(df, ["k", "y"], "r", ("investor", "supply_chain"), ["m"])) == [(1, 1, "m", 2.0)]
