from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tuples
from surveyloom.functions.similarity import jaro_batch
from surveyloom.operators import matching, resolve


# -- names ---------------------------------------------------------------------------------
def brute_match(names, pool, finite):
    first = list(dict.fromkeys(pool))
    out = {}
    for name in names:
        stem = name[: len(name) * 4 // 5]
        if not stem:
            continue
        best = None
        for m in first:
            if stem not in m:
                continue
            gap = abs(len(m) - len(name))
            length = 1 / (1 + gap) if finite else (float("inf") if gap == 0 else 1 / gap)
            whole, prefix = jaro_batch([m, m[: len(name)]], [name, name])
            score = (whole**2 + 4 * prefix**2 + length**2) ** 0.5
            if best is None or score > best[0] + 1e-12:
                best = (score, m)
        if best:
            out[name] = best[1]
    return out


@pytest.mark.parametrize("finite", [False, True])
def test_best_name_match_against_brute_force(spark, finite):
    random.seed(5)
    words = ["ACME", "GLOBAL", "STEEL", "CO", "A", "LTD", "HOLDING", "X", "(US)", "+", "INC"]
    pool = [" ".join(random.choices(words, k=random.randint(1, 4))) for _ in range(150)]
    names = [" ".join(random.choices(words, k=random.randint(1, 3))) + random.choice(["", "Z", " C"]) for _ in range(80)]
    got = resolve.best_name_match(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(m, i) for i, m in enumerate(pool)], "match string, pool_order long"), finite
    )
    assert {r.name: r.match for r in got.collect()} == brute_match(set(names), pool, finite)


def test_resolve_entities(frame):
    accounts = frame("account int, isin string, name string", [(1, "US1", "ZZZ"), (2, None, "ACME STEEL"), (3, "US9", "NOBODY"), (4, None, "KEPT NAMX")])
    reference = frame("ref_id string, isin string, name string, order int", [("r2", "US1", "B", 2), ("r1", "US1", "C", 1), ("r3", None, "ACME STEEL LTD", 3), ("r4", None, "KEPT NAMEX", 4)])
    keep = frame("name string", [("KEPT NAMX",)])
    assert tuples(resolve.resolve_entities(accounts, reference, keep=keep)) == [(1, "ZZZ", "r1", "isin"), (2, "ACME STEEL", "r3", "name"), (4, "KEPT NAMX", "r4", "name")]
    assert len(tuples(resolve.resolve_entities(accounts, reference))) == 2


def greedy(rows, limit):
    taken_i, taken_j, out = set(), set(), set()
    for cost, i, j in sorted(rows):
        if cost <= limit and i not in taken_i and j not in taken_j:
            taken_i.add(i), taken_j.add(j), out.add((i, j, cost))
    return out


def test_mutual_best_is_the_greedy_matching(spark):
    random.seed(2)
    rows = [(random.randint(0, 6) / 6, i, j) for i in range(7) for j in range(5)]
    df = spark.createDataFrame([("p", i, j, c) for c, i, j in rows], "pair string, i int, j int, cost double")
    got = {(r.i, r.j, r.cost) for r in matching.match_one_to_one(df.filter("cost <= 0.7")).collect()}
    assert got == greedy(rows, 0.7)
    assert len({i for i, *_ in got}) == len(got) == len({j for _, j, _ in got})


def columns_frame(frame, tables):
    rows = []
    for t, cols in tables.items():
        for i, (c, v) in enumerate(cols):
            rows.append((t, "s", i, c, v, [v, v]))
    return frame("table string, sheet string, position int, column string, emb array<double>, sample_embs array<array<double>>", rows)


X, Y, Z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
WEIGHTS = {"d_col": 1.0, "s_col": 1.0, "s_ctx": 1.0, "s_field": 1.0}


def test_costs_and_mapping(frame):
    cols = matching.context_vectors(columns_frame(frame, {"a": [("name", X), ("year", Y), ("extra", Z)], "b": [("years", Y), ("names", X)]}), 0)
    pairs = frame("pair string, a string, b string", [("p", "a", "b")])
    for block in (1, 512):
        costs = matching.cost_arrays(cols, pairs, WEIGHTS, block)
        flat = {(r.i, r.j): r.cost for r in matching.cost_pairs(costs).collect()}
        assert len(flat) == 6 and min(flat.values()) == 0.0 and max(flat.values()) == 1.0
        assert flat[(0, 1)] == 0.0
    mapping = matching.match_tables(cols, pairs, WEIGHTS, value=0.5)
    assert tuples(mapping.select("column_a", "column_b")) == [("extra", None), ("name", "names"), ("year", "years")]
    truth = frame("pair string, column_a string, column_b string", [("p", "name", "names"), ("p", "year", "names")])
    assert matching.mapping_accuracy(mapping, truth).first()["accuracy"] == pytest.approx(1 / 3)
    trials = frame("trial int, w_d_col double, w_s_col double, w_s_ctx double, w_s_field double, threshold double", [(1, 1.0, 1.0, 1.0, 1.0, 0.5), (2, 1.0, 1.0, 1.0, 1.0, -1.0)])
    got = {r.trial: r.accuracy for r in matching.sweep(cols, pairs, truth, trials).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0}
    ways = frame("trial int, w_d_col double, w_s_col double, w_s_ctx double, w_s_field double, threshold double, method string, z double, window int, n_fields int", [
        (1, 1.0, 1.0, 1.0, 1.0, 0.0, "cluster", 0.0, 0, 2), (2, 1.0, 1.0, 1.0, 1.0, 0.0, "spread", -9.0, 0, 1), (3, 1.0, 1.0, 1.0, 1.0, 0.5, "fixed", 0.0, 1, 2),
    ])
    many = matching.sweep(matching.context_vectors(cols.drop("ctx_emb"), [0, 1]), pairs, truth, ways, [0, 1])
    got = {r.trial: r.accuracy for r in many.collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: pytest.approx(1 / 3)}
    assert tuples(matching.best_trial(many)) == [(1, pytest.approx(1 / 3))]


def test_one_description_serves_every_window_and_number(frame):
    """Contexts and samples of a wide description hold those of the narrower ones, over block ends and with null sheets."""
    rng = random.Random(5)
    rows = [("t", rng.choice(["s", "u", None]), i if i != 11 else None, f"c{i}", [rng.random(), rng.random()]) for i in range(40)]
    df = frame("table string, sheet string, position int, column string, emb array<double>", rows)
    whole = {r["column"]: r.ctx_embs for r in matching.context_vectors(df, [1, 3, 7], block=5).collect()}
    assert len(whole) == 40
    for k, w in enumerate((1, 3, 7)):
        single = {r["column"]: r.ctx_emb for r in matching.context_vectors(df, w).collect()}
        for _, sheet, at, c, own in rows:
            near = [own] if at is None else [e for _, s, p, _, e in rows if s == sheet and p is not None and abs(p - at) <= w]
            assert np.allclose(whole[c][k], np.mean(near, axis=0)) and np.allclose(single[c], whole[c][k])
    values = frame("table string, column string, value string", [("t", f"c{i}", f"v{j}") for i in range(40) for j in range(i % 6)])
    spell = lambda c: F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: (F.length(c) - F.length(F.replace(c, d, F.lit("")))).cast("double"))
    seven = {r["column"]: r for r in matching.fingerprints(df.drop("emb"), values, spell, 7, [1, 2]).collect()}
    three = {r["column"]: r for r in matching.fingerprints(df.drop("emb"), values, spell, 3, 2).collect()}
    for i in range(40):
        assert three[f"c{i}"].sample_embs == seven[f"c{i}"].sample_embs[:3] and three[f"c{i}"].ctx_emb == seven[f"c{i}"].ctx_embs[1]
    assert three["c0"].sample_embs == []


def test_merge_sections(frame):
    """Two sheet ranges that ask the same: one question each, rows told apart by their section."""
    rows = [(s, f"s{s}", s * 10 + k, q, f"{q} {s}", 100 + s) for s in range(4) for k, q in enumerate(("Revenue total", "Head count"))] + [(1, "s1", 19, "Only once", "x", 1)]
    cells = frame("sheet_no int, sheet string, position int, column string, value string, key int", rows)
    sections = frame("section string, lo int, hi int", [("one", 0, 1), ("two", 2, 3)])
    letters = F.array(*[F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"])
    spell = lambda c: F.transform(letters, lambda d: (F.length(c) - F.length(F.replace(F.lower(c), d, F.lit("")))).cast("double"))
    merged, mapping = matching.merge_sections(cells, sections, ["one", "two"], spell, WEIGHTS, value=0.5)
    assert tuples(mapping) == [("Head count", "Head count"), ("Only once", None), ("Revenue total", "Revenue total")]
    got = {(r["table"], r["column"]): r.n for r in merged.groupBy("table", "column").agg(F.count("*").alias("n")).collect()}
    assert got == {("one", "Head count"): 2, ("one", "Revenue total"): 2, ("two", "Head count"): 2, ("two", "Revenue total"): 2, ("one", "Only once"): 1}


def test_long_chains(frame):
    """Many tables, a question that pauses, and a mapping that is not one to one."""
    steps = []
    for k in range(9):
        rows = [(f"q{k}", f"q{k + 1}"), ("r" if k != 4 else None, "r")]
        steps.append((f"t{k}", f"t{k + 1}", frame("column_a string, column_b string", rows)))
    got = tuples(matching.chain_mappings(steps))
    assert tuple(f"q{k}" for k in range(10)) in got
    assert ("r",) * 5 + (None,) * 5 in got and (None,) * 5 + ("r",) * 5 in got and len(got) == 3
    with pytest.raises(ValueError, match="two partners"):
        matching.chain_mappings([("a", "b", frame("column_a string, column_b string", [("x", "y"), ("x", "z")]))])


def test_sections(frame):
    cells = frame("sheet_no int, column string", [(0, "a"), (1, "b"), (2, "c"), (5, "d")])
    sections = frame("section string, lo int, hi int", [("first", 0, 1), ("second", 1, 2)])
    assert tuples(matching.section_tables(cells, sections).select("table", "column")) == [("first", "a"), ("first", "b"), ("second", "b"), ("second", "c")]


def test_constant_costs_become_zero(frame):
    cols = matching.context_vectors(columns_frame(frame, {"a": [("k", X)], "b": [("k", X)]}), 1)
    pairs = frame("pair string, a string, b string", [("p", "a", "b")])
    assert tuples(matching.cost_pairs(matching.cost_arrays(cols, pairs, WEIGHTS)).select("cost")) == [(0.0,)]


def test_two_means_split(frame):
    costs = frame("pair string, cost array<double>", [("p", [0.0, 0.1, 0.15]), ("p", [0.9, 1.0])])
    assert tuples(matching.threshold(costs, "cluster")) == [("p", 0.15)]
    flat = [0.0, 0.1, 0.15, 0.9, 1.0]
    assert matching.threshold(costs, "spread", z=2.0).first()["threshold"] == pytest.approx(np.mean(flat) + 2 * np.std(flat))


def test_context_stays_in_its_sheet(frame):
    df = frame("table string, sheet string, position int, emb array<double>", [("t", "s", 0, [0.0]), ("t", "s", 1, [2.0]), ("t", "u", 2, [10.0])])
    assert tuples(matching.context_vectors(df, 1).select("position", "ctx_emb")) == [(0, [1.0]), (1, [1.0]), (2, [10.0])]


def test_samples(frame):
    long = frame("table string, column string, value string", [("t", "a", v) for v in ("x", "y", "x", None)] + [("t", "b", str(i)) for i in range(50)])
    one = {r["column"]: r.samples for r in matching.sample_values(long, 4).collect()}
    assert len(one["a"]) == 4 and set(one["a"]) == {"x", "y"} and len(set(one["b"])) == 4
    assert one == {r["column"]: r.samples for r in matching.sample_values(long, 4).collect()}


def test_short_names_and_blocks(frame, monkeypatch):
    """Against all pairs, with names of one to three letters, repeats, nulls, and many blocks and parts."""
    from surveyloom.functions.similarity import jaro_batch

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ABÉ ") for _ in range(rng.randint(1, 7)))
    pool = [(word() + rng.choice(["", " LTD", " CO"]), k) for k in range(150)] + [(None, 7), ("AB", 900), ("AB", 3)]
    names = {word() for _ in range(60)} | {"A", "AB", "ABA"}
    monkeypatch.setattr(resolve, "SEARCH_BLOCK", 17)
    monkeypatch.setattr(resolve, "POOL_PART", 40)
    monkeypatch.setattr(resolve, "SCORE_BATCH", 13)
    first = {}
    for m, k in pool:
        if m is not None:
            first[m] = min(first.get(m, k), k)
    for finite in (False, True):
        want = {}
        for n in names:
            stem = n[: len(n) * 4 // 5]
            hits = [m for m in first if stem and stem in m]
            if not hits:
                continue
            whole, prefix = jaro_batch(hits, [n] * len(hits)), jaro_batch([m[: len(n)] for m in hits], [n] * len(hits))
            gap = np.array([abs(len(m) - len(n)) for m in hits], dtype=float)
            with np.errstate(divide="ignore"):
                total = np.sqrt(whole * whole + 4 * prefix * prefix + (1 / (1 + gap) if finite else 1 / gap) ** 2)
            want[n] = max(zip(total, [-first[m] for m in hits], hits))[2]
        got = resolve.best_name_match(frame("name string", [(n,) for n in names] + [(None,)]), frame("match string, pool_order int", pool), finite)
        assert {r.name: r.match for r in got.collect()} == want


# -- chains ------------------------------------------------------------------------------------
def test_chain_and_merge(frame):
    m1 = frame("column_a string, column_b string", [("a1", "b1"), ("a2", None), (None, "b3")])
    m2 = frame("column_a string, column_b string", [("b1", "c1"), ("b3", None), (None, "c2")])
    chain = matching.chain_mappings([("a", "b", m1), ("b", "c", m2)])
    assert tuples(chain) == [("a1", "b1", "c1"), ("a2", None, None), (None, "b3", None), (None, None, "c2")]
    names = matching.canonical_names(chain, ["a", "b", "c"])
    assert tuples(names) == [("a", "a1", "c1"), ("a", "a2", "a2"), ("b", "b1", "c1"), ("b", "b3", "b3"), ("c", "c1", "c1"), ("c", "c2", "c2")]
    cells = frame("table string, column string, value string", [("a", "a1", "x"), ("c", "c1", "y"), ("c", "zz", "z")])
    assert tuples(matching.merge_tables(cells, names).select("table", "column", "value")) == [("a", "c1", "x"), ("c", "c1", "y")]
    gaps = frame("a string, b string, c string", [("q", "q", None), ("r", None, "r"), (None, "s", "s")])
    assert tuples(matching.validity_range(gaps, ["a", "b", "c"])) == [("q", "a", "b"), ("r", "c", "c"), ("s", "b", "c")]


def test_manual_mapping(frame):
    manual = frame("x__column string, x__sheet string, y__column string, y__sheet string", [("q1", "s", "p1", "t"), (None, None, None, None), ("q1", "s", None, None)])
    made = matching.import_mapping(manual, ["x", "y"])
    assert len(tuples(made)) == 2
    assert tuples(matching.repeated_entries(made, ["x", "y"])) == [("x", "column=q1|sheet=s|value=response", 2)]
