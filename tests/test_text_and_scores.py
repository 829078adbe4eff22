from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import by_value, tuples
from surveyloom.functions import fixed_values as V
from surveyloom.operators import bayes, models, scores, stats, textwork

by_value(__name__)


def load_counting():
    """Scores by the share of the letter a; fails on texts that must not be scored again."""
    def score(texts):
        assert "seen" not in texts
        return [{"yes": min(t.count("a") / max(len(t), 1), 1.0), "no": 1 - min(t.count("a") / max(len(t), 1), 1.0)} for t in texts]
    return score


# -- text ------------------------------------------------------------------------------------
def test_classify_scores_only_unseen_distinct_texts(frame):
    df = frame("k int, t string", [(1, "aaa"), (2, "aaa"), (3, "bbb"), (4, ""), (5, None), (6, "seen")])
    stored = frame("text_key string, model string, label string, scores map<string,double>", []).unionByName(
        df.filter("k = 6").select(F.sha2("t", 256).alias("text_key"), F.lit("m").alias("model"), F.lit("no").alias("label"), F.create_map(F.lit("no"), F.lit(1.0)).alias("scores"))
    )
    results = textwork.classify(df, "t", {"m": load_counting}, stored)
    assert results.count() == 3
    got = {r.k: r.label for r in textwork.attach_results(df, "t", results).collect()}
    assert got == {1: "yes", 2: "yes", 3: "no", 4: None, 5: None, 6: "no"}
    assert textwork.check_labels(results, {"m": ("yes", "no")}).count() == 0
    assert tuples(textwork.check_labels(results, {"m": ("yes",)})) == [("m", "no", 2)]


def test_stored_results_survive_a_repeated_run(spark, frame, tmp_path):
    df, path = frame("t string", [("abc",), ("a",), ("a",), (None,)]), str(tmp_path / "results")
    score = lambda model, texts: textwork.score_texts(texts, {model: load_counting})
    assert textwork.stored_results(spark, path).count() == 0
    for _ in range(2):
        assert textwork.score_and_store(df, "t", ["m"], score, path, "one").count() == 2
    # A broken run has written its rows but was not entered: nobody reads them.
    half = textwork.score_texts(textwork.distinct_texts(frame("t string", [("zzz",)]), "t"), {"m": load_counting})
    half.select("text_key", "label", "scores", "model", F.lit("broken").alias("run")).write.mode("append").partitionBy("model", "run").parquet(path + "/results")
    assert textwork.stored_results(spark, path).count() == 2
    more = df.unionByName(frame("t string", [("zzz",), ("b",)]))
    assert textwork.score_and_store(more, "t", ["m", "n"], score, path, "two").count() == 8
    rows = textwork.stored_results(spark, path).collect()
    assert len(rows) == len({(r.text_key, r.model) for r in rows}) == 8
    # A run that is repeated with more texts keeps those it had.
    assert textwork.score_and_store(df.unionByName(frame("t string", [("q",)])), "t", ["m"], score, path, "one").count() == 3
    assert textwork.stored_results(spark, path).count() == 9


def test_counting_models(frame):
    """Against the formula, with a model without rows, a label without rows, unknown tokens and texts without tokens."""
    vocabulary = {"m": ("x", "y", "never"), "k": ("u", "v"), "none": ("a", "b")}
    train = [("cat cat dog", "x", "u"), ("dog fish", "y", "u"), ("fish Fish bird", "y", None), ("owl", None, "v"), ("owl cat", "else", "v")]
    model = bayes.fit(frame("t string, m string, k string, none string", [(*r, None) for r in train]), "t", vocabulary)
    texts = ["cat", "fish, bird! unheard", "unheard", "", "dog owl owl"]
    got = {(r.text_key, r.model): r for r in bayes.label_scores(frame("text_key string, text string", [(t, t) for t in texts]), model).collect()}
    assert len(got) == 2 * len(texts)
    for name, at in (("m", 1), ("k", 2)):
        docs = [(re.findall(r"\w+", r[0].lower()), r[at]) for r in train if r[at] in vocabulary[name]]
        seen = {w for words, _ in docs for w in words}
        for t in texts:
            logs = {}
            for lb in dict.fromkeys(lb for _, lb in docs):
                own = [w for words, other in docs if other == lb for w in words]
                logs[lb] = math.log(sum(o == lb for _, o in docs) / len(docs)) + sum(math.log((own.count(w) + 1) / (len(own) + len(seen))) for w in re.findall(r"\w+", t) if w in seen)
            whole = sum(math.exp(v) for v in logs.values())
            row = got[t, name]
            assert row.scores == {lb: pytest.approx(math.exp(v) / whole) for lb, v in logs.items()}
            assert row.label == max(logs, key=lambda lb: (round(logs[lb], 9), -vocabulary[name].index(lb))) and row.score == pytest.approx(max(row.scores.values()))


def test_texts_are_scored_where_they_lie(spark, frame):
    """Frequent tokens are held, rare ones joined; wherever the line is drawn, scores are the same, and tokens of held ones meet no shuffled join."""
    words = [f"w{i}" for i in range(12)]
    train = [(" ".join(words[: k + 1] * (1 + k % 2)), "xy"[k % 2], "uv"[k % 3 == 0]) for k in range(12)]
    model = bayes.fit(frame("t string, m string, k string", train), "t", {"m": ("x", "y"), "k": ("u", "v")})
    texts = frame("text_key string, text string", [("a", "w0 w11 w11 W3, w5"), ("b", "unheard"), ("c", ""), ("d", "w11 w10"), ("e", " ".join(words))])
    rows = lambda held: {(r.text_key, r.model): (r.label, {k: round(v, 12) for k, v in r.scores.items()}) for r in bayes.label_scores(texts, model, held).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(rows(10**6)) == 10 and rows(10**6) == rows(0) == rows(30)
        assert "SortMergeJoin" not in bayes.label_scores(texts, model)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_shuffles_texts_once(frame, tmp_path):
    """What a model still has to score is read as it is, without another join of texts and stored keys."""
    plans = []
    def score(model, texts):
        plans.append(texts._jdf.queryExecution().toString())
        return textwork.score_texts(texts, {model: load_counting})
    df, path = frame("t string", [("abc",), ("a",), ("a",), (None,), ("",)]), str(tmp_path / "results")
    assert textwork.score_and_store(df, "t", ["m"], score, path, "one").count() == 2
    assert textwork.score_and_store(df.unionByName(frame("t string", [("b",)])), "t", ["m", "n"], score, path, "two").count() == 6
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_triples_take_time_in_proportion(frame):
    """The text is cut into characters once; also with characters beyond two bytes and fewer than three of them."""
    texts = {1: "aXé\n👍b", 2: "ab", 3: "", 4: None, 5: "xyz" * 100_000}
    rows = textwork.trigram_rows(frame("k int, t string", list(texts.items())), "k", "t").collect()
    spelled = lambda g: None if g is None else "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0))
    got = {k: {spelled(r.gram) for r in rows if r.k == k} for k in texts}
    assert got[1] == {"axé", "xé ", "é 👍", " 👍b"} and got[2] == got[3] == got[4] == {None} and got[5] == {"xyz", "yzx", "zxy"}
    assert {r.k: r.n for r in rows} == {1: 4, 2: None, 3: None, 4: None, 5: 3}


def test_name_cosine(frame):
    rows = frame("a string, b string", [("Abc", "abc"), ("abcabc", "abcx"), ("q", None), ("", "")])
    def plain(a, b):
        grams = lambda t: Counter(("^^" + (t or "").lower() + "$$")[i:i + 3] for i in range(len(t or "") + 2))
        x, y = grams(a), grams(b)
        return sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    for r in rows.select("a", "b", textwork.ngram_cosine(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == pytest.approx(plain(r.a, r.b))
    # Long texts too, in time in proportion to their length.
    rng = np.random.default_rng(1)
    a, b = ("".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 60_000)) for _ in range(2))
    x, y = (Counter(map("".join, zip(t, t[1:], t[2:]))) for t in ("^^" + a + "$$", "^^" + a[:40_000] + b + "$$"))
    want = sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    assert [r.c for r in frame("a string, b string", [(a, a[:40_000] + b)] * 3).select(textwork.ngram_cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(want)] * 3
    for n in (1, 2, 4):
        assert frame("a string, b string", [("abca", "abca")]).select(textwork.ngram_cosine(F.col("a"), F.col("b"), n)).first()[0] == pytest.approx(1.0)


def test_score_report(frame):
    """Five kinds of rows; groups that are small, null or hold None, and changes without one side are left out."""
    rows = [(2014 + i % 3, "a", "n", float(i)) for i in range(60)] + [(2014, "b", "n", 1.0)] * 55 + [(2016, None, "None, x", 9.0)] * 55 + [(None, "a", "n", 1e9)] + [(2015, "c", "s", 2.0)] * 3
    got = {(r.kind, r.key, r.period): (r.avg_v, r.n) for r in scores.score_report(frame("y int, g string, h string, v double", rows), ["v"], "y", ["g", "h"], 2015).collect()}
    known = [r for r in rows if r[0] is not None]
    mean = lambda keep: (pytest.approx(np.mean([r[3] for r in known if keep(r)])), sum(keep(r) for r in known))
    want = {("time", str(y), None): mean(lambda r, y=y: r[0] == y) for y in (2014, 2015, 2016)}
    want |= {("before_after", None, "before"): mean(lambda r: r[0] < 2015), ("before_after", None, "after"): mean(lambda r: r[0] >= 2015), ("overall", None, None): mean(lambda r: True)}
    want |= {("g", k, None): mean(lambda r, k=k: r[1] == k) for k in "ab"} | {("h", "n", None): mean(lambda r: r[2] == "n")}
    want |= {(f"{c}_change", k, p): mean(lambda r, at=at, k=k, p=p: r[at] == k and (r[0] < 2015) == (p == "before")) for c, at, k in (("g", 1, "a"), ("h", 2, "n")) for p in ("before", "after")}
    assert got == want


def test_languages_and_translation(frame):
    known = frame("t string, l string", [("the house and the street", "en"), ("the tree and the river", "en"), ("das haus und die strasse", "de"), ("der baum und der fluss", "de")])
    profile = textwork.language_profile(known, "t", "l")
    df = frame("k int, t string", [(1, "the other street"), (2, "und das andere haus"), (3, "zq"), (4, None), (5, "und das andere haus")])
    translated = textwork.translate(df, "t", lambda: (lambda texts, langs: [t.upper() + "/" + la for t, la in zip(texts, langs)]), profile)
    out = {r.k: (r.t, r.lang) for r in textwork.translate_column(df, "t", translated, extend=False).collect()}
    assert out == {1: ("the other street", "en"), 2: ("UND DAS ANDERE HAUS/de", "de"), 3: ("zq", "en"), 4: (None, None), 5: ("UND DAS ANDERE HAUS/de", "de")}
    stored = translated.select("text_key", F.lit("stored").alias("translation"))
    reused = textwork.translate(df, "t", lambda: (lambda texts, langs: 1 / 0), profile, results=stored)
    assert {r.k: r.translation for r in textwork.translate_column(df, "t", reused).collect()}[2] == "stored"


def test_embed(frame):
    df = frame("t string", [("account number",), ("account no",), ("zebra",), (None,)])
    rows = {r.t: np.array(r.emb) for r in textwork.embed(df, "t").collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in rows.values())
    assert rows["account number"] @ rows["account no"] > rows["account number"] @ rows["zebra"]
    made = textwork.embed_with(df, "t", lambda: (lambda texts: [[float(len(t))] for t in texts]))
    assert made.count() == 3


# -- scores ------------------------------------------------------------------------------------
def test_gap_scores(frame):
    schema = "k int, column string, pos int, model string, label string"
    labels = scores.first_labels(frame(schema, [
        (1, "q1", 0, "environmental_claims", "yes"), (1, "q1", 1, "environmental_claims", "no"), (1, "q1", 0, "climate_sentiment", None), (1, "q1", 1, "climate_sentiment", "risk"),
        (1, "q1", 0, "climate_commitment", "yes"), (1, "q1", 0, "climate_specificity", "non"),
        (1, "q2", 0, "netzero_reduction", "net-zero"), (1, "q2", 0, "renewable", "LABEL_0"), (1, "q2", 0, "climate_specificity", "spec"),
        (2, "q2", 0, "transition", "LABEL_1"),
    ]), ["k"])
    got = {r.k: (r.rhetoric, r.action, r.gap) for r in scores.gap_scores(labels, ["k"], F.col("column") == "q1", F.col("column") == "q2").collect()}
    assert got[1] == (pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3 - 1.0))
    assert got[2] == (0.0, 1.0, -1.0)


def test_group_means_leave_out_unknown(frame):
    df = frame("g string, m double, y int", [("a", 1.0, 2014), ("a", 3.0, 2016), (None, 9.0, 2014), ("None, x", 9.0, 2014), ("b", 1.0, 2014)])
    assert tuples(scores.score_means(df, "g", ["m"], 2)) == [("a", 2.0, 2)]
    assert tuples(scores.before_after(df, "g", "m", "y", 2015, more_than=0)) == [("a", 1.0, 3.0, 1, 1, 2.0)]


def test_states(frame):
    df = frame("k int, y int, n int", [(1, 1, 0), (1, 2, 2), (1, 4, 2), (2, 1, 7), (3, 1, 4), (3, 2, 6)])
    states = df.select("k", "y", scores.maturity_state(F.col("n")).alias("s"))
    assert tuples(scores.transitions(states, "k", "y", "s")) == [("Advanced", "Leader", 1, 1.0), ("Beginner", "Developing", 1, 1.0), ("Developing", "Developing", 1, 1.0)]
    assert tuples(scores.paths(states, "k", "y", "s")) == [(1, "Beginner -> Developing -> Developing"), (3, "Advanced -> Leader")]


def test_categories_and_governance(frame):
    names = [m for _, ms in V.INDICATOR_CATEGORIES for m in ms]
    df = frame(", ".join(f"{n} int" for n in names) + ", y int", [tuple(1 if n == "has_risk_process" else 0 for n in names) + (1,)])
    row = scores.category_percentages(df).first()
    assert row.risk_mgmt_pct == pytest.approx(100 / 3) and row.strategy_pct == 0.0
    flags = frame("y int, f int, o int", [(1, 1, 0), (2, 1, 1), (2, 1, 1), (2, 0, 1), (2, 0, 0)])
    assert tuples(scores.governance_impact(flags, "y", "f", ["o"])) == [("o", 1.0, 0.5, 100.0)]


# -- statistics ----------------------------------------------------------------------------------
def test_tests_on_small_groups(frame):
    df = frame("g string, v double", [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 8.0)])
    f = stats.anova(df, "g", "v").first()
    assert f.f == pytest.approx(3.0) and (f.df_between, f.df_within) == (1, 6) and f.p == pytest.approx(0.1340, abs=1e-3)
    t = stats.welch_tests(df, "g", "v", ["a", "b"]).first()
    assert t.t == pytest.approx(-math.sqrt(3)) and t.dof == pytest.approx(4.4118, abs=1e-3) and 0.1 < t.p < 0.2 and not t.significant
    u = stats.rank_sum_tests(df, "g", "v", ["a", "b"]).first()
    assert u.u == 3.0
    ci = {r.g: r for r in stats.mean_intervals(df, "g", "v").collect()}["a"]
    assert ci.ci_upper - ci["mean"] == pytest.approx(3.1824463 * math.sqrt(5 / 3 / 4))


def test_series(frame):
    x = [5.0, 3.0, 6.0, 2.0, 8.0, 4.0]
    df = frame("s string, t int, v double, n long", [("s", i, v, int(10 * v) % 7) for i, v in enumerate(x)])
    acf = {r.lag: r.acf for r in stats.autocorrelation(df, ["s"], "t", "v", 2).collect()}
    d = np.array(x) - np.mean(x)
    assert acf[0] == pytest.approx(1) and acf[2] == pytest.approx((d[:-2] @ d[2:]) / (d @ d))
    phi, c = np.polyfit(x[:-1], x[1:], 1)
    got = [r.forecast for r in stats.ar1_forecast(df, ["s"], "t", "v", 2).orderBy("t").collect()]
    assert got == [pytest.approx(c + phi * x[-1]), pytest.approx(c + phi * (c + phi * x[-1]))]
    ols = stats.lagged_ols(df, ["s"], "t", "v", "n").first()
    n = [int(10 * v) % 7 for v in x]
    beta = np.linalg.lstsq(np.column_stack([np.ones(5), x[:-1], n[:-1]]), np.array(x[1:]), rcond=None)[0]
    assert [ols.const, ols.beta_value, ols.beta_count] == [pytest.approx(b) for b in beta]
    glm = stats.scaled_regression(df.withColumn("w", F.col("n").cast("double")), "v", "w").first()
    assert glm.slope == pytest.approx(np.corrcoef(x, n)[0, 1])


def test_correlations(frame):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.5, 3.0), (3.0, 5.0, None), (4.0, 9.0, 1.0), (5.0, 9.5, 0.0)]
    df = frame("a double, b double, c double", rows)
    got = {(r.var_a, r.var_b): r for r in stats.correlation_table(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")].r == pytest.approx(np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1])
    assert got[("a", "c")].n == 4 and got[("a", "b")].stars in ("**", "***")
    ranks = tuples(stats.average_ranks(frame("a double", [(3.0,), (1.0,), (3.0,), (9.0,)]), ["a"]))
    assert ranks == [(1.0,), (2.5,), (2.5,), (4.0,)]
    assert [r.r for r in stats.correlation_table(df.select("a", "b"), ["a", "b"], "spearman").collect()] == [pytest.approx(1.0)]


def test_ranks_of_common_values_move_no_rows(spark, frame):
    """A value that many rows hold is looked up where they are; ranks are those of pandas."""
    values = [(float(i % 3) if i % 7 else None, float((i * i) % 30_011), float("nan") if i % 500 == 0 else -0.0 if i % 2 else 0.0) for i in range(20_000)]
    df = frame("a double, b double, c double", values)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.average_ranks(df, ["a", "b", "c"])
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # NaN is the greatest value here, so it is put as an infinite one.
    columns = [pd.Series([v[i] for v in values], dtype=float) for i in range(3)]
    columns[2] = columns[2].fillna(np.inf)
    want = sorted(zip(*[[None if pd.isna(x) else x for x in c.rank()] for c in columns]), key=repr)
    assert got == want


def test_centrality(frame):
    edges = frame("var_a string, var_b string, weight double", [("hub", x, 0.5) for x in "abc"] + [("a", "b", 0.3)])
    assert {r.node: r.degree for r in stats.degree_centrality(edges, 5).collect()}["hub"] == 0.75
    names = ["hub", "a", "b", "c"]
    m = np.zeros((4, 4))
    for i, j in ((0, 1), (0, 2), (0, 3), (1, 2)):
        m[i, j] = m[j, i] = 1
    w, v = np.linalg.eigh(m)
    want = dict(zip(names, np.abs(v[:, w.argmax()])))
    got = {r.node: r.centrality for r in stats.eigenvector_centrality(edges).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in names)


def test_shares(frame):
    df = frame("y int, b string, v double", [(1, "p", 1.0), (1, "q", 3.0), (2, "p", 1.0), (2, "q", 1.0), (4, "q", 5.0)])
    got = {(r.from_band, r.to_band): r.share for r in stats.marginal_transitions(df, "y", "b", F.col("v")).collect()}
    assert got[("p", "q")] == pytest.approx((0.25 * 0.5 + 0.5 * 1.0) / 2)
    post = {r.b: r.mean_share for r in stats.share_posterior(df, "b").collect()}
    assert post == {"p": pytest.approx(3 / 7), "q": pytest.approx(4 / 7)}


# -- models --------------------------------------------------------------------------------------
def test_clusters(frame):
    rows = [(10.0 + i % 3, 80.0, 5.0, 5.0, 5.0, 5.0, 3, "x") for i in range(10)] + [(90.0 + i % 3, 85.0, 5.0, 5.0, 5.0, 5.0 + i % 2, 9, "y") for i in range(10)]
    cats = [c for c, _ in V.INDICATOR_CATEGORIES]
    df = frame(", ".join(f"{c} double" for c in cats) + ", maturity int, sector string", rows)
    made, k = models.best_kmeans(models.scaled_features(df, cats[:2]), ks=range(2, 4))
    profile = models.cluster_profile(made, cats, "maturity", "sector")
    assert k == 2 and sorted(r.dominant_sector for r in profile.collect()) == ["x", "y"]
    assert "Strategic Leaders" in {r.name for r in profile.collect()}


def test_forest(frame):
    rows = [(y, s, int(s == "a"), int(s == "a")) for y in range(2015, 2021) for s in "ab" for _ in range(6)]
    df = frame("year int, sector string, f int, target int", rows)
    metrics, importances, adopted = models.forest_adoption(df, "year", "target", ["f"], ["sector"], 2019, 2015, 2022, 2020, trees=5)
    assert metrics.first().accuracy == 1.0 and importances.count() >= 3
    assert {r.year for r in adopted.collect()} == set(range(2015, 2023)) and adopted.filter("year = 2022").first().adoption_pct == 50.0


def test_unlabelled_and_unnamed_keys_keep_a_score(frame):
    rows = frame("k string, column int, pos long, model string, label string", [
        ("a", 0, 1, "environmental_claims", "yes"), ("b", 0, 2, "environmental_claims", None), (None, 1, 3, "netzero_reduction", "reduction"),
    ])
    got = scores.gap_scores(scores.first_labels(rows, ["k"]), ["k"], F.col("column") == 0, F.col("column") == 1)
    assert tuples(got) == [("a", 1.0, 0.0, 1.0), ("b", 0.0, 0.0, 0.0), (None, 0.0, 1.0, -1.0)]
    moves = scores.transitions(frame("e string, y int, s string", [("x", 1, None), ("x", 2, "lo"), ("y", 1, "lo"), ("y", 2, "hi")]), "e", "y", "s")
    assert tuples(moves) == [("lo", "hi", 1, 1.0), (None, "lo", 1, 1.0)]


def test_two_digit_years(frame):
    from surveyloom.functions import cells

    days = frame("t string", [("12/31/98",), ("01/02/69",), ("03/04/68",), ("1999-05-06",)])
    assert [str(r[0]) for r in days.select(cells.parse_date(F.col("t"))).collect()] == ["1998-12-31", "1969-01-02", "2068-03-04", "1999-05-06"]


def test_large_profiles_give_the_same_languages(frame):
    rng = random.Random(3)
    words = {"a": ["mora", "tile", "sun"], "b": ["grün", "mora", "日本語"], "c": ["tile", "qu", "𝒳𝒴𝒵"]}
    rows = [(lang, " ".join(rng.choices(words[lang], k=rng.randrange(1, 9)))) for lang in words for _ in range(20)] + [(None, "mora mora"), ("a", None)]
    known = frame("l string, t string", rows)
    texts = frame("text_key string, text string", [(str(i), t) for i, (_, t) in enumerate(rows)] + [("short", "mo"), ("none", None), ("strange", "zzzz")])
    profile = textwork.language_profile(known, "t", "l")
    held = tuples(textwork.detect_languages(texts, profile))
    assert held == tuples(textwork.detect_languages(texts, profile, held_values=0))
    assert len(held) == len(rows) + 3
    assert {dict(held)[k] for k in ("short", "none", "strange")} == {"en"}


def test_forests_share_features_and_spread_rows(frame, monkeypatch):
    """Forests of several targets are those of each alone; rows are dealt to as many tasks as they need."""
    rows = [(y, s, int(s == "a"), int(s == "a"), int(y % 2 == 0)) for y in range(2015, 2021) for s in "ab" for _ in range(6)]
    df = frame("year int, sector string, f int, t1 int, t2 int", rows).coalesce(1)
    rest = ("year", ["f"], ["sector"], 2019, 2015, 2022, 2020)
    together = models.forest_adoptions(df, rest[0], ["t1", "t2"], *rest[1:], trees=5)
    for target, found in zip(("t1", "t2"), together):
        alone = models.forest_adoption(df, rest[0], target, *rest[1:], trees=5)
        assert [tuples(x) for x in found] == [tuples(x) for x in alone]
    tasks, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models, "FOREST_ROWS", 10)
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, ds: tasks.append(ds.rdd.getNumPartitions()) or fit(self, ds))
    metrics, _, adopted = models.forest_adoption(df, rest[0], "t1", *rest[1:], trees=5)
    assert tasks == [5] and metrics.first().accuracy == 1.0 and adopted.filter("year = 2022").first().adoption_pct == 50.0


def test_metrics_of_counted_rows(frame):
    counted = frame("y double, h double, n long", [(1.0, 1.0, 3), (0.0, 1.0, 1), (1.0, 0.0, 2), (0.0, 0.0, 4)])
    spread = counted.selectExpr("y", "h", "explode(sequence(1, n)) AS i")
    assert models.binary_metrics(counted, "y", "h", "n").first() == models.binary_metrics(spread, "y", "h").first()
    assert tuple(models.binary_metrics(counted.limit(0), "y", "h", "n").first()) == (None, 0.0, 0.0, 0.0)
