"""Scores, indicators, states and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.operators.ordered import join_keys


# -- rhetoric and action -----------------------------------------------------------
def first_labels(labels: DataFrame, keys: list[str], question: str = "column") -> DataFrame:
    """First non-null label per (key, question, model) by position, null if there is none."""
    first = F.min_by("label", F.when(F.col("label").isNotNull(), F.struct(F.col("pos").isNull().alias("no_pos"), "pos")))
    return labels.groupBy(*keys, question, "model").agg(first.alias("label"))


def label_score(labels: DataFrame, keys: list[str], points: tuple, question: str = "column", vague: bool = False, out: str = "score") -> DataFrame:
    """Points over answered questions, one row per key.

    Each (question, model) with a label counts as answered. With ``vague`` a
    commitment without specificity adds a point and counts once, when both its
    models answered.
    """
    models = sorted({m for m, _, _ in points})
    value = F.lit(0.0)
    for model, label, p in points:
        value = value + F.when((F.col("model") == model) & (F.col("label") == label), p).otherwise(0.0)
    counted = (F.col("model").isin(*models) & F.col("label").isNotNull()).cast("int")
    if not vague:
        return labels.groupBy(*keys).agg(F.sum(value).alias("_p"), F.sum(counted).alias("_n")).select(
            *keys, F.when(F.col("_n") > 0, F.col("_p") / F.col("_n")).otherwise(0.0).alias(out)
        )
    is_model = lambda m: F.max(F.when(F.col("model") == m, F.col("label")))
    per_question = labels.groupBy(*keys, question).agg(
        F.sum(value).alias("_p"), F.sum(counted).alias("_n"),
        is_model("climate_commitment").alias("_commit"), is_model("climate_specificity").alias("_spec"),
    )
    both = F.col("_commit").isNotNull() & F.col("_spec").isNotNull()
    hit = both & (F.col("_commit") == "yes") & (F.col("_spec") == "non")
    return per_question.groupBy(*keys).agg(
        F.sum(F.col("_p") + hit.cast("double")).alias("_p"), F.sum(F.col("_n") + both.cast("int")).alias("_n")
    ).select(*keys, F.when(F.col("_n") > 0, F.col("_p") / F.col("_n")).otherwise(0.0).alias(out))


def gap_scores(labels: DataFrame, keys: list[str], rhetoric_questions: Column, action_questions: Column, question: str = "column") -> DataFrame:
    """Rhetoric, action and their gap for every key of ``labels``; 0 where nothing was labelled (null label)."""
    rhetoric = label_score(labels.filter(rhetoric_questions), keys, V.RHETORIC_POINTS, question, True, "rhetoric")
    action = label_score(labels.filter(action_questions), keys, V.ACTION_POINTS, question, False, "action")
    both = join_keys(join_keys(labels.select(*keys).distinct(), rhetoric, keys, "left"), action, keys, "left")
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rhetoric", "action")]
    return both.select(*keys, *filled).withColumn("gap", F.col("rhetoric") - F.col("action"))


def score_means(scores: DataFrame, by: str, measures: list[str], min_rows: int = 1) -> DataFrame:
    """Group means; groups that are null, contain ``None`` or are too small are left out."""
    named = scores.filter(F.col(by).isNotNull() & ~F.col(by).cast("string").contains("None"))
    return named.groupBy(by).agg(*[F.avg(m).alias("avg_" + m) for m in measures], F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)


def before_after(scores: DataFrame, by: str, measure: str, year: str, cut: int, more_than: int = 10) -> DataFrame:
    """Mean before and from the cut year per group, both with more than the given rows."""
    early = F.col(year) < cut
    out = scores.groupBy(by).agg(
        F.avg(F.when(early, F.col(measure))).alias("pre"), F.avg(F.when(~early, F.col(measure))).alias("post"),
        F.count(F.when(early, 1)).alias("n_pre"), F.count(F.when(~early, 1)).alias("n_post"),
    ).filter((F.col("n_pre") > more_than) & (F.col("n_post") > more_than))
    return out.withColumn("change", F.col("post") - F.col("pre"))


def score_report(scores: DataFrame, measures: list[str], year: str, groups: list[str], cut: int | Column, min_rows: int = 50, more_than: int = 10) -> DataFrame:
    """Means by year, by each group, before and from a cut, by both, and overall, out of one scan.

    ``kind, key, period, avg_<measure>..., n``. ``kind`` is ``time``, the name of a group
    column, ``<group>_change``, ``before_after`` or ``overall``. Rows without a year stay out.
    Groups that are null, contain ``None`` or have less than ``min_rows`` rows are left
    out; the change of a group also needs more than ``more_than`` rows on both sides.
    """
    rows = scores.filter(F.col(year).isNotNull()).select(year, *groups, F.when(F.col(year) < cut, "before").otherwise("after").alias("_period"), *measures)
    every = [year, *groups, "_period"]
    wanted = [[year], *[[g] for g in groups], *[[g, "_period"] for g in groups], ["_period"], []]
    report = rows.groupingSets([[F.col(c) for c in s] for s in wanted], *[F.col(c) for c in every]).agg(
        *[F.avg(m).alias("avg_" + m) for m in measures], F.count(F.lit(1)).alias("n"), *[(F.grouping(c) == 0).alias("_has_" + c) for c in every])
    kind, key = F.when(F.col("_has_" + year), "time"), F.when(F.col("_has_" + year), F.col(year).cast("string"))
    for g in groups:
        has = F.col("_has_" + g)
        kind = kind.when(has & F.col("_has__period"), g + "_change").when(has, g)
        key = key.when(has, F.col(g).cast("string"))
    kind = kind.when(F.col("_has__period"), "before_after").otherwise("overall")
    named = report.select(kind.alias("kind"), key.alias("key"), F.when(F.col("_has__period"), F.col("_period")).alias("period"), *["avg_" + m for m in measures], "n")
    of_group = F.col("kind").isin(*groups, *[g + "_change" for g in groups])
    # One or two rows per group: its sides, or the group itself.
    own = Window.partitionBy("kind", "key")
    sized = named.withColumn("_all", F.sum("n").over(own)).withColumn("_least", F.min("n").over(own)).withColumn("_sides", F.count(F.lit(1)).over(own))
    known = F.col("key").isNotNull() & ~F.col("key").contains("None") & (F.col("_all") >= min_rows)
    whole = F.col("period").isNull() | ((F.col("_sides") == 2) & (F.col("_least") > more_than))
    return sized.filter(~of_group | F.coalesce(known & whole, F.lit(False))).drop("_all", "_least", "_sides")


# -- indicators --------------------------------------------------------------------
def indicator(cond: Column) -> Column:
    """1 where the condition holds, else 0 (null included)."""
    return F.when(cond, 1).otherwise(0)


def action_indicators(answers: DataFrame, labels: DataFrame, keys: list[str], questions: tuple = V.ANSWER_QUESTIONS, wanted: tuple = V.LABEL_INDICATORS) -> DataFrame:
    """The 0/1 indicators of each key: a question answered ``Yes``, a model that gave the label.

    ``answers``: ``*keys, column, value``, where the column begins with the question code
    and a low line; ``labels``: ``*keys, model, label``. A key with only answers or only
    labels has 0 in the others; null keys are a key.
    """
    flag = lambda cond: F.coalesce(F.max(cond.cast("int")), F.lit(0))
    asked = answers.groupBy(*keys).agg(*[
        flag((F.substring_index("column", "_", 1) == code) & (F.col("value") == "Yes")).alias(name) for name, code in questions])
    said = labels.groupBy(*keys).agg(*[flag((F.col("model") == model) & (F.col("label") == label)).alias(name) for name, model, label in wanted])
    everyone = answers.select(*keys).union(labels.select(*keys)).distinct()
    out = join_keys(join_keys(everyone, asked, keys, "left"), said, keys, "left")
    names = [n for n, _ in questions] + [n for n, _, _ in wanted]
    return out.select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def maturity(df: DataFrame, indicators: list[str], out: str = "maturity") -> DataFrame:
    total = F.lit(0)
    for c in indicators:
        total = total + F.col(c)
    return df.withColumn(out, total)


def category_percentages(df: DataFrame, categories: tuple = V.INDICATOR_CATEGORIES) -> DataFrame:
    """Share of each category's indicators that are set, times 100."""
    out = df
    for name, members in categories:
        total = F.lit(0)
        for m in members:
            total = total + F.col(m)
        out = out.withColumn(name, total / len(members) * 100)
    return out


def adoption(df: DataFrame, by: list[str], indicators: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(i).alias(i) for i in indicators], F.count(F.lit(1)).alias("n"))


def governance_impact(df: DataFrame, year: str, flag: str, outcomes: list[str]) -> DataFrame:
    """In the latest year: outcome means with and without the flag, and the difference in percent."""
    latest = df.agg(F.max(year).alias("y")).scalar()
    rows = df.filter(F.col(year) == latest)
    sums = []
    for o in outcomes:
        sums += [F.avg(F.when(F.col(flag) == 1, F.col(o))).alias("w_" + o), F.avg(F.when(F.col(flag) == 0, F.col(o))).alias("n_" + o)]
    one = rows.agg(*sums)
    entries = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col("w_" + o).alias("with_flag"), F.col("n_" + o).alias("without_flag")) for o in outcomes])
    change = F.when(F.col("without_flag") > 0, (F.col("with_flag") / F.col("without_flag") - 1) * 100).otherwise(F.lit(float("inf")))
    return one.select(F.explode(entries).alias("e")).select("e.*").withColumn("pct_change", change)


def sentiment_trend(df: DataFrame, by: str, label: str, positive: str = "opportunity", negative: str = "risk", neutral: str = "neutral") -> DataFrame:
    """Counts, percentages and the positive to negative ratio per period."""
    count = lambda v: F.sum((F.coalesce(F.col(label) == v, F.lit(False))).cast("long"))
    out = df.groupBy(by).agg(
        count(positive).alias("opportunity_count"), count(negative).alias("risk_count"), count(neutral).alias("neutral_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
    for c in ("opportunity", "risk", "neutral"):
        out = out.withColumn(c + "_pct", F.col(c + "_count") / F.col("total_count") * 100)
    return out.withColumn("opportunity_risk_ratio", F.when(F.col("risk_pct") != 0, F.col("opportunity_pct") / F.col("risk_pct")))


def label_share_trend(df: DataFrame, by: str, label: str, value: str) -> DataFrame:
    out = df.groupBy(by).agg(F.sum(F.coalesce(F.col(label) == value, F.lit(False)).cast("long")).alias("specific_count"), F.count(F.lit(1)).alias("total_count"))
    return out.withColumn("specificity_pct", F.col("specific_count") / F.col("total_count") * 100)


# -- states ------------------------------------------------------------------------
def maturity_state(n: Column, states: tuple = V.MATURITY_STATES) -> Column:
    out = None
    for at_most, name in states:
        if at_most is None:
            return out.otherwise(name)
        out = F.when(n <= at_most, name) if out is None else out.when(n <= at_most, name)
    return out


def transitions(states: DataFrame, entity: str, period: str, state: str) -> DataFrame:
    """Observed moves between successive periods and their share of the moves from a state.

    ``states`` has one row per (entity, period), so a window holds one entity's
    periods.
    """
    w = Window.partitionBy(entity).orderBy(period)
    moves = states.withColumn("to_state", F.lead(state).over(w)).filter(F.col("to_state").isNotNull())
    counts = moves.groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    # One row per pair of states, so the window is over a few rows; a null state is a state.
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return counts.select("from_state", "to_state", "n", (F.col("n") / total).alias("share"))


def paths(states: DataFrame, entity: str, period: str, state: str, min_periods: int = 2, sep: str = " -> ") -> DataFrame:
    """State sequence per entity as text: ``entity, path`` (one entry per period)."""
    listed = F.sort_array(F.collect_list(F.struct(period, state)))
    out = states.groupBy(entity).agg(listed.getField(state).alias("_s")).filter(F.size("_s") >= min_periods)
    return out.select(entity, F.array_join("_s", sep).alias("path"))


def path_counts(paths_df: DataFrame, by: list[str] = ()) -> DataFrame:
    return paths_df.groupBy(*by, "path").agg(F.count(F.lit(1)).alias("n"))
