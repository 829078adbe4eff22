"""Tests, regressions and correlations from aggregated moments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.functions.distributions import f_upper, normal_two_sided, t_two_sided
from surveyloom.operators.ordered import RANGE_ROWS, join_keys, running_totals
from surveyloom.session import cut_lineage


# -- group comparisons -----------------------------------------------------------
def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, mean, var`` (sample variance) of the non-null values."""
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA: ``f, df_between, df_within, p``; only one row per group meets."""
    m = moments(df, group, value)
    whole = m.agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    g = whole.select(F.struct("*").alias("g")).scalar()
    parts = m.withColumn("g", g).groupBy("g").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("g.grand"), F.lit(2))).alias("ss_between"))
    out = parts.select(
        (F.col("g.k") - 1).alias("df_between"), (F.col("g.N") - F.col("g.k")).alias("df_within"), "ss_between", F.col("g.ss_within").alias("ss_within")
    )
    out = out.withColumn("f", F.try_divide(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")))
    return out.select("f", "df_between", "df_within", f_upper(F.col("f"), F.col("df_between"), F.col("df_within")).alias("p"))


def t_factor(df_col: Column) -> Column:
    """Two-sided 95 % factor: exact up to 30 degrees of freedom, then a series around the normal factor."""
    table = F.array(*[F.lit(v) for v in V.T_FACTORS_95])
    z = V.Z_FACTOR_95
    series = F.lit(z) + (z**3 + z) / (4 * df_col) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df_col * df_col)
    return F.when(df_col <= len(V.T_FACTORS_95), F.get(table, (df_col - 1).cast("int"))).otherwise(series)


def mean_intervals(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group mean with its 95 % t interval."""
    half = t_factor(F.col("n") - 1) * F.sqrt(F.col("var") / F.col("n"))
    return moments(df, group, value).select(group, "n", "mean", (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"))


def welch_tests(df: DataFrame, group: str, value: str, groups: list[str]) -> DataFrame:
    """Welch t of every pair of the listed groups, Bonferroni at 5 %; works on one row of moments per group."""
    m = moments(df.filter(F.col(group).isin(*groups)), group, value)
    sums = []
    for i, g in enumerate(groups):
        own = F.col(group) == g
        sums += [F.max(F.when(own, F.col(c))).alias(f"_{c}{i}") for c in ("n", "mean", "var")]
    pairs = list(combinations(range(len(groups)), 2))
    entries = F.array(*[
        F.struct(
            F.lit(groups[i]).alias("group_a"), F.lit(groups[j]).alias("group_b"),
            *[F.col(f"_{c}{k}").alias(f"{c}{s}") for c in ("n", "mean", "var") for k, s in ((i, "a"), (j, "b"))],
        )
        for i, j in pairs
    ])
    rows = m.agg(*sums).select(F.explode(entries).alias("e")).select("e.*")
    va, vb = F.col("vara") / F.col("na"), F.col("varb") / F.col("nb")
    t = (F.col("meana") - F.col("meanb")) / F.sqrt(va + vb)
    dof = F.pow(va + vb, F.lit(2)) / (va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))
    out = rows.select("group_a", "group_b", t.alias("t"), dof.alias("dof"))
    p = t_two_sided(F.col("t"), F.col("dof"))
    return out.withColumn("p", p).withColumn("significant", F.col("p") * len(pairs) < 0.05)


def rank_sum_tests(df: DataFrame, group: str, value: str, groups: list[str]) -> DataFrame:
    """Mann-Whitney U of every pair of the listed groups, with the tie-corrected normal p.

    Values are counted per distinct value first; U of a pair is the sum over
    values of the count in a times the count below in b, ties halved. All pairs
    come out of one pass over the counted values.
    """
    cols = [f"c{i}" for i in range(len(groups))]
    counted = (
        df.filter(F.col(value).isNotNull() & F.col(group).isin(*groups)).groupBy(F.col(value).alias("v"))
        .agg(*[F.sum((F.col(group) == g).cast("long")).alias(c) for c, g in zip(cols, groups)])
    )
    run = running_totals(counted, "v", cols)
    pairs = list(combinations(range(len(groups)), 2))
    aggs = [F.sum(c).alias("n_" + c) for c in cols]
    for i, j in pairs:
        a, b, cum = F.col(cols[i]), F.col(cols[j]), F.col("cum_" + cols[j])
        aggs.append(F.sum(a * (cum - b) + a * b / 2.0).alias(f"u_{i}_{j}"))
        t = (a + b).cast("double")
        aggs.append(F.sum(t * t * t - t).alias(f"t_{i}_{j}"))
    one = run.agg(*aggs)
    entries = F.array(*[
        F.struct(
            F.lit(groups[i]).alias("group_a"), F.lit(groups[j]).alias("group_b"), F.col("n_" + cols[i]).cast("double").alias("na"),
            F.col("n_" + cols[j]).cast("double").alias("nb"), F.col(f"u_{i}_{j}").alias("u"), F.col(f"t_{i}_{j}").alias("ties"),
        )
        for i, j in pairs
    ])
    rows = one.select(F.explode(entries).alias("e")).select("e.*")
    n = F.col("na") + F.col("nb")
    mean = F.col("na") * F.col("nb") / 2
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)), sd)
    out = rows.select("group_a", "group_b", "u", z.alias("_z"))
    out = out.withColumn("p", normal_two_sided(F.col("_z"))).drop("_z")
    return out.withColumn("significant", F.col("p") * len(pairs) < 0.05)


# -- series ------------------------------------------------------------------------
def autocorrelation(series: DataFrame, by: list[str], time: str, value: str, lags: int = 10) -> DataFrame:
    """Autocorrelation of a short aggregated series for lags 0..``lags`` (one row per period expected)."""
    w = Window.partitionBy(*by).orderBy(time)
    numbered = series.select(*by, F.row_number().over(w).alias("_t"), (F.col(value) - F.avg(value).over(Window.partitionBy(*by))).alias("_x"))
    shifted = numbered.select(*by, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "_t", "_x")
    base = numbered.select(*by, (F.col("_t")).alias("_s"), F.col("_x").alias("_y"))
    # A null key is a group of its own.
    pairs = join_keys(shifted.withColumn("_s", F.col("_t") + F.col("lag")), base, [*by, "_s"])
    products = pairs.groupBy(*by, "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("_c"))
    total = numbered.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias("_c0"))
    return join_keys(products, total, by).select(*by, "lag", F.try_divide("_c", "_c0").alias("acf"))


def linear_trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def ar1_forecast(series: DataFrame, by: list[str], time: str, value: str, steps: int = 3) -> DataFrame:
    """First-order autoregression by least squares and its recursive point forecast, one row per step."""
    w = Window.partitionBy(*by).orderBy(time)
    lagged = series.withColumn("_before", F.lag(value).over(w))
    fit = lagged.groupBy(*by).agg(
        F.regr_slope(value, "_before").alias("phi"), F.regr_intercept(value, "_before").alias("const"),
        F.max_by(value, time).alias("_last"), F.max(time).alias("_time"),
    )
    path = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.struct(
        k.alias("step"),
        F.aggregate(F.sequence(F.lit(1), k), F.col("_last").cast("double"), lambda x, _: F.col("const") + F.col("phi") * x).alias("forecast"),
    ))
    return fit.select(*by, "phi", "const", "_time", F.explode(path).alias("p")).select(*by, (F.col("_time") + F.col("p.step")).alias(time), "phi", "const", "p.forecast")


def lagged_ols(series: DataFrame, by: list[str], time: str, value: str, count: str) -> DataFrame:
    """Value on its own and the count's previous-period value: coefficients from the normal equations."""
    w = Window.partitionBy(*by).orderBy(time)
    rows = series.select(*by, F.col(value).alias("y"), F.lag(value).over(w).alias("a"), F.lag(count).over(w).cast("double").alias("b")).dropna()
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.covar_pop("a", "a").alias("aa"), F.covar_pop("b", "b").alias("bb"), F.covar_pop("a", "b").alias("ab"),
        F.covar_pop("a", "y").alias("ay"), F.covar_pop("b", "y").alias("by_"), F.covar_pop("y", "y").alias("yy"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("beta_value", F.try_divide(F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab"), det))
    s = s.withColumn("beta_count", F.try_divide(F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab"), det))
    s = s.withColumn("const", F.col("my") - F.col("beta_value") * F.col("ma") - F.col("beta_count") * F.col("mb"))
    r2 = F.try_divide(F.col("beta_value") * F.col("ay") + F.col("beta_count") * F.col("by_"), F.col("yy"))
    # Errors from the residual variance and the inverse of the normal equations about the means.
    s = s.withColumn("r2", r2)
    residual = F.try_divide(F.col("n") * F.col("yy") * (1 - F.col("r2")), F.col("n") - 3)
    error = lambda c: F.sqrt(F.try_divide(residual * F.col(c), F.col("n") * det))
    return s.select(*by, "n", "const", "beta_value", "beta_count", "r2", error("bb").alias("se_value"), error("aa").alias("se_count"))


def scaled_regression(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """Gaussian regression of scaled y on scaled x over finite rows: slope, its error, t and p."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    s = df.filter(finite(y) & finite(x)).groupBy(*by).agg(F.corr(y, x).alias("slope"), F.count(F.lit(1)).alias("n"))
    dof = F.col("n") - 2
    err = F.sqrt((1 - F.col("slope") * F.col("slope")) / dof)
    out = s.filter("n > 2").withColumn("std_error", err).withColumn("t", F.try_divide("slope", "std_error"))
    return out.withColumn("p", t_two_sided(F.col("t"), dof))


# -- shares ------------------------------------------------------------------------
def share_posterior(df: DataFrame, band: str) -> DataFrame:
    """Posterior of each band's share under a uniform prior: alpha, beta, mean."""
    counts = df.groupBy(band).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    out = counts.withColumn("_t", total)
    return out.select(band, "n", (F.col("n") + 1).alias("alpha"), (F.col("_t") - F.col("n") + 1).alias("beta"), ((F.col("n") + 1) / (F.col("_t") + 2)).alias("mean_share"))


def marginal_transitions(df: DataFrame, year: str, band: str, value: Column) -> DataFrame:
    """Mean over successive years of the product of this year's and next year's band shares.

    Shares only, no observed moves; see ``scores.transitions`` for those. Rows without
    a year have no successor and stay out; a null band is a band.
    """
    sums = df.filter(F.col(year).isNotNull()).groupBy(year, band).agg(F.sum(value).alias("_s"))
    totals = sums.groupBy(year).agg(F.sum("_s").alias("_t"))
    shares = sums.join(totals, year).select(year, band, F.try_divide(F.col("_s").cast("double"), F.col("_t").cast("double")).alias("share"))
    # One row per year: the window is over the years only.
    years = totals.select(year).withColumn("_next", F.lead(year).over(Window.orderBy(year))).filter("_next is not null")
    now = shares.join(years, year).select(F.col("_next").alias("_y"), F.col(band).alias("from_band"), F.col("share").alias("_a"))
    after = shares.select(F.col(year).alias("_y"), F.col(band).alias("to_band"), F.col("share").alias("_b"))
    n = years.agg(F.count(F.lit(1)).alias("n")).scalar()
    return now.join(after, "_y").groupBy("from_band", "to_band").agg(F.sum(F.col("_a") * F.col("_b")).alias("_p")).withColumn("_n", n).select(
        "from_band", "to_band", (F.col("_p") / F.col("_n")).alias("share")
    )


def band_edges(df: DataFrame, year: str, band: str, value: str) -> DataFrame:
    """Year-band edges weighted by the mean value."""
    return df.groupBy(year, band).agg(F.avg(value).alias("weight")).filter("weight is not null")


# -- correlation -------------------------------------------------------------------
#: Values that every task may hold the ranks of.
COMMON_VALUES = 10_000


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and pair of columns, over rows that have both: count, means, squares and product about the means."""
    shift = sums = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        there = ~np.isnan(x)
        if shift is None:
            # Values are taken from about their middle, which keeps the sums exact enough.
            n = there.sum(axis=0)
            shift = np.where(there, x, 0).sum(axis=0) / np.maximum(n, 1)
            sums = np.zeros((4, x.shape[1], x.shape[1]))
        m = there.astype(float)
        v = np.where(there, x - shift, 0.0)
        sums += np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
    if sums is None:
        return
    i, j = np.triu_indices(len(shift), 1)
    n, sx, sy = sums[0][i, j], sums[1][i, j], sums[1][j, i]
    some = n > 0
    i, j, n, sx, sy = i[some], j[some], n[some], sx[some], sy[some]
    columns = {
        "i": i.astype(np.int32), "j": j.astype(np.int32), "n": n, "mx": shift[i] + sx / n, "my": shift[j] + sy / n,
        "xx": sums[2][i, j] - sx * sx / n, "yy": sums[2][j, i] - sy * sy / n, "xy": sums[3][i, j] - sx * sy / n,
    }
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of the listed columns: ``var_a, var_b, r, n``.

    One pass; a task leaves one row of moments per pair, however many rows it read.
    NaN counts as missing, a constant column has a null correlation, and pairs without a
    row that has both columns are left out.
    """
    parts = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(
        _pair_moments, "i int, j int, n double, mx double, my double, xx double, yy double, xy double")
    total = lambda c: F.sum(c)
    sums = parts.groupBy("i", "j").agg(
        total("n").alias("n"), total(F.col("n") * F.col("mx")).alias("sx"), total(F.col("n") * F.col("my")).alias("sy"),
        total(F.col("xx") + F.col("n") * F.col("mx") * F.col("mx")).alias("xx"), total(F.col("yy") + F.col("n") * F.col("my") * F.col("my")).alias("yy"),
        total(F.col("xy") + F.col("n") * F.col("mx") * F.col("my")).alias("xy"),
    )
    about = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / F.col("n")
    # What is left of a constant column by rounding is no spread.
    varied = lambda c, a: F.when(about(c, a, a) > 1e-12 * F.col(c), about(c, a, a))
    spread = F.sqrt(varied("xx", "sx") * varied("yy", "sy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("i")).alias("var_a"), F.get(names, F.col("j")).alias("var_b"),
        F.when(spread > 0, F.greatest(F.least(about("xy", "sx", "sy") / spread, F.lit(1.0)), F.lit(-1.0))).alias("r"), F.col("n").cast("long").alias("n"),
    )


def correlation_edges(df: DataFrame, columns: list[str], above: float = 0.2) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") > above).select("var_a", "var_b", F.col("r").alias("weight"))


def stars(p: Column) -> Column:
    out = None
    for below, text in V.STARS:
        out = F.when(p < below, text) if out is None else out.when(p < below, text)
    return out.otherwise("")


def correlation_table(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Correlations with p and significance stars; Spearman works on average ranks."""
    data = average_ranks(df, columns) if method == "spearman" else df
    out = correlations(data, columns)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    out = out.withColumn("t", F.when(F.abs("r") < 1, t)).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))
    text = F.concat(F.format_string("%.2f", "r"), stars(F.col("p")))
    return out.withColumn("stars", stars(F.col("p"))).withColumn("cell", text)


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each listed column replaced by its average rank (null stays null).

    All columns are counted and ordered together, as rows (column, value). Values that hold
    more than one in ``COMMON_VALUES`` of all cells, which are fewer than that, are looked up
    where the rows are, so no value brings many rows to one task; cells of other values
    are joined, and meet their rows again in parts of bounded size.
    """
    at = range(len(columns))
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    cells = lambda of: F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), of(i).alias("_v")) for i in at])).alias("e")
    counted = rows.select(cells(lambda i: F.col(f"c{i}"))).select("e.*").filter(F.col("_v").isNotNull()).groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("n"))
    ranks = cut_lineage(running_totals(counted, "_v", ["n"], ["_i"]).select("_i", "_v", "n", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("_rank")))
    few = (ranks.agg(F.sum("n")).first()[0] or 0) / COMMON_VALUES
    common, other = ranks.filter(F.col("n") > few), ranks.filter(F.col("n") <= few)
    near = rows
    for i in at:
        near = near.join(F.broadcast(common.filter(F.col("_i") == i).select(F.col("_v").alias(f"c{i}"), F.col("_rank").alias(f"r{i}"))), f"c{i}", "left")
    rest = other.agg(F.sum("n")).first()[0] or 0
    if not rest:
        return near.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])
    parts = -(-rest // RANGE_ROWS)
    left = near.select("_row", cells(lambda i: F.when(F.col(f"r{i}").isNull(), F.col(f"c{i}")))).select("_row", "e.*").filter(F.col("_v").isNotNull())
    found = left.join(other.select("_i", "_v", "_rank"), ["_i", "_v"]).select("_row", "_i", "_rank")
    far = found.repartition(parts, "_row").groupBy("_row").agg(*[F.max(F.when(F.col("_i") == i, F.col("_rank"))).alias(f"f{i}") for i in at])
    both = near.select("_row", *[f"r{i}" for i in at]).repartition(parts, "_row").join(far, "_row", "left")
    return both.select(*[F.coalesce(f"r{i}", f"f{i}").alias(c) for i, c in enumerate(columns)])


def degree_centrality(edges: DataFrame, n_nodes: int) -> DataFrame:
    ends = edges.select(F.col("var_a").alias("node")).unionByName(edges.select(F.col("var_b").alias("node")))
    return ends.groupBy("node").agg((F.count(F.lit(1)) / (n_nodes - 1)).alias("degree"))


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-10, at_once: int = 8) -> DataFrame:
    """Dominant eigenvector of the unweighted graph, of length one.

    A vector with a row per node is multiplied by the edges and scaled to length one,
    until no entry changes by more than ``tolerance``. Every node keeps its own value as
    well, which leaves the eigenvectors as they are and makes bipartite graphs converge.
    A step is one join of edges and vector; ``at_once`` steps run between two looks at the change.
    """
    ends = edges.select(F.col("var_a").alias("i"), F.col("var_b").alias("j"))
    both = ends.unionByName(ends.select(F.col("j").alias("i"), F.col("i").alias("j")))
    m = cut_lineage(both.unionByName(both.select("i", F.col("i").alias("j"))).distinct())
    x = cut_lineage(m.select(F.col("i").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    while True:
        y = x
        for _ in range(at_once):
            y = m.join(y, m["j"] == y["node"]).groupBy(F.col("i").alias("node")).agg(F.sum("x").alias("x"))
        y = cut_lineage(y)
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if norm is None:
            return x.select("node", F.col("x").alias("centrality"))
        y = y.withColumn("x", F.col("x") / norm)
        change = y.join(x.withColumnRenamed("x", "before"), "node").agg(F.max(F.abs(F.col("x") - F.col("before")))).first()[0]
        x = y
        if change <= tolerance:
            return x.select("node", F.col("x").alias("centrality"))
