"""Schema matching between successive tables.

Columns are metadata: their number is set by the questionnaires, not by the
answers. Costs are kept as one array per column of the left table (blocked over
the right table), so no row per column pair is written; only pairs under the
threshold leave the array.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from surveyloom.functions import fixed_values as V
from surveyloom.functions.similarity import cosine
from surveyloom.operators.ordered import join_keys
from surveyloom.session import cut_lineage, literal_frame

BLOCK = 512

#: Places of one sheet whose contexts one task finds at once.
CONTEXT_BLOCK = 4096

#: Costs are compared to so many decimals, so that equal ones tie whatever order they were summed in.
COST_DIGITS = 9

COMPONENTS = ("d_col", "s_col", "s_ctx", "s_field")


# -- fingerprints --------------------------------------------------------------
def sample_values(long: DataFrame, n: int, seed: int = 0, keys: list[str] = ("table", "column")) -> DataFrame:
    """``n`` values per column: distinct non-null values in seeded hash order, repeated if fewer.

    The smallest hashes are taken inside hash classes first and then among those,
    so no column is sorted whole.
    """
    values = long.filter(F.col("value").isNotNull()).select(*keys, "value").distinct()
    hashed = values.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("value").cast("string"))))
    salted = hashed.withColumn("_salt", F.substring("_h", 31, 2))
    local = Window.partitionBy(*keys, "_salt").orderBy("_h", "value")
    final = Window.partitionBy(*keys).orderBy("_h", "value")
    kept = (
        salted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n)
    )
    listed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "value"))).getField("value").alias("_v"))
    index = F.sequence(F.lit(0), F.lit(n - 1))
    return listed.select(*keys, F.transform(index, lambda i: F.get("_v", F.pmod(i, F.size("_v")).cast("int"))).alias("samples"))


def _contexts(position: str, emb: str, windows: list[int], out: str, many: bool):
    """Means over neighbouring positions of one block, from prefix sums along them."""
    def run(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        at = table.column("_at").to_numpy(zero_copy_only=False)
        vectors = np.array(table.column(emb).to_pylist(), dtype=np.float64).reshape(len(at), -1)
        order = np.argsort(at, kind="stable")
        along = at[order]
        sums = np.vstack([np.zeros((1, vectors.shape[1])), np.cumsum(vectors[order], axis=0)])
        means = []
        for w in windows:
            first, last = np.searchsorted(along, at[own] - w, "left"), np.searchsorted(along, at[own] + w, "right")
            means.append((sums[last] - sums[first]) / (last - first)[:, None])
        rows = [[m[i].tolist() for m in means] if many else means[0][i].tolist() for i in range(len(own))]
        kind = pa.list_(pa.list_(pa.float64())) if many else pa.list_(pa.float64())
        return table.drop_columns(["_own", "_at", "_block"]).take(pa.array(own)).append_column(out, pa.array(rows, kind))
    return run


def context_vectors(
    columns: DataFrame, window: int | list[int], emb: str = "emb", within: list[str] = ("table", "sheet"), position: str = "position", block: int = CONTEXT_BLOCK,
) -> DataFrame:
    """Mean vector over the columns at most ``window`` places away in the same sheet, as ``ctx_emb``.

    With several windows ``ctx_embs`` holds a vector for each, out of the same prefix sums.
    A sheet is cut into blocks of places, which also get the places just beyond their
    ends, so a long sheet is not held by one task. A null sheet is a sheet of its own; a column
    without a place has no neighbours but itself.
    """
    windows = list(window) if isinstance(window, (list, tuple)) else [window]
    many = isinstance(window, (list, tuple))
    out, widest = ("ctx_embs" if many else "ctx_emb"), max(windows)
    placed = columns.filter(F.col(position).isNotNull())
    place = F.col(position).cast("bigint")
    near = F.sequence(F.floor((place - widest) / block), F.floor((place + widest) / block))
    kind = ArrayType(ArrayType(DoubleType())) if many else ArrayType(DoubleType())
    dealt = placed.withColumn("_at", place).withColumn("_block", F.explode(near)).withColumn("_own", F.col("_block") == F.floor(F.col("_at") / block))
    schema = StructType([*columns.schema.fields, StructField(out, kind)])
    found = dealt.groupBy(*within, "_block").applyInArrow(_contexts(position, emb, windows, out, many), schema)
    own = F.transform(F.col(emb), lambda x: x.cast("double"))
    alone = columns.filter(F.col(position).isNull()).withColumn(out, F.array(*[own for _ in windows]) if many else own)
    return found.unionByName(alone)


def fingerprints(
    columns: DataFrame, values: DataFrame, vector: Callable[[Column], Column], samples: int, window: int | list[int], seed: int = 0,
) -> DataFrame:
    """``table, sheet, position, column, emb, sample_embs`` and the context: what matching compares.

    ``columns``: ``table, sheet, position, column``, one row per column; ``values``: ``table,
    column, value``, all its values. ``vector`` turns a text into a unit vector. The samples of a
    smaller number are the first of these, so one description serves every number up to
    ``samples``; with a list of windows it serves all of them. A column without a value
    has no samples.
    """
    taken = sample_values(values, samples, seed).select("table", "column", F.transform("samples", vector).alias("sample_embs"))
    found = join_keys(columns.withColumn("emb", vector(F.col("column"))), taken, ["table", "column"], "left")
    return context_vectors(found.withColumn("sample_embs", F.coalesce("sample_embs", F.array().cast("array<array<double>>"))), window)


# -- costs -----------------------------------------------------------------------
def _blocks(columns: DataFrame, block: int, described: list[str]) -> DataFrame:
    entry = F.struct("position", "column", *described)
    return columns.groupBy("table", F.floor(F.col("position") / block).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("cols"))


def cost_components(
    columns: DataFrame, pairs: DataFrame, block: int = BLOCK, windows: list[int] | None = None, samples: list[int] | None = None,
) -> DataFrame:
    """Distance and similarity vectors of each left column against a block of right columns.

    ``columns``: ``table, position, column, emb, ctx_emb, sample_embs``;
    ``pairs``: ``pair, a, b`` (successive tables). Result: ``pair, i, column_a,
    block, js, columns_b`` and one array per component. Similarities are negated,
    so that lower is better throughout.

    With ``windows`` and ``samples`` (and ``ctx_embs`` in place of ``ctx_emb``) there is one
    ``s_ctx_<window>`` for each window and one ``s_field_<n>`` for each number of samples;
    the latter are running means over the sample places.
    """
    context = "ctx_emb" if windows is None else "ctx_embs"
    described = ["emb", context, "sample_embs"]
    left = columns.select(F.col("table").alias("a"), F.col("position").alias("i"), *[F.col(c).alias("_" + c) for c in ("column", *described)])
    right = _blocks(columns, block, described).withColumnRenamed("table", "b")
    joined = pairs.join(left, "a").join(right, "b")

    def field_score(x: Column, n: int | None = None) -> Column:
        first = lambda c: c if n is None else F.slice(c, 1, n)
        scores = F.zip_with(first(F.col("_sample_embs")), first(x["sample_embs"]), lambda p, q: cosine(p, q))
        both = (F.size("_sample_embs") > 0) & (F.size(x["sample_embs"]) > 0)
        return F.when(both, F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s) / F.size(scores)).otherwise(F.lit(0.0))

    over = lambda f: F.transform("cols", f)
    if windows is None:
        varied = [over(lambda x: -cosine(F.col("_ctx_emb"), x["ctx_emb"])).alias("s_ctx"), over(lambda x: -field_score(x)).alias("s_field")]
    else:
        # A parameter with a default would be taken for the place in the array.
        context_of = lambda k: over(lambda x: -cosine(F.get("_ctx_embs", F.lit(k)), F.get(x["ctx_embs"], F.lit(k))))
        fields_of = lambda n: over(lambda x: -field_score(x, n))
        varied = [context_of(k).alias(f"s_ctx_{w}") for k, w in enumerate(windows)] + [fields_of(n).alias(f"s_field_{n}") for n in samples]
    return joined.select(
        "pair", "i", F.col("_column").alias("column_a"), "block",
        over(lambda x: x["position"]).alias("js"),
        over(lambda x: x["column"]).alias("columns_b"),
        over(lambda x: F.levenshtein(F.col("_column"), x["column"]).cast("double")).alias("d_col"),
        over(lambda x: -cosine(F.col("_emb"), x["emb"])).alias("s_col"),
        *varied,
    )


def normalise(df: DataFrame, arrays: list[str], by: list[str]) -> DataFrame:
    """Min-max scale array columns over all rows of a group; a constant array becomes zero."""
    bounds = df.groupBy(*by).agg(
        *[F.min(F.array_min(c)).alias("_lo_" + c) for c in arrays], *[F.max(F.array_max(c)).alias("_hi_" + c) for c in arrays]
    )
    out = join_keys(df, bounds, by)
    for c in arrays:
        lo, spread = F.col("_lo_" + c), F.col("_hi_" + c) - F.col("_lo_" + c)
        out = out.withColumn(c, F.when(spread > 0, F.transform(c, lambda v: (v - lo) / spread)).otherwise(F.transform(c, lambda v: F.lit(0.0))))
    return out.drop(*["_lo_" + c for c in arrays], *["_hi_" + c for c in arrays])


def combine_costs(normalised: DataFrame, weights: dict[str, Column | float], by: list[str]) -> DataFrame:
    """Weighted sum of normalised components, normalised again."""
    parts = [(weights[c] if isinstance(weights[c], Column) else F.lit(float(weights[c])), F.col(c)) for c in COMPONENTS]
    total = reduce(
        lambda acc, p: F.zip_with(acc, p[1], lambda x, y: x + p[0] * y), parts[1:], F.transform(parts[0][1], lambda x: x * parts[0][0])
    )
    costs = normalise(normalised.withColumn("cost", total), ["cost"], by)
    return costs.withColumn("cost", F.transform("cost", lambda x: F.round(x, COST_DIGITS)))


def cost_arrays(columns: DataFrame, pairs: DataFrame, weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    # Column descriptions and raw components are metadata that several steps read again.
    raw = cut_lineage(cost_components(columns, pairs, block))
    return combine_costs(cut_lineage(normalise(raw, list(COMPONENTS), ["pair"])), weights, ["pair"])


def cost_pairs(costs: DataFrame, keep: list[str] = ("pair",), values: list[str] = ("cost",)) -> DataFrame:
    """Costs as one row per column pair; a report over metadata."""
    zipped = F.arrays_zip(F.col("js"), F.col("columns_b"), *[F.col(v) for v in values])
    return costs.select(*keep, "i", "column_a", F.explode(zipped).alias("z")).select(
        *keep, "i", "column_a", F.col("z.js").alias("j"), F.col("z.columns_b").alias("column_b"), *[F.col("z." + v) for v in values]
    )


# -- thresholds --------------------------------------------------------------------
def threshold(costs: DataFrame, method: str = "fixed", value: float = 1.0, z: float = 1.0, by: list[str] = ("pair",)) -> DataFrame:
    """Cost limit per pair: a fixed one, mean plus ``z`` deviations, or the top of the lower of two clusters.

    The two clusters are the split of the sorted costs with the largest variance
    between them, which is the exact optimum of two-means on a line.
    """
    by = list(by)
    if method == "fixed":
        return costs.select(*by).distinct().withColumn("threshold", F.lit(float(value)))
    flat = costs.select(*by, F.explode("cost").alias("c"))
    if method == "spread":
        return flat.groupBy(*by).agg((F.avg("c") + F.lit(float(z)) * F.stddev_pop("c")).alias("threshold"))
    if method != "cluster":
        raise ValueError(method)
    counted = flat.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    run = counted.select(
        *by, "c", F.sum("n").over(w).alias("n0"), F.sum(F.col("c") * F.col("n")).over(w).alias("s0"),
        F.sum("n").over(whole).alias("n"), F.sum(F.col("c") * F.col("n")).over(whole).alias("s"),
    )
    n1 = F.col("n") - F.col("n0")
    gain = F.when(n1 > 0, F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - F.try_divide(F.col("s") - F.col("s0"), n1), F.lit(2))).otherwise(F.lit(-1.0))
    return run.groupBy(*by).agg(F.min_by("c", F.struct(-gain, "c")).alias("threshold"))


# -- one-to-one matching -------------------------------------------------------------
def match_one_to_one(candidates: DataFrame, by: list[str] = ("pair",), rounds_per_checkpoint: int = 3) -> DataFrame:
    """Pairs that are each other's cheapest among what is left, round after round.

    ``candidates``: ``*by, i, j, cost`` under the threshold. Dropping dearer pairs
    first changes nothing: a pair over the limit could only be chosen after all
    pairs under it. Ties go to the lower ``i``, then ``j``. Each round takes at
    least the cheapest pair of every group, so the loop ends.
    """
    by = list(by)
    left, chosen, k = cut_lineage(candidates.select(*by, "i", "j", "cost")), None, 0
    while not left.isEmpty():
        order = F.struct("cost", "i", "j")
        best_i = left.groupBy(*by, "i").agg(F.min(order).alias("b")).select(*by, "b.i", "b.j", "b.cost")
        best_j = left.groupBy(*by, "j").agg(F.min(order).alias("b")).select(*by, "b.i", "b.j")
        taken = best_i.join(best_j, [*by, "i", "j"])
        k += 1
        taken = cut_lineage(taken)
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = left.join(taken.select(*by, "i"), [*by, "i"], "left_anti").join(taken.select(*by, "j"), [*by, "j"], "left_anti")
        left = cut_lineage(left)
        if k % rounds_per_checkpoint == 0:
            chosen = cut_lineage(chosen)
    return chosen if chosen is not None else candidates.select(*by, "i", "j", "cost").limit(0)


def with_unmatched(matches: DataFrame, columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, column_a, column_b, cost`` with the unmatched columns of both sides as half-empty rows."""
    side = lambda t, p, c: pairs.select("pair", F.col(t).alias("table")).join(columns.select("table", F.col("position").alias(p), F.col("column").alias(c)), "table").drop("table")
    a, b = side("a", "i", "column_a"), side("b", "j", "column_b")
    out = a.join(matches, ["pair", "i"], "left").join(b, ["pair", "j"], "full")
    return out.select("pair", "column_a", "column_b", "cost")


def match_tables(columns: DataFrame, pairs: DataFrame, weights: dict[str, float], method: str = "fixed", value: float = 1.0, z: float = 1.0) -> DataFrame:
    """Mutual-best mapping of the columns of successive tables under the cost limit."""
    columns = cut_lineage(columns)
    costs = cut_lineage(cost_arrays(columns, pairs, weights))
    limit = threshold(costs, method, value, z)
    under = cost_pairs(costs).join(limit, "pair").filter(F.col("cost") <= F.col("threshold")).select("pair", "i", "j", "cost")
    return with_unmatched(match_one_to_one(under), columns, pairs)


# -- using mappings --------------------------------------------------------------------
def chain_mappings(mappings: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Successive mappings chained: one row per question, one column per table; null keys do not meet.

    Each entry: (table a, table b, frame ``column_a, column_b``). A column of a table is a
    node, a matched pair an edge, and a question a component of this graph: every node
    points to its match in an earlier table, and pointers are doubled until they reach the
    first. So the number of joins grows with the logarithm of the number of tables. A
    mapping that gives a column two partners ends the job.
    """
    tables = list(dict.fromkeys(t for a, b, _ in mappings for t in (a, b)))
    edges = None
    for a, b, frame in mappings:
        step = frame.select(
            F.lit(tables.index(a)).alias("ta"), F.col("column_a").alias("a"), F.lit(tables.index(b)).alias("tb"), F.col("column_b").alias("b"))
        edges = step if edges is None else edges.unionByName(step)
    edges = cut_lineage(edges)
    whole = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    sides = [whole.groupBy("ta", "tb", c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(c).alias("c")) for c in ("a", "b")]
    twice = sides[0].unionByName(sides[1]).first()
    if twice is not None:
        raise ValueError(f"two partners of {twice['c']}")
    nodes = edges.select(F.col("ta").alias("t"), F.col("a").alias("c")).union(edges.select("tb", "b")).filter(F.col("c").isNotNull()).distinct()
    earlier = whole.groupBy(F.col("tb").alias("t"), F.col("b").alias("c")).agg(F.min(F.struct(F.col("ta").alias("t"), F.col("a").alias("c"))).alias("p"))
    first = cut_lineage(nodes.join(earlier, ["t", "c"], "left").select("t", "c", F.coalesce("p.t", "t").alias("pt"), F.coalesce("p.c", "c").alias("pc")))
    for _ in range((len(tables) - 1).bit_length()):
        up = first.select(F.col("t").alias("pt"), F.col("c").alias("pc"), F.col("pt").alias("ut"), F.col("pc").alias("uc"))
        first = first.join(up, ["pt", "pc"]).select("t", "c", F.col("ut").alias("pt"), F.col("uc").alias("pc"))
    return first.groupBy("pt", "pc").agg(*[F.max(F.when(F.col("t") == k, F.col("c"))).alias(t) for k, t in enumerate(tables)]).select(*tables)


def canonical_names(mapping: DataFrame, tables: list[str]) -> DataFrame:
    """``table, column, canonical``: the name in the last table that has the question, made unique."""
    named = mapping.withColumn("canonical", F.coalesce(*[F.col(t) for t in reversed(tables)]))
    # Questions of one name are few: as many as tables at most.
    w = Window.partitionBy("canonical").orderBy(*[F.col(t).asc_nulls_first() for t in tables])
    k = F.row_number().over(w) - 1
    unique = named.withColumn("canonical", F.when(k == 0, F.col("canonical")).otherwise(F.concat_ws("_", "canonical", k.cast("string"))))
    entries = F.array(*[F.struct(F.lit(t).alias("table"), F.col(t).alias("column")) for t in tables])
    return unique.select("canonical", F.explode(entries).alias("e")).select("e.table", "e.column", "canonical").filter("column is not null")


def merge_tables(responses: DataFrame, names: DataFrame) -> DataFrame:
    """Responses of all tables under their canonical question; unmapped columns are left out."""
    return responses.join(names, ["table", "column"]).drop("column").withColumnRenamed("canonical", "column")


def validity_range(mapping: DataFrame, tables: list[str]) -> DataFrame:
    """``column, from, to``: the unbroken run of tables that ends at the last one with the question."""
    flags = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("table"), F.col(t).isNotNull().cast("int").alias("has")) for i, t in enumerate(tables)])
    last = F.array_max(F.transform(F.filter(flags, lambda f: f["has"] == 1), lambda f: f["k"]))
    gap = F.coalesce(F.array_max(F.transform(F.filter(flags, lambda f: (f["has"] == 0) & (f["k"] < F.col("_last"))), lambda f: f["k"])), F.lit(-1))
    out = mapping.withColumn("column", F.coalesce(*[F.col(t) for t in reversed(tables)])).withColumn("_last", last)
    names = F.array(*[F.lit(t) for t in tables])
    return out.select("column", F.get(names, gap + 1).alias("from"), F.get(names, F.col("_last")).alias("to"))


def import_mapping(manual: DataFrame, tables: list[str]) -> DataFrame:
    """Hand-made mapping (``<table>__column``, ``<table>__sheet``) as one structured name per table."""
    from surveyloom.functions.columns import create_column

    made = [
        F.when(
            F.col(f"{t}__column").isNotNull() & F.col(f"{t}__sheet").isNotNull(),
            create_column(column=F.col(f"{t}__column"), sheet=F.col(f"{t}__sheet"), value="response"),
        ).alias(t)
        for t in tables
    ]
    return manual.select(*made).na.drop("all")


def repeated_entries(mapping: DataFrame, tables: list[str]) -> DataFrame:
    """Entries that occur more than once in a table's mapping column."""
    entries = F.array(*[F.struct(F.lit(t).alias("table"), F.col(t).alias("column")) for t in tables])
    return mapping.select(F.explode(entries).alias("e")).select("e.*").filter("column is not null").groupBy("table", "column").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")


def mapping_accuracy(mapping: DataFrame, truth: DataFrame, by: list[str] = ("pair",)) -> DataFrame:
    """Share of left columns mapped as in the truth: ``*by, accuracy``."""
    t = truth.select("pair", "column_a", F.col("column_b").alias("_truth"))
    rows = mapping.filter("column_a is not null").join(t, ["pair", "column_a"], "left")
    hit = F.coalesce(F.col("column_b") == F.col("_truth"), F.lit(False)).cast("double")
    return rows.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def trial_thresholds(costs: DataFrame) -> DataFrame:
    """Limit per (trial, pair) by each trial's own method.

    ``costs``: ``trial, pair, method, threshold, z, cost``.
    """
    of = lambda m: costs.filter(F.col("method") == m)
    fixed = of("fixed").groupBy("trial", "pair").agg(F.max("threshold").alias("limit"))
    flat = of("spread").select("trial", "pair", "z", F.explode("cost").alias("c"))
    spread = flat.groupBy("trial", "pair").agg((F.avg("c") + F.max("z") * F.stddev_pop("c")).alias("limit"))
    cluster = threshold(of("cluster"), "cluster", by=["trial", "pair"]).withColumnRenamed("threshold", "limit")
    return fixed.unionByName(spread).unionByName(cluster)


def sweep(columns: DataFrame, pairs: DataFrame, truth: DataFrame, trials: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """Accuracy of each trial's weights and limit; components are computed once.

    ``trials``: ``trial, w_d_col, w_s_col, w_s_ctx, w_s_field, threshold`` and
    optionally ``method`` and ``z``. With ``windows`` (those of the columns' ``ctx_embs``)
    they also choose a ``window`` and the number of samples, ``n_fields``; the
    components of all windows and numbers come from the same description. All trials
    are matched together, grouped by (trial, pair).
    """
    for name, default in (("method", F.lit("fixed")), ("z", F.lit(1.0))):
        trials = trials if name in trials.columns else trials.withColumn(name, default)
    columns = cut_lineage(columns)
    samples = None if windows is None else sorted(r[0] for r in trials.select("n_fields").distinct().collect())
    raw = cut_lineage(cost_components(columns, pairs, BLOCK, windows, samples))
    names = list(COMPONENTS) if windows is None else ["d_col", "s_col", *[f"s_ctx_{w}" for w in windows], *[f"s_field_{n}" for n in samples]]
    parts = cut_lineage(normalise(raw, names, ["pair"]))
    listed = trials.agg(F.collect_list(F.struct(*trials.columns)).alias("_t")).scalar()
    per_trial = parts.withColumn("_t", F.explode(listed)).select("*", "_t.*").drop("_t")
    if windows is not None:
        chosen = lambda by, name, of: F.coalesce(*[F.when(F.col(by) == k, F.col(f"{name}_{k}")) for k in of]).alias(name)
        keep = [c for c in per_trial.columns if not c.startswith(("s_ctx_", "s_field_"))]
        per_trial = per_trial.select(*keep, chosen("window", "s_ctx", windows), chosen("n_fields", "s_field", samples))
    weights = {c: F.col("w_" + c) for c in COMPONENTS}
    costs = cut_lineage(combine_costs(per_trial, weights, ["trial", "pair"]))
    flat = cost_pairs(costs, ["trial", "pair"]).join(trial_thresholds(costs), ["trial", "pair"])
    found = match_one_to_one(flat.filter(F.col("cost") <= F.col("limit")).select("trial", "pair", "i", "j", "cost"), ["trial", "pair"])
    a = pairs.join(columns.select(F.col("table").alias("a"), F.col("position").alias("i"), F.col("column").alias("column_a")), "a").select("pair", "i", "column_a")
    b = pairs.join(columns.select(F.col("table").alias("b"), F.col("position").alias("j"), F.col("column").alias("column_b")), "b").select("pair", "j", "column_b")
    every = a.withColumn("trial", F.explode(trials.agg(F.collect_list("trial").alias("t")).scalar()))
    mapping = every.join(found, ["trial", "pair", "i"], "left").join(b, ["pair", "j"], "left")
    return mapping_accuracy(mapping, truth, ["trial"])


def best_trial(accuracies: DataFrame) -> DataFrame:
    return accuracies.agg(F.max_by("trial", F.struct("accuracy", -F.col("trial"))).alias("trial"), F.max("accuracy").alias("accuracy"))


def section_tables(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """Cells of one workbook split into tables by ranges of sheets, for matching section by section.

    ``sections``: ``section, lo, hi`` (inclusive sheet numbers).
    """
    sheets = sections.select(F.col("section").alias("table"), F.explode(F.sequence("lo", "hi")).alias("sheet_no"))
    return cells.join(sheets, "sheet_no")


def section_columns(cells: DataFrame, redundant: list[str] = ()) -> DataFrame:
    """``table, sheet, position, column`` of the sections: first place of each header, redundant ones once.

    ``cells``: ``table, sheet, position, column`` and any others. Of the headers of a section
    that a pattern of ``redundant`` fits from the start, case ignored, the first stays.
    """
    from surveyloom.operators.responses import columns_to_drop

    listed = cells.groupBy("table", "column").agg(F.min(F.struct("position", "sheet")).alias("at")).select("table", "at.sheet", "at.position", "column")
    if not redundant:
        return listed
    gone = columns_to_drop(listed.select(F.col("table").alias("workbook"), "column", "position"), list(redundant), True)
    return listed.join(gone.withColumnRenamed("workbook", "table"), ["table", "column"], "left_anti").select("table", "sheet", "position", "column")


def merge_sections(
    cells: DataFrame, sections: DataFrame, order: list[str], vector: Callable[[Column], Column], weights: dict[str, float],
    redundant: list[str] = (), samples: int = V.MATCH_SAMPLES, window: int = V.MATCH_WINDOW, method: str = "fixed", value: float = V.MATCH_THRESHOLD, z: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(cells under their canonical question with the section as ``table``, the mapping of the sections).

    The sections of one workbook are tables that are matched like the tables of successive
    workbooks: columns of neighbouring sections in ``order``, chained, named after the last
    section that has them. ``cells``: ``sheet_no, sheet, position, column, value`` and any
    others; rows without a value in any question of a section are not there in this form.
    """
    spark = cells.sparkSession
    dealt = cut_lineage(section_tables(cells, sections))
    columns = section_columns(dealt, redundant)
    kept = dealt.join(columns.select("table", "column"), ["table", "column"], "left_semi")
    described = cut_lineage(fingerprints(columns, kept.select("table", "column", "value"), vector, samples, window))
    steps = [(f"{a}>{b}", a, b) for a, b in zip(order, order[1:])]
    pairs = literal_frame(spark, steps, "pair string, a string, b string")
    matched = cut_lineage(match_tables(described, pairs, weights, method, value, z))
    mapping = cut_lineage(chain_mappings([(a, b, matched.filter(F.col("pair") == pair).select("column_a", "column_b")) for pair, a, b in steps]))
    return merge_tables(kept, canonical_names(mapping, order)), mapping
