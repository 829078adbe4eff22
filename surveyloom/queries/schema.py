"""Schema matching and workbook exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveyloom.functions import fixed_values as V
from surveyloom.functions.similarity import unit
from surveyloom.operators import matching, profile
from surveyloom.operators.ordered import number_rows
from surveyloom.queries.registry import number, query, table
from surveyloom.queries.tables import HEADER_TABLES
from surveyloom.session import cut_lineage, literal_frame

LETTERS = "abcdefghijklmnopqrstuvwxyz_0123456789"
TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
}
PAIRS = (("customer>supplier", "customer", "supplier"), ("supplier>part", "supplier", "part"), ("part>orders", "part", "orders"))
WEIGHTS = {"d_col": 1.7, "s_col": 1.8, "s_ctx": 1.8, "s_field": 0.3}


def letter_vector(text: Column) -> Column:
    """Unit vector of letter counts."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    return unit(F.transform(letters, lambda c: (F.length(text) - F.length(F.replace(F.lower(text), c, F.lit("")))).cast("double")))


def column_values(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """``table, column, value`` of every cell; arrays count as their text."""
    out = None
    for name in tables:
        rows = table(spark, folder, name)
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in rows.columns])
        one = rows.select(F.lit(name).alias("table"), F.explode(entries).alias("e")).select("table", "e.column", "e.value")
        out = one if out is None else out.unionByName(one)
    return out


def sampled_columns(spark: SparkSession, folder: str, samples: int = V.MATCH_SAMPLES, window=V.MATCH_WINDOW) -> DataFrame:
    """Every column of the four tables with name vector, context vector and vectors of its hashed sample values."""
    named = [(name, "all", i, c) for name in TABLES for i, c in enumerate(table(spark, folder, name).columns)]
    columns = literal_frame(spark, named, "table string, sheet string, position int, column string")
    return matching.fingerprints(columns, column_values(spark, folder, list(TABLES)), letter_vector, samples, window)


def table_pairs(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, list(PAIRS), "pair string, a string, b string")


_VEC = "list_transform([{}], lambda c: (length({}) - length(replace(lower({}), c, '')))::DOUBLE)"


def _vector_sql(text: str) -> str:
    raw = _VEC.format(", ".join(f"'{c}'" for c in LETTERS), text, text)
    return f"(SELECT CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END FROM (SELECT {raw} AS v))"


def _cells_sql(tables: dict[str, tuple]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS t, unnest([{', '.join(repr(c) for c in cols)}]) AS col, unnest([{', '.join(f'{c}::VARCHAR' for c in cols)}]) AS value FROM {t}" for t, cols in tables.items())


def columns_sql(windows: tuple, samples: tuple) -> str:
    """Components of all column pairs, scaled: n_d_col and n_s_col, n_s_ctx by window, n_s_field by number of samples."""
    listed = ", ".join(f"('{t}', {i}, '{c}')" for t, cols in TABLES.items() for i, c in enumerate(cols))
    scaled = lambda c, by: f"CASE WHEN max({c}) OVER ({by}) > min({c}) OVER ({by}) THEN ({c} - min({c}) OVER ({by})) / (max({c}) OVER ({by}) - min({c}) OVER ({by})) ELSE 0 END AS n_{c}"
    return f"""
WITH RECURSIVE cells AS ({_cells_sql(TABLES)}),
dv AS (SELECT DISTINCT t, col, value FROM cells WHERE value IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY t, col ORDER BY md5('0|' || value), value) AS k, count(*) OVER (PARTITION BY t, col) AS distinct_n FROM dv),
cols(t, pos, col) AS (VALUES {listed}),
v AS (SELECT t, pos, col, {_vector_sql('col')} AS e FROM cols),
place AS (SELECT unnest(range(1, {max(samples) + 1})) AS place),
sm AS (SELECT rk.t, rk.col, place, {_vector_sql('value')} AS s FROM rk JOIN place ON rk.k = (place - 1) % least(distinct_n, {max(samples)}) + 1),
win AS (SELECT unnest({list(windows)}) AS win),
num AS (SELECT unnest({list(samples)}) AS num),
x AS (SELECT a.t, a.pos, win, list_transform(range(1, {len(LETTERS) + 1}), lambda d: list_avg(list_transform(list(b.e), lambda z: z[d]))) AS ctx
      FROM v a CROSS JOIN win JOIN v b ON a.t = b.t AND abs(a.pos - b.pos) <= win GROUP BY 1, 2, 3),
pairs(pair, a, b) AS (VALUES {', '.join(str(p) for p in PAIRS)}),
base AS (SELECT pair, l.pos AS i, l.col AS column_a, r.pos AS j, r.col AS column_b, levenshtein(l.col, r.col)::DOUBLE AS d_col, -list_dot_product(l.e, r.e) AS s_col
  FROM pairs JOIN v l ON l.t = a JOIN v r ON r.t = b),
cx AS (SELECT pair, l.pos AS i, r.pos AS j, l.win, -list_dot_product(l.ctx, r.ctx) AS s_ctx FROM pairs JOIN x l ON l.t = a JOIN x r ON r.t = b AND r.win = l.win),
fd AS (SELECT pair, lc.pos AS i, rc.pos AS j, l.place, list_dot_product(l.s, r.s) AS d FROM pairs JOIN cols lc ON lc.t = a JOIN cols rc ON rc.t = b
  JOIN sm l ON l.t = a AND l.col = lc.col JOIN sm r ON r.t = b AND r.col = rc.col AND r.place = l.place),
fn AS (SELECT pair, i, j, num, -avg(d) AS s_field FROM fd JOIN num ON place <= num GROUP BY ALL),
nb AS (SELECT *, {scaled('d_col', 'PARTITION BY pair')}, {scaled('s_col', 'PARTITION BY pair')} FROM base),
nc AS (SELECT *, {scaled('s_ctx', 'PARTITION BY pair, win')} FROM cx),
nf AS (SELECT *, {scaled('s_field', 'PARTITION BY pair, num')} FROM fn),
"""


def costs_sql(trials: str) -> str:
    """Costs of each trial, its limits, and the greedy matching under them; ``trials`` defines tr."""
    return f"""
tr AS ({trials}),
tot AS (SELECT trial, pair, i, column_a, j, column_b, d_col, s_col, s_ctx, s_field, method, threshold, z,
    w_d_col * n_d_col + w_s_col * n_s_col + w_s_ctx * n_s_ctx + w_s_field * n_s_field AS total
  FROM tr CROSS JOIN nb JOIN nc USING (pair, i, j) JOIN nf USING (pair, i, j) WHERE nc.win = tr.win AND nf.num = tr.num),
cost AS (SELECT *, round(CASE WHEN max(total) OVER w > min(total) OVER w THEN (total - min(total) OVER w) / (max(total) OVER w - min(total) OVER w) ELSE 0 END, 9) AS cost
  FROM tot WINDOW w AS (PARTITION BY trial, pair)),
cc AS (SELECT trial, pair, cost AS c, count(*) AS m FROM cost GROUP BY ALL),
cr AS (SELECT *, sum(m) OVER w AS n0, sum(c * m) OVER w AS s0, sum(m) OVER p AS n, sum(c * m) OVER p AS s
  FROM cc WINDOW w AS (PARTITION BY trial, pair ORDER BY c ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY trial, pair)),
cg AS (SELECT trial, pair, c, CASE WHEN n > n0 THEN n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) ** 2 ELSE -1 END AS gain FROM cr),
cl AS (SELECT trial, pair, min_by(c, (-gain, c)) AS lim FROM cg GROUP BY ALL),
lim AS (SELECT trial, pair, CASE any_value(method) WHEN 'fixed' THEN any_value(threshold) WHEN 'spread' THEN avg(cost) + any_value(z) * stddev_pop(cost) ELSE any_value(lim) END AS lim
  FROM cost JOIN cl USING (trial, pair) GROUP BY ALL),
cand AS (SELECT trial, pair, i, j, column_a, column_b, cost, row_number() OVER (PARTITION BY trial, pair ORDER BY cost, i, j) AS k
  FROM cost JOIN lim USING (trial, pair) WHERE cost <= lim),
m(trial, pair, k, ui, uj, i, j, hit) AS (
  SELECT trial, pair, 1::BIGINT, 1::BIGINT << i, 1::BIGINT << j, i, j, true FROM cand WHERE k = 1
  UNION ALL SELECT c.trial, c.pair, c.k, CASE WHEN (ui >> c.i) & 1 = 0 AND (uj >> c.j) & 1 = 0 THEN ui | (1::BIGINT << c.i) ELSE ui END,
    CASE WHEN (ui >> c.i) & 1 = 0 AND (uj >> c.j) & 1 = 0 THEN uj | (1::BIGINT << c.j) ELSE uj END, c.i, c.j, (ui >> c.i) & 1 = 0 AND (uj >> c.j) & 1 = 0
  FROM m JOIN cand c ON c.trial = m.trial AND c.pair = m.pair AND c.k = m.k + 1),
found AS (SELECT c.* FROM m JOIN cand c USING (trial, pair, k) WHERE hit)
"""


def fixed_trial(threshold: float) -> str:
    weights = ", ".join(f"{w}::DOUBLE AS w_{c}" for c, w in WEIGHTS.items())
    return f"SELECT 0 AS trial, {weights}, 'fixed' AS method, {threshold}::DOUBLE AS threshold, 0.0::DOUBLE AS z, {V.MATCH_WINDOW} AS win, {V.MATCH_SAMPLES} AS num"


COLUMNS_SQL = columns_sql((V.MATCH_WINDOW,), (V.MATCH_SAMPLES,))


@query("cost_table", COLUMNS_SQL + costs_sql(fixed_trial(1.0)) + """
SELECT pair, i::INTEGER AS i, column_a, j::INTEGER AS j, column_b, d_col, round(s_col, 6) AS s_col, round(s_ctx, 6) AS s_ctx, round(s_field, 6) AS s_field,
       round(cost, 6) AS cost FROM cost""")
def cost_table(spark: SparkSession, folder: str) -> DataFrame:
    columns, pairs = cut_lineage(sampled_columns(spark, folder)), table_pairs(spark)
    raw = matching.cost_pairs(matching.cost_components(columns, pairs), ["pair"], list(matching.COMPONENTS))
    costs = matching.cost_pairs(matching.cost_arrays(columns, pairs, WEIGHTS)).select("pair", "i", "j", "cost")
    return raw.join(costs, ["pair", "i", "j"]).select(
        "pair", "i", "column_a", "j", "column_b", "d_col", *[number(F.col(c)).alias(c) for c in ("s_col", "s_ctx", "s_field", "cost")]
    )


@query("cost_thresholds", COLUMNS_SQL + costs_sql(fixed_trial(0.24)) + """
SELECT pair, round(any_value(cl.lim), 6) AS "cluster", round(avg(cost) + 1.5 * stddev_pop(cost), 6) AS spread, 0.24::DOUBLE AS "fixed" FROM cost JOIN cl USING (trial, pair) GROUP BY 1""")
def cost_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    costs = cut_lineage(matching.cost_arrays(sampled_columns(spark, folder), table_pairs(spark), WEIGHTS))
    out = matching.threshold(costs, "cluster").withColumnRenamed("threshold", "cluster")
    out = out.join(matching.threshold(costs, "spread", z=1.5).withColumnRenamed("threshold", "spread"), "pair")
    out = out.join(matching.threshold(costs, "fixed", 0.24).withColumnRenamed("threshold", "fixed"), "pair")
    return out.select("pair", number(F.col("cluster")).alias("cluster"), number(F.col("spread")).alias("spread"), "fixed")


@query("match_columns", COLUMNS_SQL + costs_sql(fixed_trial(0.6)) + """
, a AS (SELECT pair, pos AS i, col AS column_a FROM pairs JOIN cols ON t = a), b AS (SELECT pair, pos AS j, col AS column_b FROM pairs JOIN cols ON t = b)
SELECT pair, column_a, column_b, round(cost, 6) AS cost FROM found
UNION ALL SELECT pair, column_a, NULL, NULL FROM a WHERE (pair, i) NOT IN (SELECT pair, i FROM found)
UNION ALL SELECT pair, NULL, column_b, NULL FROM b WHERE (pair, j) NOT IN (SELECT pair, j FROM found)""")
def match_columns(spark: SparkSession, folder: str) -> DataFrame:
    out = matching.match_tables(sampled_columns(spark, folder), table_pairs(spark), WEIGHTS, "fixed", 0.6)
    return out.withColumn("cost", number(F.col("cost")))


TRUTH = (
    ("customer>supplier", "c_custkey", "s_suppkey"), ("customer>supplier", "c_name", "s_name"), ("customer>supplier", "c_nationkey", "s_nationkey"),
    ("customer>supplier", "c_acctbal", "s_acctbal"), ("supplier>part", "s_suppkey", "p_partkey"), ("supplier>part", "s_name", "p_name"),
    ("part>orders", "p_partkey", "o_orderkey"),
)
LIMITS = [("fixed", t, 0.0) for t in (0.1, V.MATCH_THRESHOLD, 0.5, 1.0, 2.0)] + [("spread", 0.0, z) for z in (0.1, 1.05, 2.0)] + [("cluster", 0.0, 0.0)]
LEVELS = (0.1, 1.05, 2.0)


def truth_frame(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, list(TRUTH), "pair string, column_a string, column_b string")


def sweep_trials(spark: SparkSession) -> DataFrame:
    """Every combination of three levels of each weight with each method at each of its limits: 729 trials."""
    out = literal_frame(spark, [(k, *limit) for k, limit in enumerate(LIMITS)], "limit_no int, method string, threshold double, z double")
    trial = F.col("limit_no")
    for c in matching.COMPONENTS:
        out = out.select("*", F.posexplode(F.array(*[F.lit(w) for w in LEVELS])).alias("k_" + c, "w_" + c))
        trial = trial * 3 + F.col("k_" + c)
    return out.select(trial.alias("trial"), *["w_" + c for c in matching.COMPONENTS], "threshold", "method", "z")


def _grid_sql() -> str:
    limits = ", ".join(f"({k}, '{m}', {t}::DOUBLE, {z}::DOUBLE)" for k, (m, t, z) in enumerate(LIMITS))
    levels = "(VALUES " + ", ".join(f"({k}, {w}::DOUBLE)" for k, w in enumerate(LEVELS)) + ")"
    number_of, frames = "l.no", []
    for c in matching.COMPONENTS:
        number_of = f"({number_of} * 3 + {c}.k)"
        frames.append(f"{levels} {c}(k, w)")
    weights = ", ".join(f"{c}.w AS w_{c}" for c in matching.COMPONENTS)
    return f"SELECT {number_of} AS trial, {weights}, method, threshold, z, {V.MATCH_WINDOW} AS win, {V.MATCH_SAMPLES} AS num FROM (VALUES {limits}) l(no, method, threshold, z), {', '.join(frames)}"


ACCURACY_SQL = f"""
, truth(pair, column_a, truth) AS (VALUES {', '.join(str(t) for t in TRUTH)}),
a AS (SELECT trial, pair, pos AS i, col AS column_a FROM tr CROSS JOIN pairs JOIN cols ON t = a)
SELECT trial::INTEGER AS trial, round(avg((coalesce(column_b = truth, false))::INTEGER), 6) AS accuracy, count(*) AS n
FROM a LEFT JOIN (SELECT trial, pair, i, column_b FROM found) f USING (trial, pair, i) LEFT JOIN truth USING (pair, column_a) GROUP BY 1"""


@query("sweep", COLUMNS_SQL + costs_sql(_grid_sql()) + ACCURACY_SQL)
def sweep(spark: SparkSession, folder: str) -> DataFrame:
    out = matching.sweep(sampled_columns(spark, folder), table_pairs(spark), truth_frame(spark), sweep_trials(spark))
    return out.withColumn("accuracy", number(F.col("accuracy")))


SWEEP_TRIALS = 200
WINDOWS = tuple(range(1, 8))
SAMPLES = tuple(range(1, 8))


def random_trials(spark: SparkSession) -> DataFrame:
    """Trials over all nine parameters, drawn by the hash of the trial's number."""
    share = lambda p: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.lit(p))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    span = lambda p: F.lit(0.1) + F.lit(1.9) * share(p)
    one_to_seven = lambda p: (F.floor(share(p) * 7) + 1).cast("int")
    method = F.get(F.array(F.lit("fixed"), F.lit("cluster"), F.lit("spread")), F.floor(share("method") * 3).cast("int"))
    return spark.range(SWEEP_TRIALS).select(F.col("id").cast("int").alias("trial")).select(
        "trial", *[span(c).alias("w_" + c) for c in matching.COMPONENTS], span("threshold").alias("threshold"), span("z").alias("z"), method.alias("method"),
        one_to_seven("window").alias("window"), one_to_seven("n_fields").alias("n_fields"))


def _random_sql() -> str:
    share = lambda p: f"(('0x' || substr(md5(k || '|{p}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    span = lambda p: f"0.1::DOUBLE + 1.9::DOUBLE * {share(p)}"
    weights = ", ".join(f"{span(c)} AS w_{c}" for c in matching.COMPONENTS)
    return (f"SELECT k AS trial, {weights}, {span('threshold')} AS threshold, {span('z')} AS z, ['fixed', 'cluster', 'spread'][floor({share('method')} * 3)::INTEGER + 1] AS method, "
            f"floor({share('window')} * 7)::INTEGER + 1 AS win, floor({share('n_fields')} * 7)::INTEGER + 1 AS num FROM (SELECT unnest(range(0, {SWEEP_TRIALS}))::INTEGER AS k)")


@query("sweep_all", columns_sql(WINDOWS, SAMPLES) + costs_sql(_random_sql()) + ACCURACY_SQL)
def sweep_all(spark: SparkSession, folder: str) -> DataFrame:
    """200 trials over four weights, limit, method, deviations, window and number of samples, from one description."""
    columns = sampled_columns(spark, folder, max(SAMPLES), list(WINDOWS))
    out = matching.sweep(columns, table_pairs(spark), truth_frame(spark), random_trials(spark), list(WINDOWS))
    return out.withColumn("accuracy", number(F.col("accuracy")))


#: Columns whose values are written differently by the two engines: arrays, times below a second, long fractions.
UNLIKE = ("embedding", "ts", "value")
SAMPLED = {t: tuple(c for c in names.split() if c not in UNLIKE) for t, names in HEADER_TABLES.items()}


@query("sampled_values", f"""
WITH cells AS ({_cells_sql(SAMPLED)}), v AS (SELECT DISTINCT t, col, value FROM cells WHERE value IS NOT NULL),
r AS (SELECT t, col, value, row_number() OVER (PARTITION BY t, col ORDER BY md5('0|' || value), value) AS k FROM v),
l AS (SELECT t, col, list(value ORDER BY k) AS vs FROM r WHERE k <= 4 GROUP BY 1, 2)
SELECT t AS "table", col AS "column", array_to_string(list_transform(range(0, 4), lambda i: vs[i % len(vs) + 1]), ' | ') AS samples FROM l""")
def sampled_values(spark: SparkSession, folder: str) -> DataFrame:
    """Four values of every column of every table, in the order of their hash."""
    long = column_values(spark, folder, list(SAMPLED)).filter(~F.col("column").isin(*UNLIKE))
    return matching.sample_values(long, 4).select("table", "column", F.array_join("samples", " | ").alias("samples"))


@query("context_window", """
WITH e AS (SELECT nullif(label, 3) AS label, vec_id, embedding FROM embeddings),
n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding FROM e),
d AS (SELECT label, pos, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS x FROM n)
SELECT label, pos::INTEGER AS pos, dim::INTEGER - 1 AS dim, round(avg(x) OVER (PARTITION BY label, dim ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM d""")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    """Context means within each label; one label is emptied, so that a null sheet is among them."""
    rows = table(spark, folder, "embeddings").withColumn("label", F.nullif(F.col("label"), F.lit(3))).withColumnRenamed("embedding", "emb")
    numbered = number_rows(rows, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 100_000), "position")
    out = matching.context_vectors(numbered, 2, within=["label"])
    return out.select("label", F.col("position").alias("pos"), F.posexplode("ctx_emb").alias("dim", "value")).withColumn("value", number(F.col("value")))


# Part types as successive tables, name and brand as their columns.
SETS = {"t1": "ECONOMY", "t2": "LARGE", "t3": "MEDIUM", "t4": "PROMO", "t5": "SMALL", "t6": "STANDARD"}


def type_mappings(spark: SparkSession, folder: str) -> list[tuple[str, str, DataFrame]]:
    part = table(spark, folder, "part").select("p_type", F.concat_ws("/", "p_name", "p_brand").alias("k"))
    names = {t: part.filter(F.col("p_type") == v).select("k").distinct() for t, v in SETS.items()}
    out, tables = [], list(SETS)
    for a, b in zip(tables, tables[1:]):
        left, right = names[a].withColumn("column_a", F.col("k")), names[b].withColumn("column_b", F.col("k"))
        out.append((a, b, left.join(right, "k", "full").select("column_a", "column_b")))
    return out


def _chain_sql() -> str:
    tables = list(SETS)
    steps = [f"{t} AS (SELECT DISTINCT p_name || '/' || p_brand AS k FROM part WHERE p_type = '{v}')" for t, v in SETS.items()]
    steps += [f"m{i} AS (SELECT {a}.k AS a, {b}.k AS b FROM {a} FULL JOIN {b} ON {a}.k = {b}.k)" for i, (a, b) in enumerate(zip(tables, tables[1:]), 1)]
    steps.append("c1 AS (SELECT a AS t1, b AS t2 FROM m1)")
    for i in range(2, len(tables)):
        kept = "".join(f"c.t{j}, " for j in range(1, i))
        steps.append(f"c{i} AS (SELECT {kept}coalesce(c.t{i}, m.a) AS t{i}, m.b AS t{i + 1} FROM c{i - 1} c FULL JOIN m{i} m ON c.t{i} = m.a)")
    steps.append(f"chain AS (SELECT * FROM c{len(tables) - 1} WHERE coalesce({', '.join(tables)}) IS NOT NULL)")
    return "WITH " + ", ".join(steps)


CHAIN_SQL = _chain_sql()
FLAGS = "[" + ", ".join(f"{t} IS NOT NULL" for t in SETS) + "]"


@query("chain_mappings", CHAIN_SQL + " SELECT * FROM chain")
def chain_mappings(spark: SparkSession, folder: str) -> DataFrame:
    return matching.chain_mappings(type_mappings(spark, folder))


@query("validity_range", CHAIN_SQL + f""",
l AS (SELECT coalesce({', '.join(reversed(SETS))}) AS col, {FLAGS} AS f, list_max(list_filter(range(1, 7), lambda i: {FLAGS}[i])) AS hi FROM chain),
g AS (SELECT col, hi, coalesce(list_max(list_filter(range(1, 7), lambda i: NOT f[i] AND i < hi)), 0) + 1 AS lo FROM l)
SELECT col AS "column", 't' || lo AS "from", 't' || hi AS "to" FROM g""")
def validity_range(spark: SparkSession, folder: str) -> DataFrame:
    return matching.validity_range(matching.chain_mappings(type_mappings(spark, folder)), list(SETS))


@query("merge_tables", CHAIN_SQL + """
, c AS (SELECT *, coalesce(""" + ", ".join(reversed(SETS)) + """) AS name FROM chain),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY """ + ", ".join(f"{t} NULLS FIRST" for t in SETS) + """) - 1 AS no FROM c),
n AS (SELECT unnest([""" + ", ".join(f"'{t}'" for t in SETS) + "]) AS t, unnest([" + ", ".join(SETS) + """]) AS col, CASE WHEN no = 0 THEN name ELSE name || '_' || no END AS canonical FROM k),
p AS (SELECT CASE p_type """ + " ".join(f"WHEN '{v}' THEN '{t}'" for t, v in SETS.items()) + """ END AS t, p_name || '/' || p_brand AS col, p_size FROM part)
SELECT p.t AS "table", canonical AS "column", count(*) AS n, sum(p_size)::BIGINT AS total FROM p JOIN n ON n.t = p.t AND n.col = p.col GROUP BY 1, 2""")
def merge_tables(spark: SparkSession, folder: str) -> DataFrame:
    names = matching.canonical_names(cut_lineage(matching.chain_mappings(type_mappings(spark, folder))), list(SETS))
    kind = F.create_map(*[F.lit(x) for t, v in SETS.items() for x in (v, t)])
    responses = table(spark, folder, "part").select(
        F.try_element_at(kind, F.col("p_type")).alias("table"), F.concat_ws("/", "p_name", "p_brand").alias("column"), "p_size"
    )
    # A question whose chain is broken has several rows in the mapping, told apart by a number.
    return matching.merge_tables(responses, names).groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


SECTIONS = (("first", 1, 17), ("second", 18, 34), ("third", 35, 50))
BRAND_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("section_merge", """
WITH c AS (SELECT p_size, p_name AS col, p_partkey FROM part),
s(section, lo, hi) AS (VALUES """ + ", ".join(str(x) for x in SECTIONS) + """),
d AS (SELECT section, col, p_partkey, CASE section WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END AS no FROM c JOIN s ON p_size BETWEEN lo AND hi),
-- A name that pauses in the second section is two questions, of which the later one keeps the name.
h AS (SELECT col, bool_or(no = 2) AS second, bool_or(no = 3) AS third FROM d GROUP BY 1)
SELECT section AS "table", CASE WHEN no = 1 AND third AND NOT second THEN col || '_1' ELSE col END AS "column", count(*) AS n, sum(p_partkey)::BIGINT AS keys
FROM d JOIN h USING (col) GROUP BY 1, 2""")
def section_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Part sizes as sheets in three sections, names as their columns: merged section by section.

    Names are spelled alike in all sections and only equal names have cost zero, so what could
    go wrong is losing rows or joining others.
    """
    part = table(spark, folder, "part")
    cells = part.select(F.col("p_size").alias("sheet_no"), F.col("p_type").alias("sheet"), F.col("p_partkey").alias("position"), F.col("p_name").alias("column"),
                        F.col("p_name").alias("value"), "p_partkey")
    sections = literal_frame(spark, list(SECTIONS), "section string, lo int, hi int")
    merged, _ = matching.merge_sections(cells, sections, [x[0] for x in SECTIONS], letter_vector, {"d_col": 1.0, "s_col": 0.1, "s_ctx": 0.0, "s_field": 0.1}, value=0.0)
    return merged.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("repeated_entries", """
SELECT 'part' AS "table", p_brand || '/' || p_name AS "column", count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1""")
def repeated_entries(spark: SparkSession, folder: str) -> DataFrame:
    mapping = table(spark, folder, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("part"))
    return matching.repeated_entries(mapping, ["part"])


# -- exploration: brands as workbooks, types as sheets, names as columns ------------------
def workbook_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), F.col("p_name").alias("column"),
        F.col("p_size").alias("sheet_no"), F.col("p_partkey").alias("position"),
    )


@query("eda_duplicates", """
SELECT p_brand AS workbook, p_type AS sheet, replace(p_name, ' ', '') AS "column", count(*) AS n FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def eda_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    repeated = F.when(F.col("position") % 2 == 0, F.concat("column", F.lit("_duplicated_"), (F.col("position") % 7).cast("string"))).otherwise(F.col("column"))
    return profile.duplicate_headers(workbook_columns(spark, folder).withColumn("column", repeated))


@query("eda_redundant", """
SELECT p_brand AS workbook, p_name AS "column", count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 3""")
def eda_redundant(spark: SparkSession, folder: str) -> DataFrame:
    return profile.redundant_headers(workbook_columns(spark, folder), min_sheets=3)


@query("eda_redundant_share", """
WITH s AS (SELECT p_brand, count(DISTINCT p_type) AS k FROM part GROUP BY 1)
SELECT p_brand AS workbook, p_name AS "column", count(*) AS n FROM part JOIN s USING (p_brand) GROUP BY 1, 2 HAVING count(*) >= 0.5 * any_value(k)""")
def eda_redundant_share(spark: SparkSession, folder: str) -> DataFrame:
    return profile.redundant_headers(workbook_columns(spark, folder), share=0.5)


@query("eda_only_in", """
WITH c AS (SELECT DISTINCT p_brand AS w, p_name AS c FROM part), p AS (SELECT DISTINCT p_brand AS a, 'Brand#' || (substr(p_brand, 7)::INTEGER + 1) AS b FROM part)
SELECT a, b, c AS "column" FROM p JOIN c ON w = a WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.w = p.b AND d.c = c.c)""")
def eda_only_in(spark: SparkSession, folder: str) -> DataFrame:
    columns = workbook_columns(spark, folder)
    following = F.concat(F.lit("Brand#"), (F.substring("workbook", 7, 10).cast("int") + 1).cast("string"))
    pairs = columns.select(F.col("workbook").alias("a"), following.alias("b")).distinct()
    return profile.only_in_one(columns, pairs)


@query("eda_sheets", "SELECT p_brand AS workbook, min(p_size) AS sheet_no, p_type AS sheet FROM part GROUP BY 1, 3")
def eda_sheets(spark: SparkSession, folder: str) -> DataFrame:
    return profile.sheet_listing(workbook_columns(spark, folder))


@query("eda_columns", """
WITH f AS (SELECT p_brand AS workbook, p_name AS "column", min(p_partkey) AS p FROM part GROUP BY 1, 2)
SELECT workbook, (row_number() OVER (PARTITION BY workbook ORDER BY p) - 1)::INTEGER AS row, "column" FROM f""")
def eda_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_listing(workbook_columns(spark, folder))
