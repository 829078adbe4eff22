"""Shards of near equal bytes by a k-d tree over document metadata, in DataFrame functions only.

A node of the tree is a run of shards. It is cut across its widest dimension where the
bytes before the cut are the share of the shards on that side, until a node is one shard.
All nodes of a level are cut together.

The weighted median is exact and needs no sort of a node: rows stand in a total order
(place along the dimension, hash of the text, hash of the id), whose words are whole
numbers. A round counts bytes in ``BUCKETS`` equal steps of the first word that is not
settled and goes on inside the step that holds the wanted weight; a few thousand rows at
most are left for a window. Equal texts stand side by side wherever the dimension ties, so
a cut parts few groups of copies, and a group of any size can be parted.

What moves: sums per (node, step), and once the numbering of the rows. Tables are a row of
numbers per document and a row per node; texts are read once and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, NumericType

from surveyloom.llm.common import free_name, shared_table

#: Steps into which a round cuts the open range of a node.
BUCKETS = 4096

#: A node with so few open rows is settled by a window over them.
LAST_ROWS = 4096

#: Places along a dimension are whole numbers up to this one; 0 is for nulls.
PLACES = 1 << 50

_TOP = (1 << 63) - 1


def _is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType) or kind.typeName() in ("date", "timestamp", "timestamp_ntz")


def _as_double(c: Column, kind: DataType) -> Column:
    if kind.typeName() == "date":
        return F.unix_date(c).cast("double")
    if kind.typeName().startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _place(c: Column, low: float | None, high: float | None) -> Column:
    """0 for a null, else 1 to PLACES + 1 in the order of the values."""
    if low is None or low == high:
        share = F.lit(0.0)
    else:
        share = (c / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.floor(share * float(PLACES)) + 1).cast("bigint")


def _hash_place(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(PLACES)) + 1).cast("bigint")


def _hash_word(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 1)


def _pick(axis: Column, columns: list[str]) -> Column:
    return F.coalesce(*[F.when(axis == i, F.col(c)) for i, c in enumerate(columns)])


def _key(w0: Column, w1: Column, w2: Column) -> Column:
    return F.struct(w0.alias("w0"), w1.alias("w1"), w2.alias("w2"))


def _inside() -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"w{i}").between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(3)])


def _cuts(rows: DataFrame, places: list[str], numeric: list[bool], distinct: list[int]) -> DataFrame:
    """One row per node of several shards: shard, axis, and the last key of its left side."""
    nodes = rows.filter("leaves > 1")
    figures = [f for c, number in zip(places, numeric) for f in (
        [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")] if number else [F.max(c).alias(f"{c}_hi"), F.approx_count_distinct(c).alias(f"{c}_n")])]
    width = [
        (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / F.lit(float(PLACES)) if number else (F.col(f"{c}_n") - 1) / F.lit(float(max(n - 1, 1)))
        for c, number, n in zip(places, numeric, distinct)
    ]
    widest = [F.struct(w.cast("double").alias("width"), F.lit(-i).alias("axis")) for i, w in enumerate(width)]
    axis = -(F.greatest(*widest) if len(widest) > 1 else widest[0])["axis"]
    state = shared_table(
        nodes.groupBy("shard", "leaves").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *figures)
        .withColumn("axis", axis)
        .withColumn("goal", F.expr("cast(bytes as decimal(38,0)) * (2 * (leaves div 2)) div leaves"))
        .select("shard", "axis", "goal", "rows", F.lit(0).cast("bigint").alias("before"),
                F.lit(0).cast("bigint").alias("lo0"), _pick(F.col("axis"), [f"{c}_hi" for c in places]).alias("hi0"),
                *[F.lit(v).cast("bigint").alias(n) for n, v in (("lo1", 0), ("hi1", _TOP), ("lo2", 0), ("hi2", _TOP))]))
    keyed = lambda s: nodes.join(s, "shard").withColumn("w0", _pick(F.col("axis"), places)).filter(_inside())
    while True:
        open_nodes = state.filter((F.col("rows") > LAST_ROWS) & ((F.col("lo0") < F.col("hi0")) | (F.col("lo1") < F.col("hi1")) | (F.col("lo2") < F.col("hi2"))))
        if open_nodes.isEmpty():
            break
        word = F.when(F.col("lo0") < F.col("hi0"), 0).when(F.col("lo1") < F.col("hi1"), 1).otherwise(2)
        at = lambda name: _pick(F.col("word"), [f"{name}{i}" for i in range(3)])
        steps = (
            keyed(open_nodes).withColumn("word", word)
            .select("shard", "word", "size", at("w").alias("v"), at("lo").alias("lo"), at("hi").alias("hi"))
            .withColumn("step", F.expr("(v - lo) div ((hi - lo) div %d + 1)" % BUCKETS))
            .groupBy("shard", "word", "step").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        )
        upto = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.withColumn("upto", F.sum("bytes").over(upto)).join(state.select("shard", "before", "goal"), "shard")
        found = (
            steps.filter(2 * (F.col("before") + F.col("upto")) >= F.col("goal"))
            .groupBy("shard").agg(F.min(F.struct("step", "word", "least", "most", "n", (F.col("before") + F.col("upto") - F.col("bytes")).alias("before"))).alias("f"))
        )
        new = [F.when(F.col("f.word") == i, F.col(f"f.{v}")).otherwise(F.col(f"{b}{i}")).alias(f"{b}{i}") for i in range(3) for b, v in (("lo", "least"), ("hi", "most"))]
        state = shared_table(
            state.join(found, "shard", "left").select(
                "shard", "axis", "goal", F.coalesce("f.n", "rows").alias("rows"), F.coalesce("f.before", "before").alias("before"), *new))
    upto = Window.partitionBy("shard").orderBy("w0", "w1", "w2").rowsBetween(Window.unboundedPreceding, 0)
    left = (
        # Rows of one key stay together, so they count as one weight.
        keyed(state).groupBy("shard", "w0", "w1", "w2").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("goal").alias("goal"))
        .withColumn("upto", F.sum("size").over(upto))
        .filter(2 * (F.col("before") + F.col("upto")) - F.col("size") <= F.col("goal"))
        .groupBy("shard").agg(F.max(_key(F.col("w0"), F.col("w1"), F.col("w2"))).alias("last"))
    )
    none = _key(F.col("lo0"), F.col("lo1"), F.col("lo2") - 1)
    return shared_table(state.join(left, "shard", "left").select("shard", "axis", F.coalesce("last", none).alias("last")))


def _descend(rows: DataFrame, cuts: DataFrame, places: list[str]) -> DataFrame:
    """Every row goes to the left or right half of its node."""
    key = _key(_pick(F.col("axis"), places), F.col("w1"), F.col("w2"))
    half = F.expr("leaves div 2")
    split, right = F.col("last").isNotNull(), key > F.col("last")
    return (
        rows.join(cuts, "shard", "left")
        .withColumn("_shard", F.when(split & right, F.col("shard") + half).otherwise(F.col("shard")))
        .withColumn("leaves", F.when(split & right, F.col("leaves") - half).when(split, half).otherwise(F.col("leaves")))
        .drop("shard", "axis", "last").withColumnRenamed("_shard", "shard")
    )


def _number(rows: DataFrame) -> DataFrame:
    """``slot`` 0, 1, 2, ... in each shard: by input partition, then by row in it."""
    part = rows.withColumn("part", F.shiftrightunsigned("row", 33))
    sizes = part.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("row")
    return part.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("place"))


class ShardTree:
    """The cuts of a tree, level by level; ``shard_of`` sends any rows of the same columns down."""

    def __init__(self, dimensions: dict[str, Column], id_col: str, text_col: str, shards: int):
        self.dimensions, self.id_col, self.text_col, self.shards = dimensions, id_col, text_col, shards
        self.levels: list[DataFrame] = []

    def codes(self, docs: DataFrame, bounds: dict[str, tuple] | None = None) -> list[Column]:
        kinds = docs.select(*[c.alias(n) for n, c in self.dimensions.items()]).schema
        out = []
        for i, (name, c) in enumerate(self.dimensions.items()):
            kind = kinds[i].dataType
            if not _is_number(kind):
                out.append(_hash_place(c))
            elif bounds is None:
                out.append(_finite(_as_double(c, kind)))
            else:
                out.append(_place(_finite(_as_double(c, kind)), *bounds[name]))
        return out

    def words(self) -> list[Column]:
        text = F.coalesce(F.col(f"`{self.text_col}`").cast("string"), F.lit(""))
        return [_hash_word(text).alias("w1"), _hash_word(F.col(f"`{self.id_col}`").cast("bigint")).alias("w2")]

    def shard_of(self, docs: DataFrame, out: str = "shard") -> DataFrame:
        """``docs`` with the shard of each row; no shuffle while the cuts are small."""
        row = free_name(docs, "row")
        places = [f"_p{i}" for i in range(len(self.dimensions))]
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[c.alias(p) for c, p in zip(self.codes(docs, self.bounds), places)], *self.words())
        rows = rows.withColumn("shard", F.lit(0)).withColumn("leaves", F.lit(self.shards))
        for cuts in self.levels:
            rows = _descend(rows, cuts, places)
        return rows.select(*[F.col(f"{row}.`{c}`") for c in docs.columns], F.col("shard").alias(free_name(docs, out)))


def metadata_dimensions(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Those of lang, source and the length of the text (its logarithm) that the table offers."""
    known = {c: F.col(c) for c in ("lang", "source") if c in docs.columns}
    return known | {"length": F.log1p(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)))}


def kd_shards(
    docs: DataFrame, dimensions: dict[str, Column] | None = None, shards: int | None = None, target_bytes: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, ShardTree]:
    """(one row per input row: doc_id, size, text_crc32, shard, slot; the tree).

    ``size``: UTF-8 bytes of the text, none for a null text, plus 1. Give ``shards`` or
    ``target_bytes``, from which their number follows. ``dimensions``: expressions by name;
    numbers and dates are ordered by value, others by a hash, nulls (also NaN and infinite
    numbers) come first. The widest dimension of a node is the one whose values there take
    the largest part of their range, or of their distinct values, in the whole table; ties
    go to the first named. A row on a cut goes to the side that holds its middle byte, so
    a shard is off its share by about one row. Rows that repeat both id and text
    stay together. Rows fewer than shards leave some shards empty. An empty table gives
    no rows. Slots are gapless from 0 in each shard. Columns beside the two named and
    those of the dimensions are not read.
    """
    dimensions = dimensions or metadata_dimensions(docs, text_col)
    tree = ShardTree(dimensions, id_col, text_col, 1)
    kinds = docs.select(*[c.alias(n) for n, c in dimensions.items()]).schema
    numeric = [_is_number(f.dataType) for f in kinds]
    places = [f"_p{i}" for i in range(len(dimensions))]
    text = F.col(f"`{text_col}`").cast("string")
    meta = shared_table(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[c.alias(p) for c, p in zip(tree.codes(docs), places)], *tree.words()))
    whole = meta.agg(F.sum("size").alias("bytes"), *[f for p, number in zip(places, numeric) for f in (
        [F.min(p).alias(f"{p}_lo"), F.max(p).alias(f"{p}_hi")] if number else [F.approx_count_distinct(p).alias(f"{p}_n")])]).first()
    if shards is None:
        if target_bytes is None:
            raise ValueError("give shards or target_bytes")
        shards = -(-(whole["bytes"] or 0) // target_bytes)
    tree.shards = max(shards, 1)
    tree.bounds = {n: (whole[f"{p}_lo"], whole[f"{p}_hi"]) for n, p, number in zip(dimensions, places, numeric) if number}
    coded = [_place(F.col(p), *tree.bounds[n]).alias(p) if number else F.col(p) for n, p, number in zip(dimensions, places, numeric)]
    distinct = [0 if number else whole[f"{p}_n"] for p, number in zip(places, numeric)]
    # Written, so that the first node is found by its number like any other.
    rows = shared_table(meta.select("row", "size", *coded, "w1", "w2", F.lit(0).alias("shard"), F.lit(tree.shards).alias("leaves")))
    for _ in range((tree.shards - 1).bit_length()):
        cuts = _cuts(rows, places, numeric, distinct)
        tree.levels.append(cuts)
        rows = shared_table(_descend(rows, cuts, places))
    slots = _number(rows.select("row", "shard")).select(F.col("row").alias("_row"), "shard", "slot")
    out = meta.join(slots, meta["row"] == slots["_row"]).select("doc_id", "size", "text_crc32", "shard", "slot")
    return out, tree
