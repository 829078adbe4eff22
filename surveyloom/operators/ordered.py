"""Order statistics that stay distributed when one group holds most rows.

A plain window over ``partitionBy(group)`` sorts a whole group in one task. The
functions here split a group into chunks along its order, work inside a chunk,
and carry only one small row per chunk across.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegerType, LongType, StructField, StructType

from surveyloom.session import cut_lineage

#: Equal steps into which a round of a selection cuts the open range.
STEPS = 4096

#: A range with so few rows is sorted by a window.
LAST_ROWS = 500_000

#: Counted values in one range partition of running totals.
RANGE_ROWS = 200_000


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; ``right`` has one row per key."""
    named = [f"_key_{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[n]) for k, n in zip(keys, named)])
    return left.join(renamed, same, how).drop(*named)


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = "pos") -> DataFrame:
    """Position 0, 1, 2, ... of each row inside its key.

    ``chunk`` must never decrease along ``order`` (row number divided by a block
    size, a date cut to the month, ...), so that a chunk is a consecutive block.
    A null key is a key; rows with a null chunk come first.
    """
    base = df.withColumn("_chunk", chunk)
    sizes = base.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        join_keys(base, offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_chunk", "_before")
    )


def _differs(c: pa.Array) -> np.ndarray:
    """Whether each entry differs from the one before it; null equals null."""
    a, b = c.slice(0, len(c) - 1), c.slice(1)
    out = np.zeros(len(c), dtype=bool)
    unequal = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    out[1:] = unequal.to_numpy(zero_copy_only=False)
    return out


def _sum_along(by: list[str], totals: list[str]):
    """Running sums of sorted rows, begun anew with each key; only the last sums are carried from batch to batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_key, carried = TaskContext.get().partitionId(), None, [0] * len(totals)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in by:
                new |= _differs(column[c])
            key = [column[c][0].as_py() for c in by]
            new[0] = key != last_key
            starts = np.flatnonzero(new)
            sums = []
            for i, c in enumerate(totals):
                run_sum = np.cumsum(column[c].to_numpy(zero_copy_only=False).astype(np.int64))
                # What was summed up before the key began, and for the first key what earlier batches bring.
                before = np.zeros(len(run_sum), dtype=np.int64)
                if len(starts):
                    before[starts] = np.diff(np.insert(run_sum[starts - 1] * (starts > 0), 0, 0))
                    before = np.cumsum(before)
                out = run_sum - before
                first = starts[0] if len(starts) else len(out)
                out[:first] += carried[i]
                sums.append(out)
                carried[i] = int(out[-1])
            last_key = [column[c][batch.num_rows - 1].as_py() for c in by]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x) for x in sums], pa.array(np.full(batch.num_rows, part, dtype=np.int32))],
                names=[*batch.schema.names, *["cum_" + c for c in totals], "_part"])
    return run


def running_totals(counts: DataFrame, value: str, totals: list[str], by: list[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum along ``value``) for each count column, per key of ``by``.

    ``counts`` holds one row per key and value, with whole counts. It is dealt by range of
    (key, value), in as many parts as its rows ask for; a part sums up what it holds, and
    one row per key and part carries what lies before. A null key is a key.
    """
    by = list(by)
    base = cut_lineage(counts)
    parts = max(-(-base.count() // range_rows), 1)
    schema = StructType([*base.schema.fields, *[StructField("cum_" + c, LongType()) for c in totals], StructField("_part", IntegerType())])
    ranged = base.repartitionByRange(parts, *by, value).sortWithinPartitions(*by, value)
    # Read twice below, so it is made once.
    summed = cut_lineage(ranged.mapInArrow(_sum_along(by, list(totals)), schema))
    ends = summed.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in totals])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*by, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias("_before_" + c) for c in totals])
    out = join_keys(summed, offsets, [*by, "_part"])
    return out.withColumns({"cum_" + c: F.col("cum_" + c) + F.col("_before_" + c) for c in totals}).select(*base.columns, *["cum_" + c for c in totals])


def _step(v: Column, lo: Column, hi: Column, kind: DataType, steps: int) -> Column:
    """Step of a value between ``lo`` and ``hi``: 0 for lo, the last for hi, never falling in between."""
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        # Infinite values and NaN count as the largest finite ones here; they are their own steps as lo and hi.
        most = 1.7976931348623157e308
        bound = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-most)), F.lit(most)) / 2
        # Over many powers of two the steps follow the exponent, which ranges over some 2,100.
        octave = lambda c: F.when(bound(c) == 0, 0.0).otherwise(F.signum(bound(c)) * (F.log2(F.abs(bound(c))) + 1100))
        wide = octave(hi) - octave(lo) > 24
        share = F.when(wide, F.try_divide(octave(v) - octave(lo), octave(hi) - octave(lo))).otherwise(F.try_divide(bound(v) - bound(lo), bound(hi) - bound(lo)))
    else:
        exact = (lambda c: c) if isinstance(kind, DecimalType) else (lambda c: c.cast("decimal(20,0)"))
        share = F.try_divide((exact(v) - exact(lo)).cast("double"), (exact(hi) - exact(lo)).cast("double"))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * (steps - 2)), F.lit(steps - 3)) + 1
    return F.when(v == lo, 0).when(v == hi, steps - 1).otherwise(inner).cast("int")


def _between(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Every value with each bracket of its group that holds it."""
    if by:
        found = join_keys(rows, brackets, by)
    else:
        # As many rows as ranks are asked for.
        kinds = {f.name: f.dataType for f in brackets.schema}
        known = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in brackets.columns]) for r in brackets.collect()]
        found = rows.select("_v", F.inline(F.array(*known))) if known else rows.select("_v", *[F.lit(None).cast(kinds[c]).alias(c) for c in brackets.columns]).limit(0)
    return found.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float | str], last_rows: int = LAST_ROWS, steps: int = STEPS
) -> DataFrame:
    """Exact order statistics per group (a null group is one): one row per group, one column per entry of ``probs``.

    A number asks for the nearest rank of ``q * (n - 1)``; ``"median"`` for the
    mean of the middle two. Selection goes in rounds: a round counts the values of an open
    range in ``steps`` equal steps and goes on inside the one with the wanted rank, between
    the least and the largest value seen there. As the ends of a range always fall into
    different steps, this ends by itself, at the latest with a single value; ranges of
    ``last_rows`` rows or less are sorted by a window. Groups that are this small from
    the start, however many, are never searched.
    """
    by = list(by)
    rows = cut_lineage(df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()))
    kind = rows.schema["_v"].dataType
    last = F.col("_n") - 1
    ranks: list[Column] = []
    places: dict[str, list[int]] = {}
    for name, p in probs.items():
        wanted = [F.floor(last / 2), F.ceil(last / 2)] if p == "median" else [F.floor(last * F.lit(float(p)) + 0.5)]
        places[name] = list(range(len(ranks), len(ranks) + len(wanted)))
        ranks += wanted
    rank = F.get(F.array(*[r.cast("bigint") for r in ranks]), F.col("_id"))
    small = F.col("_n") <= last_rows
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n > 0")
    ids = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(len(ranks) - 1)))
    brackets = cut_lineage(groups.select(*by, "_n", F.col("_n").alias("_rows"), F.lit(0).cast("bigint").alias("_before"), "_lo", "_hi", F.explode(ids).alias("_id")))
    while True:
        searched = brackets.filter((F.col("_rows") > last_rows) & (F.col("_lo") < F.col("_hi")))
        if searched.isEmpty():
            break
        counted = (
            _between(rows, searched, by).withColumn("_step", _step(F.col("_v"), F.col("_lo"), F.col("_hi"), kind, steps))
            .groupBy(*by, "_id", "_n", "_before", "_step").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        )
        upto = Window.partitionBy(*by, "_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            counted.withColumn("_to", F.col("_before") + F.sum("_c").over(upto)).filter(F.col("_to") > rank)
            .groupBy(*by, "_id").agg(F.min(F.struct("_step", "_least", "_most", "_c", (F.col("_to") - F.col("_c")).alias("_from"))).alias("_f"))
        )
        narrowed = lambda f, c: F.coalesce(F.col(f"_f.{f}"), F.col(c)).alias(c)
        brackets = cut_lineage(join_keys(brackets, found, [*by, "_id"], "left").select(
            *by, "_n", narrowed("_c", "_rows"), narrowed("_from", "_before"), narrowed("_least", "_lo"), narrowed("_most", "_hi"), "_id"))
    grouped = _between(rows, brackets, by).groupBy(*by, "_id", "_n", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = grouped.withColumn("_to", F.col("_before") + F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(i: int) -> Column:
        hit = (F.col("_from") <= ranks[i]) & (ranks[i] < F.col("_to")) & (small | (F.col("_id") == i))
        return F.max(F.when(hit, F.col("_v")))

    aggs = [(at(own[0]) if len(own) == 1 else (at(own[0]) + at(own[1])) / 2).alias(name) for name, own in places.items()]
    return ranked.groupBy(*by).agg(*aggs)
