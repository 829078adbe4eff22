"""String and vector similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors; zero when either is empty or missing."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))
    )
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points, one row per string, padded with zero."""
    padded = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32).reshape(len(strings), width)


def jaro_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of many pairs at once, one vector step per character."""
    n = len(left)
    la = np.fromiter((len(s) for s in left), dtype=np.int64, count=n)
    lb = np.fromiter((len(s) for s in right), dtype=np.int64, count=n)
    wa, wb = max(int(la.max(initial=0)), 1), max(int(lb.max(initial=0)), 1)
    a, b = _codes(left, wa), _codes(right, wb)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    cols = np.arange(wb)
    hit_a = np.zeros((n, wa), dtype=bool)
    hit_b = np.zeros((n, wb), dtype=bool)
    rows = np.arange(n)
    for i in range(wa):
        free = (b == a[:, i, None]) & ~hit_b & (np.abs(cols[None, :] - i) <= window[:, None])
        free &= (cols[None, :] < lb[:, None]) & (i < la)[:, None]
        j = free.argmax(axis=1)
        found = free[rows, j]
        hit_a[found, i] = True
        hit_b[rows[found], j[found]] = True
    m = hit_a.sum(axis=1)
    # Matched characters, packed left in their own order, compared position by position.
    order_a = np.argsort(~hit_a, axis=1, kind="stable")
    order_b = np.argsort(~hit_b, axis=1, kind="stable")
    seq_a = np.take_along_axis(np.where(hit_a, a, 0), order_a, axis=1)
    seq_b = np.take_along_axis(np.where(hit_b, b, 0), order_b, axis=1)
    w = min(wa, wb)
    swaps = (seq_a[:, :w] != seq_b[:, :w]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (m / la + m / lb + (m - swaps) / m) / 3.0
    out = np.where(m > 0, out, 0.0)
    return np.where((la == 0) & (lb == 0), 1.0, out)


@F.pandas_udf(T.DoubleType())
def _jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    ok = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    left, right = a.to_numpy(), b.to_numpy()
    # Similar lengths share a step, so padding stays small.
    ok = ok[np.argsort([len(left[k]) + len(right[k]) for k in ok], kind="stable")]
    for start in range(0, len(ok), 2048):
        part = ok[start:start + 2048]
        out[part] = jaro_batch([left[k] for k in part], [right[k] for k in part])
    series = pd.Series(out)
    return series.where(series.notna(), None)


def jaro(a: Column, b: Column) -> Column:
    """Plain Jaro similarity; Spark has no built-in, so Arrow batches go to numpy."""
    return _jaro_udf(a, b)


def accept_scores(name: Column, match: Column) -> list[Column]:
    """The three similarities that decide on a proposed name match."""
    return [
        jaro(name, match).alias("sim_whole"),
        jaro(name, F.substring(match, 1, F.length(name))).alias("sim_match_prefix"),
        jaro(match, F.substring(name, 1, F.length(match))).alias("sim_name_prefix"),
    ]
