"""Connected components of an edge list by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import shared_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), v < u.

    Large: each node links its larger neighbours to the least node it knows. Small: each
    node links its smaller neighbours and itself to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the least node of its component.

    Rounds of large and small stars until the edges stay as they are, then each node
    points to its root. Each round is a table in the shared folder.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    state = shared_table(ordered)
    mark = None
    while True:
        seen = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        state = shared_table(_stars(_stars(state, True), False))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
