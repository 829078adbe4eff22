"""Entity resolution: exact identifiers first, then company names."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions.similarity import accept_scores, jaro_batch
from surveyloom.session import cut_lineage

#: Search names whose stems form one automaton, and pool names that it is run over in one task.
SEARCH_BLOCK = 50_000
POOL_PART = 10_000

#: Candidates scored at once.
SCORE_BATCH = 20_000


def search_stem(name: Column) -> Column:
    """First four fifths of a name, rounded down."""
    return F.substring(name, 1, F.floor(F.length(name) / 5 * 4).cast("int"))


def _hits(stems: list[str], pool: list[str]):
    """(pool index, indices of the stems inside it); each pool name is read once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, stem in enumerate(stems):
        automaton.add_word(stem, i)
    automaton.make_automaton()
    for k, name in enumerate(pool):
        found = {i for _, i in automaton.iter(name)}
        if found:
            yield k, found


def _names_by_stem(left: pa.Table) -> tuple[list[str], list[str], list[list[int]]]:
    """Search names, their distinct stems, and for each stem its names."""
    names, by_stem = left.column("name").to_pylist(), defaultdict(list)
    for i, stem in enumerate(left.column("stem").to_pylist()):
        by_stem[stem].append(i)
    return names, list(by_stem), list(by_stem.values())


def _best_rows(names: list[str], best: dict[int, tuple]) -> pa.Table:
    return pa.table({
        "name": pa.array([names[i] for i in best], pa.string()), "match": pa.array([b[2] for b in best.values()], pa.string()),
        "score": pa.array([b[0] for b in best.values()], pa.float64()), "pool_order": pa.array([-b[1] for b in best.values()], pa.int64()),
    })


def _first_of_equal_length(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of the pool names that hold the stem and are as long as the name, the first."""
    names, stems, members = _names_by_stem(left)
    pool, order = right.column("match").to_pylist(), right.column("pool_order").to_pylist()
    wanted = [{len(names[i]) for i in own} for own in members]
    first: dict[tuple[int, int], tuple] = {}
    if stems:
        for k, found in _hits(stems, pool):
            n = len(pool[k])
            for s in found:
                if n in wanted[s]:
                    key = (s, n)
                    if key not in first or order[k] < first[key][0]:
                        first[key] = (order[k], pool[k])
    best = {}
    for s, own in enumerate(members):
        for i in own:
            if (s, len(names[i])) in first:
                at, match = first[s, len(names[i])]
                best[i] = (float("inf"), -at, match)
    return _best_rows(names, best)


def _best_score(finite_length: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the pool names that hold the stem, the one with the best score; ties go to the first."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, stems, members = _names_by_stem(left)
        pool, order = right.column("match").to_pylist(), right.column("pool_order").to_pylist()
        best: dict[int, tuple] = {}
        waiting: list[tuple[int, int]] = []

        def score() -> None:
            n, p = np.array(waiting, dtype=np.int64).T
            length = np.array([len(names[i]) for i in n], dtype=np.float64)
            other = np.array([len(pool[k]) for k in p], dtype=np.float64)
            gap = np.abs(other - length)
            with np.errstate(divide="ignore"):
                near = 1.0 / (1.0 + gap) if finite_length else 1.0 / gap
            # No similarity is above this, so a pair that cannot reach the best so far is not compared.
            whole = (2.0 + np.minimum(length, other) / np.maximum(length, other)) / 3.0
            reached = np.array([best[i][0] if i in best else -1.0 for i in n])
            at = np.flatnonzero(np.sqrt(whole * whole + 4.0 + near * near) * (1 + 1e-12) >= reached)
            n, p, near = n[at], p[at], near[at]
            left_names, matches = [names[i] for i in n], [pool[k] for k in p]
            whole = jaro_batch(matches, left_names)
            prefix = jaro_batch([m[: len(x)] for m, x in zip(matches, left_names)], left_names)
            total = np.sqrt(whole * whole + 4 * prefix * prefix + near * near)
            for i, k, value in zip(n.tolist(), p.tolist(), total.tolist()):
                candidate = (value, -order[k], pool[k])
                if i not in best or candidate > best[i]:
                    best[i] = candidate
            waiting.clear()

        if stems:
            for k, found in _hits(stems, pool):
                waiting.extend((i, k) for s in found for i in members[s])
                if len(waiting) >= SCORE_BATCH:
                    score()
            if waiting:
                score()
        return _best_rows(names, best)
    return run


def _search(names: DataFrame, pool: DataFrame, scan: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Best pool name per search name over all blocks of names and parts of the pool.

    Every block of names meets every part of the pool in one task, which gives one row
    per name at most: the work is a scan of the pool for each block, and pairs of
    names are never rows. Blocks and parts are dealt by hash, so their size is bounded.
    """
    blocks, parts = (max(-(-df.count() // size), 1) for df, size in ((names, SEARCH_BLOCK), (pool, POOL_PART)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = names.select("name", "stem", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("_block"), all_of(parts).alias("_part"))
    right = pool.select("match", "pool_order", F.pmod(F.xxhash64("match"), F.lit(parts)).cast("int").alias("_part"), all_of(blocks).alias("_block"))
    found = left.groupBy("_block", "_part").cogroup(right.groupBy("_block", "_part")).applyInArrow(scan, "name string, match string, score double, pool_order bigint")
    best = F.max(F.struct("score", (-F.col("pool_order")).alias("first"), "match")).alias("b")
    return found.groupBy("name").agg(best).select("name", F.col("b.match").alias("match"))


def best_name_match(search: DataFrame, pool: DataFrame, finite_length: bool = False) -> DataFrame:
    """Best pool name per search name: ``name, match``; names without candidate are left out.

    ``search``: distinct ``name``; ``pool``: ``match, pool_order`` (repeats are
    reduced to their first). A candidate holds the stem of the name. Its score is
    sqrt(whole^2 + 4 prefix^2 + length^2): the Jaro similarities of the whole names and of
    the name with as many first characters of the candidate, and one over the length
    difference, so equal lengths score infinity and beat everything;
    ``finite_length`` uses one over one plus it. Ties go to the first pool name. Names
    of one character have an empty stem and get no candidate.

    Stems are found by one automaton per block of names, run over each pool name
    once. With the default score the first pass finds the winner among equal lengths,
    which needs no similarity; the second scores for the names it left open.
    """
    # Distinct names and candidates are read by several steps below.
    pool = cut_lineage(pool.filter(F.col("match").isNotNull()).groupBy("match").agg(F.min("pool_order").cast("bigint").alias("pool_order")))
    names = search.select("name").distinct().withColumn("stem", search_stem(F.col("name"))).filter(F.length("stem") > 0)
    names = cut_lineage(names)
    if finite_length:
        return _search(names, pool, _best_score(True))
    exact = cut_lineage(_search(names, pool, _first_of_equal_length))
    left_open = cut_lineage(names.join(exact.select("name"), "name", "left_anti"))
    return exact.unionByName(_search(left_open, pool, _best_score(False)))


def accept_matches(matches: DataFrame, keep: DataFrame | None = None, at_least: float = 1.0) -> DataFrame:
    """Similarities of the proposed match, and ``include``: any reaches the limit or the name is allow-listed.

    ``keep``: hand-checked ``name`` list.
    """
    out = matches.select("*", *accept_scores(F.col("name"), F.col("match")))
    hit = (F.col("sim_whole") >= at_least) | (F.col("sim_match_prefix") >= at_least) | (F.col("sim_name_prefix") >= at_least)
    if keep is not None:
        listed = keep.select("name").distinct().withColumn("_keep", F.lit(True))
        out = out.join(listed, "name", "left")
        hit = hit | F.coalesce("_keep", F.lit(False))
    return out.withColumn("include", F.coalesce(hit, F.lit(False)).cast("int")).drop("_keep")


def resolve_entities(
    accounts: DataFrame, reference: DataFrame, finite_length: bool = False, keep: DataFrame | None = None
) -> DataFrame:
    """Reference id per account: by identifier where it is known, else by accepted name match.

    ``accounts``: ``account, isin, name``; ``reference``: ``ref_id, isin, name,
    order``. Result: ``account, name, ref_id, how``.
    """
    by_isin = reference.dropna(subset=["isin"]).groupBy("isin").agg(F.min_by("ref_id", "order").alias("ref_id"))
    exact = cut_lineage(accounts.join(by_isin, "isin", "left"))
    found = exact.filter(F.col("ref_id").isNotNull()).select("account", "name", "ref_id", F.lit("isin").alias("how"))
    rest = exact.filter(F.col("ref_id").isNull() & F.col("name").isNotNull()).select("account", "name")
    pool = reference.select(F.col("name").alias("match"), F.col("order").alias("pool_order"))
    accepted = accept_matches(best_name_match(rest.select("name"), pool, finite_length), keep).filter("include = 1")
    ids = reference.groupBy(F.col("name").alias("match")).agg(F.min_by("ref_id", "order").alias("ref_id"))
    named = rest.join(accepted.select("name", "match"), "name").join(ids, "match")
    return found.unionByName(named.select("account", "name", "ref_id", F.lit("name").alias("how")))
