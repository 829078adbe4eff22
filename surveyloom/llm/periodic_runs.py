"""Periodic runs of words by maximal pairs over an LCP-interval tree.

A run with period q from word s to word e is the maximal pair (s, s + q): the words from s
and from s + q on agree for e - s - q words, and differ before and after. So runs are
read off the tree of LCP intervals, bottom up: an interval of depth d holds, in text order,
the positions whose next d words are equal, each with the word to its left as its class.
When two children meet, a position of the smaller is compared with its neighbours of the
larger; a pair of different classes whose distance q fits the depth (d + q words are at
least ``shortest`` and ``repeats`` * q) is a run as it stands. Nothing is extended.

Neighbours suffice: between s and s + q, for the smallest period q, the words from s do not
occur again, since a period block would then be a rotation of itself. Pairs at multiples
of the smallest period cover the same words; of runs over the same words the one with
the least distance stays.

Suffixes are sorted by prefix doubling, all texts of a slice at once, and only as long as
they tie. Before the tree is walked, positions that cannot be in such a pair go: those whose
longest common prefix with any other is too short, for the shortest pair or for the distance
of the nearest position in the same tree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import text_key, text_slices
from surveyloom.llm.words import ROLLER_A, ROLLER_B, Roller, hash_words, mix, split_words

SHORTEST = 6
REPEATS = 4

#: Rounds of leaving out positions that cannot be in a pair; more would only save time.
PRUNINGS = 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"
RUN_SCHEMA = f"doc_id bigint, text_key bigint, n_words bigint, n_dropped bigint, runs array<{_RUN_SQL}>, best {_RUN_SQL}, collapsed_sha256 string"


def shortest_pair(shortest: int, repeats: int) -> int:
    """Least length of a pair that is a run, over all periods."""
    return min(max(shortest, repeats * q) - q for q in range(1, shortest + 1))


def sorted_suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose next ``depth`` or more words occur elsewhere too, as a suffix array.

    ``ids``: whole numbers of the words, different in different texts. ``depth`` is a power
    of two. Prefix doubling on the positions that still tie.
    """
    n = len(ids)
    _, rank, times = np.unique(ids, return_inverse=True, return_counts=True)
    starts = np.cumsum(times) - times
    rank = np.append(starts[rank], -1)
    active = np.flatnonzero(np.bincount(rank[:-1], minlength=n)[rank[:-1]] > 1)
    chosen = active if depth == 1 else None
    step = 1
    while len(active):
        key = rank[active] * (n + 1) + rank[np.minimum(active + step, n)] + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        group = rank[active]
        new_key = np.flatnonzero(np.diff(key, prepend=-1))
        new_group = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(new_key, len(active)))
        group_start = np.repeat(new_group, np.diff(np.append(new_group, len(active))))
        key_start = np.repeat(new_key, sizes)
        rank[active] = group + key_start - group_start
        active = active[np.repeat(sizes, sizes) > 1]
        step *= 2
        if step == depth:
            chosen = active
    if chosen is None or not len(chosen):
        return np.zeros(0, dtype=np.int64)
    return chosen[np.argsort(rank[chosen], kind="stable")]


def common_prefixes(suffixes: np.ndarray, ids: np.ndarray, end: np.ndarray, roller: Roller) -> np.ndarray:
    """Words that each position shares with the one before it in the array; 0 for the first."""
    out = np.zeros(len(suffixes), dtype=np.int64)
    if len(suffixes) < 2:
        return out
    a, b = suffixes[:-1], suffixes[1:]
    prefix = roller.prefix(mix(ids.astype(np.uint64)))
    limit = np.where(end[a] == end[b], end[a] - np.maximum(a, b), 0)
    found = np.zeros(len(a), dtype=np.int64)
    step = 1 << max(int(limit.max()).bit_length() - 1, 0)
    while step:
        at = np.flatnonzero(found + step <= limit)
        i, j, have = a[at], b[at], found[at]
        same = roller.span(prefix, i + have, i + have + step) == roller.span(prefix, j + have, j + have + step)
        found[at[same]] += step
        step //= 2
    out[1:] = found
    return out


def _prune(suffixes: np.ndarray, lcp: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(PRUNINGS):
        if not len(suffixes):
            break
        longest = np.maximum(lcp, np.append(lcp[1:], 0))
        tree = np.cumsum(lcp < least)
        order = np.lexsort((suffixes, tree))
        gap = np.diff(suffixes[order])
        gap[np.diff(tree[order]) > 0] = np.iinfo(np.int64).max // (repeats + 1)
        far = np.iinfo(np.int64).max // (repeats + 1)
        nearest = np.empty(len(suffixes), dtype=np.int64)
        nearest[order] = np.minimum(np.append(gap, far), np.insert(gap, 0, far))
        keep = np.flatnonzero(longest >= np.maximum(least, (repeats - 1) * nearest))
        if len(keep) == len(suffixes):
            break
        if not len(keep):
            return suffixes[:0], lcp[:0]
        # The prefix shared with the last one kept is the least since then.
        since = np.minimum.reduceat(lcp, np.insert(keep[:-1] + 1, 0, 0)) if len(keep) > 1 else lcp[:1]
        ends = keep[-1]
        if len(keep) > 1:
            since[-1] = lcp[keep[-2] + 1: ends + 1].min()
        suffixes, lcp = suffixes[keep], since
        lcp[0] = 0
    return suffixes, lcp


def _walk(suffixes: list[int], lcp: list[int], left: list[int], shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, distance, depth) of the pairs of one tree, bottom up."""
    pairs: list[tuple[int, int, int]] = []

    def meet(one: list[int], other: list[int], depth: int) -> list[int]:
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        for p in small:
            k = bisect_left(large, p)
            for x in large[max(k - 1, 0): k + 1]:
                q = abs(p - x)
                if depth + q >= shortest and depth + q >= repeats * q and left[p] != left[x]:
                    pairs.append((min(p, x), q, depth))
        for p in small:
            insort(large, p)
        return large

    stack: list[tuple[int, list[int]]] = []
    for position, depth in zip([*suffixes, -1], [*lcp, 0]):
        # ``depth`` is shared with the position before, so intervals deeper than it are complete.
        if stack:
            _, held = stack.pop()
            while stack and stack[-1][0] > depth:
                inner, below = stack.pop()
                held = meet(below, held, inner)
            if stack and stack[-1][0] == depth:
                held = meet(stack.pop()[1], held, depth)
            stack.append((depth, held))
        stack.append((0, [position]))
    return pairs


def runs_of(ids: np.ndarray, first: np.ndarray, shortest: int, repeats: int, roller: Roller) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period.

    ``first[i]:first[i + 1]`` are the words of text i; equal ids in one text are equal words.
    """
    least = shortest_pair(shortest, repeats)
    suffixes = sorted_suffixes(ids, 1 << (least.bit_length() - 1))
    end = np.repeat(first[1:], np.diff(first))
    suffixes, lcp = _prune(suffixes, common_prefixes(suffixes, ids, end, roller), least, repeats)
    if not len(suffixes):
        return np.zeros((0, 3), dtype=np.int64)
    left = np.insert(ids[:-1], 0, -1)
    left[first[:-1][first[:-1] < len(ids)]] = -1
    heads = np.flatnonzero(lcp < least)
    bounds = np.append(heads, len(suffixes))
    sizes = np.diff(bounds)
    # Trees of two positions are one pair each.
    two = heads[sizes == 2]
    a, b, depth = suffixes[two], suffixes[np.minimum(two + 1, len(suffixes) - 1)], lcp[np.minimum(two + 1, len(lcp) - 1)]
    q = np.abs(a - b)
    hit = (depth + q >= np.maximum(shortest, repeats * q)) & (left[a] != left[b])
    found = [np.stack([np.minimum(a, b), q, depth], axis=1)[hit]]
    for at, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        members = suffixes[at: at + size].tolist()
        pairs = _walk(members, [0, *lcp[at + 1: at + size].tolist()], dict(zip(members, left[suffixes[at: at + size]].tolist())), shortest, repeats)
        if pairs:
            found.append(np.array(pairs, dtype=np.int64))
    pairs = np.concatenate(found)
    runs = np.stack([pairs[:, 0], pairs[:, 1] + pairs[:, 2], pairs[:, 1]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    once = np.ones(len(runs), dtype=bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[once]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def holds(words: list[bytes], runs: np.ndarray) -> bool:
    """Whether the words of each run do repeat at its period, byte by byte."""
    return all(words[s: s + n - q] == words[s + q: s + n] for s, n, q in runs.tolist())


def exact_runs(words: list[bytes], shortest: int, repeats: int) -> np.ndarray:
    """Runs of one text with ids from the words themselves, for texts in which hashes met."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    runs = runs_of(ids, np.array([0, len(ids)]), shortest, repeats, ROLLER_B)
    if not holds(words, runs):
        raise ValueError("word windows of one text share their hash under both bases")
    return runs


def _best(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run of the greatest length / period; the first of equal ones."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return None if best is None else {"start": best[0], "length": best[1], "period": best[2]}


def _find(shortest: int, repeats: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(2)):
                words = split_words(texts)
                text = words.text_of()
                # Ids differ between texts, so nothing is shared across them.
                ids = mix(hash_words(words) + mix(text.astype(np.uint64))).view(np.int64)
                runs = runs_of(ids, words.first, shortest, repeats, ROLLER_A)
                runs_first = np.searchsorted(runs[:, 0], words.first)
                out: list[list] = [[], [], [], [], []]
                for i, raw in enumerate(texts.to_pylist()):
                    tokens = (raw or "").encode().split()
                    own = runs[runs_first[i]: runs_first[i + 1]] - [words.first[i], 0, 0]
                    if not holds(tokens, own):
                        own = exact_runs(tokens, shortest, repeats)
                    gone = 0
                    if len(own):
                        marks = np.zeros(len(tokens) + 1, dtype=np.int64)
                        np.add.at(marks, own[:, 0] + own[:, 2], 1)
                        np.add.at(marks, own[:, 0] + own[:, 1], -1)
                        kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
                        gone = len(tokens) - len(kept)
                        tokens = [tokens[k] for k in kept.tolist()]
                    rows = own.tolist()
                    collapsed = b" ".join(tokens)
                    out[0].append(gone)
                    out[1].append([{"start": s, "length": n, "period": q} for s, n, q in rows])
                    out[2].append(_best(rows))
                    out[3].append(hashlib.sha256(collapsed).hexdigest())
                    out[4].append(collapsed)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), batch.column(1).slice(row, len(texts)), pa.array(words.counts(), pa.int64()), pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.list_(RUN)), pa.array(out[2], RUN), pa.array(out[3]), *([pa.array(out[4], pa.binary()).cast(pa.string())] if keep_text else []),
                ], names=["doc_id", "text_key", "n_words", "n_dropped", "runs", "best", "collapsed_sha256", *(["collapsed"] if keep_text else [])])
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_dropped, runs, best, collapsed_sha256.

    Words are runs of characters outside 0x20 and 0x09-0x0D. A run is a stretch of words
    with smallest period q, of at least ``shortest`` and ``repeats`` * q words, that no
    neighbouring word extends; ``repeats`` is 2 or more. ``runs`` are (start, length, period)
    by start, then period, ``best`` the one of the greatest length / period (the first of
    equal ones, null without runs). A word goes if a run holds it after its first period;
    ``collapsed`` (with ``keep_text``) is the others joined by one space, and its SHA-256.

    A null or empty text has no words and no runs. Rows are judged one by one, repeated
    ones too; a text is handled by one task, in memory a fixed multiple of its size. An empty
    table gives no rows. Other columns are not read.
    """
    if repeats < 2 or shortest < 2:
        raise ValueError("a run has two periods or more")
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_key(f"`{text_col}`").alias("text_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(_find(shortest, repeats, keep_text), RUN_SCHEMA + (", collapsed string" if keep_text else ""))
