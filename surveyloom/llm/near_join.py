"""N-gram Jaccard self-join with Bayesian pruning of candidate pairs.

Texts with the same words in the same order are one class, compared once. Classes that
share a band of MinHash values are candidates. The MinHash values of a candidate pair
are compared some at a time; given m of n equal, the similarity has a Beta(m + 1,
n - m + 1) posterior (uniform prior), and a pair goes as soon as the probability that it
reaches the threshold is below the tolerance.

That is done twice. First in each bucket of a band, on one byte of each value: bytes of
equal values are equal, so no pair goes there that would stay on whole values. What
stays connects classes into components, so texts that only chance bands chain together
are not gathered. A bucket is searched along its links, seen classes are not compared
again, and gives one edge per class. Then each component is compared inside tasks: its
classes are dealt into blocks of bounded weight, a task holds two blocks. The pairs
left there are verified on their whole shingle sets. Pairs never become rows: a task
emits, for each class, the links it has found and the least class it is linked with.

A bucket or a component of any size is split over as many tasks as pairs of blocks. Missed links: a
pair at the threshold shares none of the bands with probability (1 - 0.8^5)^25 < 5e-5,
and falls under the tolerance with 1e-6 a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import BATCH_ROWS, WORD_BYTES, marked_by, marked_keys, shared_table, text_key, text_slices
from surveyloom.llm.graph import components
from surveyloom.llm.words import ROLLER_A, ROLLER_B, hash_words, mix, split_words, window_starts

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BANDS, BAND_ROWS = 25, 5
STEP = 16
TOLERANCE = 1e-6

#: Weight of a block: classes, each counted once more for every so many shingles.
BLOCK_WEIGHT = 256
WEIGHT_SHINGLES = 2_000

#: Classes in a block of a bucket; a task holds two blocks of a bucket that has more.
BUCKET_BLOCK = 2_048

#: From so many pairs on, a task verifies by matrix products instead of pair by pair.
DENSE_PAIRS = 3_000

SKETCH_SCHEMA = "doc_id bigint, text_key bigint, s1 bigint, s2 bigint, shingles int, minhash binary"
FOUND_SCHEMA = "node bigint, links bigint, least bigint, split boolean"


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:HASHES], numbers[HASHES:] | np.uint64(1)


def shingle_hashes(words, k: int):
    """(hash of each run of k words, text of each)."""
    prefix = ROLLER_A.prefix(hash_words(words))
    at, text = window_starts(words.counts(), words.first, k)
    return ROLLER_A.span(prefix, at, at + k), text


def minhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) upper halves of the least value of each hash function per text."""
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for j, (flip, factor) in enumerate(zip(*_seeds())):
        out[:, j] = np.minimum.reduceat((hashes ^ flip) * factor, starts) >> np.uint64(32)
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(2), WORD_BYTES):
                words = split_words(texts)
                hashes, text = shingle_hashes(words, k)
                n = np.maximum(words.counts() - k + 1, 0)
                some = n > 0
                starts = (np.cumsum(n) - n)[some]
                signs = minhashes(hashes, starts) if some.any() else np.zeros((0, HASHES), dtype=np.uint32)
                s1 = ROLLER_A.span(ROLLER_A.prefix(hash_words(words)), words.first[:-1], words.first[1:])
                s2 = ROLLER_B.span(ROLLER_B.prefix(hash_words(words, 1)), words.first[:-1], words.first[1:])
                blobs = np.full(words.texts, None, dtype=object)
                blobs[some] = [s.tobytes() for s in signs]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, words.texts), batch.column(1).slice(row, words.texts),
                    pa.array(s1.view(np.int64), mask=~some), pa.array(s2.view(np.int64), mask=~some),
                    pa.array(n.astype(np.int32)), pa.array(list(blobs), pa.binary()),
                ], names=["doc_id", "text_key", "s1", "s2", "shingles", "minhash"])
    return run


def band_keys(signs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hash of each band of MinHash values, told apart by the band."""
    out = np.empty((len(signs), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(signs), b + 1, dtype=np.uint64)
        for r in range(BAND_ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signs[:, b * BAND_ROWS + r])
        out[:, b] = h
    return out


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each MinHash value."""
    for batch in batches:
        low = np.ascontiguousarray((_signs(batch.column(1)) & np.uint32(255)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in low], pa.binary())], names=["member", "code"])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_signs(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], names=["band", "node"])


def _shingles(k: int):
    """Whole shingle sets of the texts, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(0), WORD_BYTES):
                words = split_words(texts)
                hashes, _ = shingle_hashes(words, k)
                cuts = np.cumsum(np.maximum(words.counts() - k + 1, 0))[:-1]
                sets = [np.unique(h).tobytes() for h in np.split(hashes, cuts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, words.texts) for i in range(1, 6)), pa.array(sets, pa.binary())],
                                                 names=["root", "node", "size", "blocks", "minhash", "shingles"])
    return run


@lru_cache(maxsize=8)
def least_equal(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values, the least number of equal ones that keeps a pair.

    P(similarity >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def chained(codes: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """For each row of codes, the first row that pairs outliving the incremental comparison connect it with."""
    least = least_equal(threshold, tolerance)
    root, left = np.arange(len(codes)), np.arange(len(codes))
    while len(left):
        seed, left = left[0], left[1:]
        reached = [seed]
        while reached and len(left):
            code = codes[reached.pop()]
            at, equal = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
            for step in range(0, HASHES, STEP):
                equal += (codes[left[at], step: step + STEP] == code[step: step + STEP]).sum(axis=1)
                alive = equal >= least[step + STEP]
                at, equal = at[alive], equal[alive]
            root[left[at]] = seed
            reached.extend(left[at].tolist())
            left = np.delete(left, at)
    return root


def _bucket_edges(threshold: float, tolerance: float):
    """Sorted rows (band, i, j, node, code) -> an edge from each class to the first one of its chain in the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, codes = None, [], []

        def edges() -> pa.RecordBatch:
            node = np.array(nodes, dtype=np.int64)
            first = node[chained(np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, HASHES), threshold, tolerance)]
            return pa.RecordBatch.from_arrays([pa.array(node[first < node]), pa.array(first[first < node])], names=["u", "v"])

        for batch in batches:
            for *now, node, code in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key and len(nodes) > 1:
                    yield edges()
                if now != key:
                    key, nodes, codes = now, [], []
                nodes.append(node)
                codes.append(code)
        if len(nodes) > 1:
            yield edges()
    return run


def candidate_pairs(signs_a: np.ndarray, signs_b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that share a band and outlive the incremental comparison."""
    keys_a, keys_b = band_keys(signs_a), band_keys(signs_b)
    hit = np.zeros((len(signs_a), len(signs_b)), dtype=bool)
    for b in range(BANDS):
        hit |= keys_a[:, b][:, None] == keys_b[:, b][None, :]
    if same:
        hit = np.triu(hit, 1)
    p, q = np.nonzero(hit)
    equal = np.zeros(len(p), dtype=np.int64)
    least = least_equal(threshold, tolerance)
    for at in range(0, HASHES, STEP):
        equal += (signs_a[p, at: at + STEP] == signs_b[q, at: at + STEP]).sum(axis=1)
        alive = equal >= least[at + STEP]
        p, q, equal = p[alive], q[alive], equal[alive]
    return p, q


def shared_shingles(sets_a: list[np.ndarray], sets_b: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact size of the intersection for each pair."""
    if len(p) < DENSE_PAIRS:
        out = np.empty(len(p), dtype=np.int64)
        for i, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
            x, y = sets_a[a], sets_b[b]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[i] = np.count_nonzero(y[at] == x)
        return out
    sizes = [len(s) for s in (*sets_a, *sets_b)]
    _, place, times = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    row = np.repeat(np.arange(len(sizes)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets_a), len(sets_b)), dtype=np.float64)
    width = 2_048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(sizes), width), dtype=np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        total += dense[: len(sets_a)] @ dense[len(sets_a):].T
    return np.rint(total[p, q]).astype(np.int64)


def _compare(threshold: float, tolerance: float):
    def group(rows: list[dict]) -> pa.RecordBatch:
        first, second = rows[0]["i"], rows[0]["j"]
        nodes = {r["node"]: r for r in rows}
        left = [r for _, r in sorted(nodes.items()) if r["block"] == first]
        right = left if first == second else [r for _, r in sorted(nodes.items()) if r["block"] == second]
        names = [r["node"] for r in left] + ([] if right is left else [r["node"] for r in right])
        links, parent = np.zeros(len(names), dtype=np.int64), list(range(len(names)))
        if left and right:
            signs = [np.frombuffer(b"".join(r["minhash"] for r in side), dtype=np.uint32).reshape(-1, HASHES) for side in (left, right)]
            p, q = candidate_pairs(*signs, right is left, threshold, tolerance)
            sets = [[np.frombuffer(r["shingles"], dtype=np.uint64) for r in side] for side in (left, right)]
            n = [np.array([len(s) for s in side]) for side in sets]
            near = np.minimum(n[0][p], n[1][q]) >= threshold * np.maximum(n[0][p], n[1][q]) - 1e-9
            p, q = p[near], q[near]
            both = shared_shingles(*sets, p, q)
            good = both >= threshold * (n[0][p] + n[1][q] - both) - 1e-9
            p, q = p[good], q[good]
            size = [np.array([r["size"] for r in side]) for side in (left, right)]
            other = q if right is left else q + len(left)
            np.add.at(links, p, size[1][q])
            np.add.at(links, other, size[0][p])

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for a, b in zip(p.tolist(), other.tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
            roots = [names[find(i)] for i in range(len(names))]
        else:
            roots = names
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(links), pa.array(roots, pa.int64()), pa.array([rows[0]["blocks"] > 1] * len(names))],
                                          names=["node", "links", "least", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for row in batch.slice(at, BATCH_ROWS).to_pylist():
                    now = (row["root"], row["i"], row["j"])
                    if now != key and held:
                        yield group(held)
                        held = []
                    key = now
                    held.append(row)
        if held:
            yield group(held)
    return run


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, text_key.

    Two texts are linked if the sets of their runs of ``k`` words (outside 0x20 and
    0x09-0x0D, unchanged) have a Jaccard similarity of at least ``threshold``. n_links
    counts the other rows a row is linked with; class_id is the least id among the rows
    that links connect it with, itself included. A null text, or one with fewer than
    ``k`` words, has no runs and no links. Rows that repeat id and text are rows of
    their own. If no row of a class has an id, its class_id is null. An empty table
    gives no rows; columns beside the two named are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sketches = shared_table(source.mapInArrow(_sketch(k), SKETCH_SCHEMA))
    classes = shared_table(
        sketches.filter("s1 IS NOT NULL").groupBy("s1", "s2")
        .agg(F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "shingles", "minhash")).alias("at"))
        .select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "size", "at.doc_id", "at.text_key", "at.shingles", "at.minhash"))

    bands = classes.select("node", "minhash").mapInArrow(_bands, "band bigint, node bigint")
    buckets = bands.groupBy("band").agg(F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = shared_table(bands.join(buckets, "band"))
    codes = classes.select("node", "minhash").join(met.select("node").distinct(), "node", "left_semi").mapInArrow(_codes, "member bigint, code binary")
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        met.join(codes, F.col("node") == F.col("member")).withColumn("block", part)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "code")
    )
    members = components(
        dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node").mapInArrow(_bucket_edges(threshold, tolerance), "u bigint, v bigint"))

    weighed = members.join(classes.select("node", "size", "doc_id", "text_key", "shingles", "minhash"), "node")
    blocks = weighed.groupBy("root").agg(F.ceil(F.sum(1 + F.col("shingles") / WEIGHT_SHINGLES) / BLOCK_WEIGHT).cast("int").alias("blocks"))
    texts = weighed.join(blocks, "root").select(
        "root", "node", "size", "blocks", "minhash", F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
    # Only texts of a component are shuffled to their class.
    carried = source.filter(marked_by(marked_keys(weighed, "text_key"))(F.col("text_key")))
    groups = (
        carried.join(texts, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")))
        .select("text", "root", "node", "size", "blocks", "minhash")
        .mapInArrow(_shingles(k), "root bigint, node bigint, size bigint, blocks int, minhash binary, shingles binary")
        .withColumn("block", part)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "size", "blocks", "block", "minhash", "shingles")
    )
    found = shared_table(groups.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare(threshold, tolerance), FOUND_SCHEMA))

    split = components(found.filter("split AND node > least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("split"), F.col("least"))).alias("least"))
    known = links.join(split, "node", "left").select("node", "links", F.coalesce("root", "least", "node").alias("root"))
    named = classes.select("node", "s1", "s2", "size", F.col("doc_id").alias("least_id")).join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(roots, "root").select("s1", "s2", "size", "links", "class_id")
    rows = sketches.select("doc_id", "text_key", "s1", "s2").join(named, ["s1", "s2"], "left")
    return rows.select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("size") - 1 + F.coalesce(F.col("links"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"), "text_key")
