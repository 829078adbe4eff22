"""Toxic passages by maximum-scoring segments of token log-odds.

Each token has a log-odds score from labelled texts under Dirichlet priors: the prior of
a word is the rate of its first five letters, theirs the rate of their first four, theirs
that of the corpus. A linear scan over the scores of a text finds all maximal scoring
segments. A segment's score is calibrated by an extreme-value law: of scores of clean
texts, the best of n tokens exceeds x with probability 1 - exp(-K n exp(-lambda x)). A
text's evidence is the surprise of its best segment and the sum over its significant
ones, mapped to a probability by a logistic curve fitted on labelled rows.

The model is a table of a fixed number of buckets, so its size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import id_remainder, shared_table, text_slices
from surveyloom.llm.language_id import _tables
from surveyloom.llm.words import mix

BUCKETS = 1 << 20
TRAIN_ROWS = 40_000
FIT_TASKS = 8
PREFIXES = (4, 5)

#: Strength of the prior, in texts, and what is taken off each token so that clean text scores below 0.
PRIOR_WEIGHT = 4.0
OFFSET = 0.3

#: Log-odds count by what is left after so many deviations; one token scores at most ``CAP``.
SURE = 1.5
CAP = 6.0
LEAST_COUNT = 0.5

#: Bytes of text whose letters are laid out at once.
SLICE = 1_000_000

SIGNIFICANT = 0.05

PART_SCHEMA = "grp int, kind int, bucket int, n bigint"
SEGMENT = "array<struct<start:int,end:int,score:double,p_value:double>>"


@dataclass
class Tokens:
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray  # (tokens, prefixes + 1) buckets: short prefix first, whole word last


def tokens_of(texts: pa.Array) -> Tokens:
    """Letter runs of the texts, lower case, by code points, with buckets of prefixes and word."""
    script_of, lower = _tables()
    values = ["" if t is None else t for t in texts.to_pylist()]
    lengths = np.array([len(v) + 1 for v in values], dtype=np.int64)
    points = np.frombuffer(("\n".join(values) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = script_of[points] > 0
    folded = np.where(inside, lower[points], 0).astype(np.uint64)
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = last - first
    keys = np.empty((len(first), len(PREFIXES) + 1), dtype=np.int64)
    value = np.zeros(len(first), dtype=np.uint64)
    at, level = 0, 0
    live = np.arange(len(first))
    while len(live):
        value[live] = mix(value[live] * np.uint64(0x9E3779B97F4A7C15) + folded[first[live] + at] + np.uint64(1))
        at += 1
        if level < len(PREFIXES) and at == PREFIXES[level]:
            keys[:, level] = (mix(value + np.uint64(level + 1)) % np.uint64(BUCKETS)).astype(np.int64)
            level += 1
        live = live[size[live] > at]
    for rest in range(level, len(PREFIXES)):
        keys[:, rest] = (mix(value + np.uint64(rest + 1)) % np.uint64(BUCKETS)).astype(np.int64)
    keys[:, -1] = (mix(value) % np.uint64(BUCKETS)).astype(np.int64)
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, first, side="right")
    offset = (ends - lengths)[text]
    return Tokens(text, first - offset, last - offset, keys)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each half and label that hold a bucket, per prefix length and for words; the last bucket counts texts.

    Summed over the whole task in arrays of a fixed size.
    """
    total = np.zeros((4, len(PREFIXES) + 1, BUCKETS + 1), dtype=np.int32)
    for batch in batches:
        groups = np.asarray(batch.column(0))
        for row, texts in text_slices(batch.column(1), SLICE):
            found = tokens_of(texts)
            mine = groups[row: row + len(texts)]
            for group in range(4):
                total[group, :, -1] += int((mine == group).sum())
                chosen = (mine == group)[found.text]
                for kind in range(found.keys.shape[1]):
                    pairs = np.unique(found.text[chosen] * np.int64(BUCKETS) + found.keys[chosen, kind])
                    bucket, n = np.unique(pairs % BUCKETS, return_counts=True)
                    total[group, kind, bucket] += n.astype(np.int32)
    for group in range(4):
        for kind in range(total.shape[1]):
            bucket = np.flatnonzero(total[group, kind])
            for low in range(0, len(bucket), 100_000):
                some = bucket[low: low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group, dtype=np.int32)), pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(total[group, kind, some].astype(np.int64))],
                                                 names=["grp", "kind", "bucket", "n"])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    A stack of candidate segments with the running sum before and after each: a new
    positive run joins back to the last candidate that began lower, unless that one also
    ended at least as high.
    """
    # Neighbours of one sign act as one element, which leaves the segments as they are.
    positive = scores > 0
    cuts = np.flatnonzero(np.diff(positive, prepend=~positive[:1]))
    sums = np.add.reduceat(scores, cuts) if len(cuts) else np.zeros(0)
    ends = np.append(cuts[1:], len(scores))
    total, stack = 0.0, []
    for a, b, s in zip(cuts.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        start, low, high = a, total, total + s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, b, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
        total += s
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class ToxicityModel:
    """``tables``: clean and toxic texts by (level, bucket); ``decay``, ``k``: the extreme-value law; ``weights``: the curve."""

    tables: list[np.ndarray]
    decay: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, -1.0)

    def token_scores(self, keys: np.ndarray) -> np.ndarray:
        odds, spread = _odds(*self.tables, keys)
        sure = np.sign(odds) * np.maximum(np.abs(odds) - SURE * spread, 0.0)
        return np.clip(sure, -1.0, CAP) - OFFSET


def _odds(clean: np.ndarray, toxic: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a text being toxic given the token, against the rate of the corpus, and their deviation.

    Each level is the prior of the next; column -1 of a table holds the number of texts.
    """
    base = (toxic[0, -1] + 0.5) / (toxic[0, -1] + clean[0, -1] + 1.0)
    a = np.full(len(keys), PRIOR_WEIGHT * base)
    b = PRIOR_WEIGHT - a
    for kind in range(keys.shape[1]):
        scale = PRIOR_WEIGHT / (a + b)
        a, b = a * scale + toxic[kind, keys[:, kind]], b * scale + clean[kind, keys[:, kind]]
    a, b = np.maximum(a, LEAST_COUNT), np.maximum(b, LEAST_COUNT)
    return np.log(a / b) - np.log(base / (1 - base)), np.sqrt(1 / a + 1 / b)


def evidence(model: ToxicityModel, texts: pa.Array):
    """Per text: features (logarithms of the best surprise, of the sum and the number of significant ones, and 1) and segments."""
    found = tokens_of(texts)
    scores = model.token_scores(found.keys)
    cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
    features, passages = np.zeros((len(texts), 4)), []
    features[:, 3] = 1.0
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        mine = segments(scores[a:b])
        kept = []
        if mine:
            value = np.array([s for _, _, s in mine])
            surprise = surprise_of(model, value, b - a)
            p = np.exp(-surprise)
            chosen = p < SIGNIFICANT
            features[i, :3] = np.log1p(surprise.max()), np.log1p(surprise[chosen].sum()), np.log1p(chosen.sum())
            kept = [(int(found.start[a + mine[j][0]]), int(found.end[a + mine[j][1] - 1]), float(value[j]), float(p[j])) for j in np.flatnonzero(chosen)]
        passages.append(kept)
    return features, passages


def surprise_of(model: ToxicityModel, value: np.ndarray, n: int) -> np.ndarray:
    """-log of the probability that clean text of n tokens has such a segment."""
    expected = np.exp(np.log(model.k * max(n, 1)) - model.decay * value)
    return -np.log(np.maximum(-np.expm1(-expected), 1e-300))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = p * (1 - p) + 1e-9
        penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
        step = np.linalg.solve((x * s[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_segments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, texts in text_slices(batch.column(1), SLICE):
                found = tokens_of(texts)
                scores = model.token_scores(found.keys)
                cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
                best = [max((s for _, _, s in segments(scores[a:b])), default=0.0) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(best, pa.float64()), pa.array(np.diff(cuts))], names=["label", "best", "n"])
    return run


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(1), SLICE):
                features, _ = evidence(shared.value, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *(pa.array(features[:, j]) for j in range(3))], names=["label", "f0", "f1", "f2"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from labelled rows, about ``train_rows`` of them by a hash of the id if there are more.

    Half of them give the log-odds, the other half the extreme-value law and the curve,
    so that these see tokens as new texts do. Null labels and ids are not used. The
    chosen ids, ``train_rows`` of them, are broadcast. Texts that are equal but for case
    and white space count once per label, as the row with the least id; near copies count each.
    """
    spark = docs.sparkSession
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.least(F.greatest(F.max(label_col).cast("int"), F.lit(0)), F.lit(1)).alias("label"))
    n = labelled.count()
    if n > train_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("l_id", F.lit("toxicity sample")), F.lit(1_000_000)) < int(1_000_000 * train_rows / n) + 1)
    half = F.pmod(F.xxhash64("l_id", F.lit("half")), F.lit(2)) == 0
    digest = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " "))), 256)
    texts = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = shared_table(
        texts.join(F.broadcast(labelled), texts["d_id"] == labelled["l_id"])
        .groupBy("label", digest.alias("digest")).agg(F.min(F.struct("l_id", "text")).alias("first")).select("first.l_id", "label", "first.text"))

    # The sample is bounded, and few tasks leave few sums.
    grouped = known.select((half.cast("int") * 2 + F.col("label")).alias("grp"), "text").coalesce(FIT_TASKS)
    counts = grouped.mapInArrow(_presence, PART_SCHEMA).groupBy("grp", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    texts_with = np.zeros((4, len(PREFIXES) + 1, BUCKETS + 1), dtype=np.float32)
    group, kind, bucket, n = (np.asarray(counts.column(c)) for c in ("grp", "kind", "bucket", "n"))
    texts_with[group, kind, bucket] = n

    model = ToxicityModel([texts_with[2], texts_with[3]])
    other = known.filter(~half).select("label", "text")
    best = other.mapInArrow(_best_segments(spark.sparkContext.broadcast(model)), "label int, best double, n bigint").toArrow()
    value, size, label = (np.asarray(best.column(c)) for c in ("best", "n", "label"))
    clean = label == 0
    if clean.sum() >= 20:
        model.decay, model.k = gumbel_fit(value[clean], np.maximum(size[clean], 1))
    rows = other.mapInArrow(_features(spark.sparkContext.broadcast(model)), "label int, f0 double, f1 double, f2 double").toArrow()
    x = np.column_stack([*(np.asarray(rows.column(c)) for c in ("f0", "f1", "f2")), np.ones(rows.num_rows)])
    if rows.num_rows:
        model.weights = tuple(_logistic(x, np.asarray(rows.column("label"), dtype=np.float64)).tolist())
    model.tables = [texts_with[0] + texts_with[2], texts_with[1] + texts_with[3]]
    return model


def gumbel_fit(value: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of best scores from two quantiles, which a few odd texts don't move.

    score - log(n) / lambda has a Gumbel law.
    """
    decay = 1.0
    for _ in range(30):
        middle, high = np.quantile(value - np.log(n) / decay, [0.5, 0.9])
        decay = float(np.clip((np.log(np.log(2)) - np.log(-np.log(0.9))) / max(high - middle, 1e-3), 0.05, 20.0))
    mode = np.quantile(value - np.log(n) / decay, 0.5) + np.log(np.log(2)) / decay
    return decay, float(np.exp(decay * mode))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = np.array(model.weights)
        for batch in batches:
            for row, texts in text_slices(batch.column(2), SLICE):
                features, passages = evidence(model, texts)
                score = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), batch.column(1).slice(row, len(texts)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                    pa.array([[dict(zip(("start", "end", "score", "p_value"), s)) for s in p] for p in passages],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))),
                ], names=["doc_id", "held_out", "score", "predicted", "passages"])
    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, passages. No shuffle.

    ``passages``: the significant segments by code points with score and p-value. A null
    text counts as empty; an empty text has no segment and the score of the curve at
    none. ``held_out`` marks the rows that ``training_rows`` leaves out. Rows may repeat;
    an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (id_remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(_score(shared), f"doc_id bigint, held_out boolean, score double, predicted int, passages {SEGMENT}")


def training_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.filter(id_remainder(id_col, 5) != 0)
