"""Quality rules: statistics of whole texts and a decision list learned from labels.

The statistics are computed in one pass over the words of a text. A list of rules is
learned by sequential covering: a rule is a conjunction of thresholds, grown on two
thirds of the labelled rows by information gain and pruned on the rest; the rows it
covers are set aside, until a rule is no better than guessing. The list becomes one
ordered conditional expression of Spark, so judging documents needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.common import text_slices
from surveyloom.llm.words import ROLLER_A, buffer_of, hash_words, split_words, window_starts

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Labelled rows used for learning, at most about so many, chosen by a hash of the id.
TRAIN_ROWS = 50_000
MAX_RULES = 12
MAX_CONDITIONS = 5
CUTS = 64

#: A rule must be right for this share of the pruning rows it covers, and cover so many.
LEAST_PRECISION = 0.6
LEAST_COVER = 5

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_NEWLINE = 0x0A

STATS_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_upper bigint, n_distinct_words bigint"
)

#: What a rule may look at: names of the shares below.
FEATURES = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols_per_word": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "upper_share": lambda c: c("n_upper") / F.greatest(c("word_chars"), F.lit(1)),
    "distinct_share": lambda c: c("n_distinct_words") / F.greatest(c("n_words"), F.lit(1)),
    "words_per_line": lambda c: c("n_words") / F.greatest(c("n_lines"), F.lit(1)),
}


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text; see ``document_statistics``."""
    data, offsets = buffer_of(texts)
    words = split_words(texts)
    n = words.counts()

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def per_words(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[words.first[1:]] - total[words.first[:-1]]

    starts_point = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(starts_point, dtype=np.int64)])
    hashes = hash_words(words)

    # Words in windows that are found twice or more in their text.
    prefix = ROLLER_A.prefix(hashes)
    at, text = window_starts(n, words.first, REPEAT_WINDOW)
    repeated = _repeated(text, ROLLER_A.span(prefix, at, at + REPEAT_WINDOW))
    marks = np.zeros(len(hashes) + 1, dtype=np.int64)
    marks[at[repeated]] += 1
    np.subtract.at(marks, at[repeated] + REPEAT_WINDOW, 1)
    in_repeat = np.cumsum(marks[:-1]) > 0

    # Lines: the text cut at \n; equal lines are equal bytes.
    breaks = np.flatnonzero(data == _NEWLINE)
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(offsets, line_start, side="right") - 1
    next_start = np.append(line_start[1:], len(data))
    line_end = np.where(np.isin(next_start - 1, breaks), next_start - 1, next_start)
    line_end = np.minimum(line_end, offsets[line_text + 1])
    first_word, last_word = np.searchsorted(words.start, line_start), np.searchsorted(words.start, line_end)
    with_word = last_word > first_word
    values = _span_hash(data, line_start[with_word], line_end[with_word])
    order = np.lexsort((values, line_text[with_word]))
    v, t = values[order], line_text[with_word][order]
    again = np.zeros(len(v), dtype=bool)
    again[1:] = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    dup_lines = np.bincount(t[again], minlength=len(texts))

    order = np.lexsort((hashes, words.text_of()))
    h, t = hashes[order], words.text_of()[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return {
        "n_words": n, "word_chars": per_words(points[words.end] - points[words.start]), "n_symbols": per_text(_SYMBOLS[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": per_words(in_repeat), "n_lines": per_text(data == _NEWLINE) + 1,
        "n_upper": per_text(_UPPER[data]), "n_distinct_words": np.bincount(t[fresh], minlength=len(texts)),
    }


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    from surveyloom.llm.words import Words

    return hash_words(Words(data, start, end, np.array([0, len(start)])), 7)


def _repeated(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries have an equal value in the same text."""
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    same = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    hit = np.zeros(len(v), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(v), dtype=bool)
    out[order] = hit
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in text_slices(batch.column(1)):
            stats = text_statistics(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *(pa.array(v, pa.int64()) for v in stats.values())], names=["doc_id", *stats])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per row; words are runs outside 0x20 and 0x09-0x0D, a null text has none.

    word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``;
    n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in
    8-word windows found twice or more in the text. Rows may repeat; an empty table
    gives no rows; other columns are not read. No shuffle.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, STATS_SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.cut if self.above else values <= self.cut

    def column(self) -> Column:
        c = FEATURES[self.feature](F.col)
        return c >= F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.cut:.6g}"


def _covered(rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition of the largest gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int(inside.sum())
        base = np.log2(max(p0, 0.5) / n0)
        best, gain = None, 1e-9
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS + 1), method="nearest"))
            order = np.sort(values[inside])
            hits = np.sort(values[inside & bad])
            for above in (True, False):
                if above:
                    n, p = len(order) - np.searchsorted(order, cuts, "left"), len(hits) - np.searchsorted(hits, cuts, "left")
                else:
                    n, p = np.searchsorted(order, cuts, "right"), np.searchsorted(hits, cuts, "right")
                g = np.where(p > 0, p * (np.log2(np.maximum(p, 0.5) / np.maximum(n, 1)) - base), 0.0)
                i = int(g.argmax())
                if g[i] > gain:
                    best, gain = Condition(name, above, float(cuts[i])), float(g[i])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x[best.feature])
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the rule with the best (hits - misses) / covered."""
    def worth(r) -> float:
        inside = _covered(r, x, len(bad))
        n = int(inside.sum())
        return (2 * int(bad[inside].sum()) - n) / n if n else -1.0
    return max((rule[:i] for i in range(len(rule), 0, -1)), key=worth)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, prune_part: np.ndarray) -> list[list[Condition]]:
    """Ordered conjunctions that mark bad rows; ``prune_part`` marks the rows kept for pruning."""
    rules, open_rows = [], np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        grow, prune = open_rows & ~prune_part, open_rows & prune_part
        if bad[grow].sum() < LEAST_COVER:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        hit = _covered(rule, x, len(bad)) & prune
        if hit.sum() < LEAST_COVER or bad[hit].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        open_rows &= ~_covered(rule, x, len(bad))
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Rules from the statistics of labelled rows (label 0: bad).

    From more than ``train_rows`` labels each is taken with the same chance by a hash of
    its id; so many ids at most are broadcast, and their numbers reach the driver. A
    document without a label, or with a null one, is not used.
    """
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).alias("label"))
    n = labelled.count()
    if n > train_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("l_id", F.lit("quality sample")), F.lit(1_000_000)) < int(1_000_000 * train_rows / n) + 1)
    known = stats.join(F.broadcast(labelled), F.col("doc_id") == F.col("l_id")).select(
        F.col("label").cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"), F.col("doc_id"),
        *(f(F.col).alias(name) for name, f in FEATURES.items())).toArrow().sort_by("doc_id")
    x = {name: np.asarray(known.column(name), dtype=np.float64) for name in FEATURES}
    return learn_rules(x, np.asarray(known.column("label")) == 0, np.asarray(known.column("prune")))


def rules_column(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none."""
    chain: Column | None = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        chain = F.when(holds, F.lit(i)) if chain is None else chain.when(holds, F.lit(i))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def judge(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """One row per row of statistics: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated windows;
    ``kept``: not that, and no rule of the list holds (``rule`` 0). No shuffle, no Python.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rules_column(rules).alias("rule"),
    ).select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
