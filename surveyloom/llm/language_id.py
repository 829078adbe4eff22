"""Language of texts and of the spans of mixed-language texts.

A model holds, for each language, log probabilities of hashed letter trigrams and whole
words, and the scripts the language is written in. A text is cut into letter runs
(words). The script of a word narrows the languages it may be in, the trigrams score it,
and a Viterbi pass over the words, in which a change of language costs a fixed penalty,
labels each of them; runs of one label are the spans. All texts of a slice go through
the pass side by side, word by word.

The model has a fixed number of buckets per language, so its size is bounded whatever
the input; it is fitted on about ``SAMPLE_ROWS`` labelled rows, chosen by a hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from surveyloom.llm.common import id_remainder, rows_and_text, text_slices, texts_of
from surveyloom.llm.words import mix

BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
SWITCH_PENALTY = 8.0
SMOOTHING = 0.5

#: Bytes of text whose letters are counted at once.
LETTER_BYTES = 1_000_000

#: Bytes of text whose words go through the pass together, and of those whose letters are laid out at once.
PASS_BYTES, PASS_LETTER_BYTES = 1_000_000, 250_000

#: A script counts as one of a language from this share of its letters on.
SCRIPT_SHARE = 0.001

UNKNOWN = "und"

#: First and last code point of the scripts that are told apart (fixed values); letters elsewhere are script 1.
SCRIPT_RANGES = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x323AF),
)
SCRIPTS = ("none", "other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))

MODEL_SCHEMA = "lang string, kind string, bucket int, n bigint"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its script (0: no letter) and its lower case."""
    script = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x323B0):
        if unicodedata.category(chr(c))[0] in "LM":
            script[c] = 1
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    for name, a, b in SCRIPT_RANGES:
        script[a: b + 1] *= np.uint8(SCRIPTS.index(name))
    return script, lower


@dataclass
class Letters:
    """Letter runs of a slice of texts."""

    text: np.ndarray  # text of each word
    start: np.ndarray  # code point offsets within the text
    end: np.ndarray
    script: np.ndarray
    features: np.ndarray  # bucket of each letter's trigram
    cuts: np.ndarray  # first letter of each word, within features
    whole: np.ndarray  # bucket of each word

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.cuts, append=len(self.features))


def letters_of(texts: pa.Array) -> Letters:
    script_of, lower = _tables()
    values = ["" if t is None else t for t in texts.to_pylist()]
    lengths = np.array([len(v) + 1 for v in values], dtype=np.int64)
    points = np.frombuffer(("\n".join(values) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = script_of[points]
    inside = script > 0
    folded = np.where(inside, lower[points], 0).astype(np.uint64)
    before = np.concatenate([[0], folded[:-1]]).astype(np.uint64)
    after = np.concatenate([folded[1:], [0]]).astype(np.uint64)
    at = np.flatnonzero(inside)
    trigram = mix((before[at] << np.uint64(42)) ^ (folded[at] << np.uint64(21)) ^ after[at])
    first = np.flatnonzero(inside & (before == 0))
    last = np.flatnonzero(inside & (after == 0)) + 1
    cuts = np.searchsorted(at, first)
    whole = mix(np.add.reduceat(trigram, cuts)) if len(cuts) else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, first, side="right")
    offset = (ends - lengths)[text]
    return Letters(text, first - offset, last - offset, script[first], (trigram % np.uint64(BUCKETS)).astype(np.int64), cuts, (whole % np.uint64(BUCKETS)).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets and scripts per language, summed within a batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for row, texts in text_slices(batch.column(1), LETTER_BYTES):
            found = letters_of(texts)
            mine = langs[row: row + len(texts)]
            sizes = found.sizes
            for lang in dict.fromkeys(mine.tolist()):
                words = np.isin(found.text, np.flatnonzero(mine == lang))
                per = {
                    "trigram": np.bincount(found.features[np.repeat(words, sizes)], minlength=1),
                    "word": np.bincount(found.whole[words], minlength=1),
                    "script": np.bincount(found.script[words], weights=sizes[words], minlength=1).astype(np.int64),
                    "row": np.array([int((mine == lang).sum())]),
                }
                for kind, counts in per.items():
                    bucket = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array([kind] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket].astype(np.int64))],
                                                     names=["lang", "kind", "bucket", "n"])


@dataclass
class LanguageModel:
    """``scores[kind]``: (buckets, languages) log probabilities; ``scripts``: (scripts, languages) may be written in."""

    langs: list[str]
    trigram: np.ndarray
    word: np.ndarray
    scripts: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from labelled rows; rows with a null label or text are not used.

    From more than ``sample_rows`` rows each is taken with the same chance by a hash of
    its id, so that about so many are used.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if n > sample_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n) + 1)
    counts = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, MODEL_SCHEMA).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, bucket, times = (np.asarray(counts.column(c)) for c in ("lang", "kind", "bucket", "n"))
    langs = sorted(set(lang.tolist()))
    column = np.searchsorted(np.array(langs, dtype=object), lang) if langs else np.zeros(0, dtype=np.int64)

    def dense(name: str, size: int) -> np.ndarray:
        out = np.zeros((size, len(langs)))
        chosen = kind == name
        out[bucket[chosen], column[chosen]] = times[chosen]
        return out

    def log_share(c: np.ndarray) -> np.ndarray:
        return np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * len(c))).astype(np.float32)

    script = dense("script", len(SCRIPTS))
    return LanguageModel(langs, log_share(dense("trigram", BUCKETS)), log_share(dense("word", BUCKETS)), script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1), log_share(dense("row", 1).T).T[0] if langs else np.zeros(0))


def label_words(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """Most probable language of each word: words of text i are the next counts[i] rows of ``scores``."""
    langs = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    n = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    value = np.tile(prior.astype(np.float64), (len(counts), 1))
    came = np.zeros(scores.shape, dtype=np.uint16)
    own = np.arange(langs, dtype=np.uint16)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")
    for t in range(longest):
        v, at = value[: active[t]], first[: active[t]] + t
        if t:
            best = v.argmax(axis=1)
            moved = v[np.arange(len(v)), best][:, None] - penalty
            stay = v >= moved
            came[at] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, moved)
        value[: active[t]] = v + scores[at]
    label = np.zeros(len(scores), dtype=np.int64)
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        at = first[: active[t]] + t
        label[at] = now[: active[t]]
        if t:
            now[: active[t]] = came[at, now[: active[t]]]
    return label


@dataclass
class ScoredWords:
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    learned: np.ndarray  # whether some language of the model is written in the script


def _scored_words(texts: pa.Array, model: LanguageModel) -> tuple[ScoredWords, np.ndarray]:
    """Words of the texts and their scores, letters laid out part by part."""
    parts, scores = [], []
    for row, some in text_slices(texts, PASS_LETTER_BYTES):
        found = letters_of(some)
        parts.append((found.text + row, found.start, found.end, found.sizes, model.scripts[found.script].any(axis=1) if model.langs else np.zeros(len(found.text), dtype=bool)))
        if model.langs and len(found.text):
            allowed = model.scripts[found.script]
            allowed = allowed | ~allowed.any(axis=1, keepdims=True)
            sums = np.add.reduceat(model.trigram[found.features], found.cuts, axis=0) + model.word[found.whole]
            scores.append(np.where(allowed, sums, np.float32(-1e6)))
    return ScoredWords(*map(np.concatenate, zip(*parts))), np.concatenate(scores) if scores else np.zeros((0, len(model.langs)), dtype=np.float32)


def _predict(shared, penalty: float, text_col: str, keep_row: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        langs = len(model.langs)
        for batch in batches:
            for row, texts in text_slices(texts_of(batch.column(2), text_col), PASS_BYTES):
                found, scores = _scored_words(texts, model)
                counts = np.bincount(found.text, minlength=len(texts))
                preds, shares, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
                foreign = np.bincount(found.text, weights=found.letters * ~found.learned, minlength=len(texts)) / np.maximum(np.bincount(found.text, weights=found.letters, minlength=len(texts)), 1)
                if langs and len(found.text):
                    label = label_words(scores, counts, model.prior, penalty)
                    letters = np.bincount(found.text * langs + label, weights=found.letters, minlength=len(texts) * langs).reshape(-1, langs)
                    total = letters.sum(axis=1)
                    some = total > 0
                    best = letters.argmax(axis=1)
                    shares[some] = letters[some, best[some]] / total[some]
                    for i in np.flatnonzero(some):
                        preds[i] = model.langs[best[i]]
                    new = np.flatnonzero((np.diff(found.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                    close = np.append(new[1:], len(label)) - 1
                    for a, b in zip(new.tolist(), close.tolist()):
                        spans[found.text[a]].append({"start": int(found.start[a]), "end": int(found.end[b]), "lang": model.langs[label[a]]})
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(texts)), batch.column(1).slice(row, len(texts)), pa.array(preds, pa.string()), pa.array(shares),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))), pa.array(foreign, pa.float64()),
                    *([batch.column(2).slice(row, len(texts))] if keep_row else []),
                ], names=["doc_id", "held_out", "lang_pred", "score", "spans", "unlearned", *(["row"] if keep_row else [])])
    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep_row: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, spans, unlearned. No shuffle.

    ``lang_pred`` is the language with the most letters, the first by name of equal ones,
    ``score`` its share of all letters, ``spans`` the stretches of one language by code
    points, ``unlearned`` the share of letters in words of a script that no learned
    language is written in. A null text, or one without a letter, is ``und`` with score 0 and no spans, as
    is every text if the model has no language. ``held_out`` marks the rows that
    ``training_rows`` leaves out. Rows may repeat; an empty table gives no rows; other
    columns are not read, unless ``keep_row`` asks for the input row as a struct ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (id_remainder(id_col, 4) == 2).alias("held_out"), rows_and_text(docs, text_col, keep_row))
    schema = StructType([
        StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())]))), StructField("unlearned", DoubleType()),
        *(source.schema.fields[2:] if keep_row else []),
    ])
    return source.mapInArrow(_predict(shared, penalty, text_col, keep_row), schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(id_remainder(id_col, 4) != 2)
