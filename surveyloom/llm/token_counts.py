"""Token counts by a whole-token shortcut.

A SentencePiece BPE model without a piece that has a word mark after another character
never merges across the start of a word, so a text is counted word by word. Which strings
are one token when they stand alone is proved once per worker by encoding every string of
the vocabulary; such words are counted by a look-up, only the rest is merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

MARK = "▁"

#: Merged words remembered by a worker before it starts over; bounds memory, not results.
REMEMBERED = 300_000

_RUN = re.compile(" +[^ ]*")


class CrossingPiece(ValueError):
    """The vocabulary could merge across the start of a word."""


class PieceCounter:
    """Counts of whole texts, equal to the library's."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)]
        if inner:
            raise CrossingPiece(f"pieces such as {inner[0]!r} cross the start of a word")
        # A word is looked up without the space before it, which the library adds itself.
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        alone = self.model.encode(words, num_threads=1)
        self.whole = frozenset(w for w, ids in zip(words, alone) if len(ids) == 1)
        # A lone space at the end of a text is a word of nothing but the mark.
        self.lone_mark = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.merged: dict[str, int] = {"": self.lone_mark}

    def words(self, text: str) -> list[str]:
        """Words of a text, each without one space before it."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text.startswith(" ") or text.endswith(" "):
            return [run[1:] for run in _RUN.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = self.words(text)
        rest = [w for w in words if w not in self.whole]
        merged = self.merged
        unknown = list({w for w in rest if w not in merged})
        if unknown:
            if len(merged) > REMEMBERED:
                merged.clear()
                merged[""] = self.lone_mark
                unknown = list({w for w in rest if w})
            merged.update(zip(unknown, map(len, self.model.encode(unknown, num_threads=1))))
        return len(words) - len(rest) + sum(map(merged.__getitem__, rest))


@lru_cache(maxsize=1)
def piece_counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def _count(model_path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. No shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are
    ordinary text, as the library takes them. Rows may repeat; an empty table gives no
    rows; other columns are not read.
    """
    from surveyloom.llm.tokens import tokenizer_path

    path = model_path or tokenizer_path("piece_bpe_32k.model")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_count(path, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
