"""Helpers the operators share: shared tables, batches of bounded size, defined orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveyloom.session import cut_lineage

#: Bytes of text handled at once inside a task; one longer text is handled alone.
SLICE_BYTES = 4_000_000

#: Bytes of text whose words are laid out as arrays at once; these take some twenty times as much.
WORD_BYTES = 1_000_000

#: Rows of an Arrow batch that are made Python values at once.
BATCH_ROWS = 2_000


#: Spark's own setting that removes a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, read back.

    Later steps need no executor that made it, so its shuffle files are given free.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        spark.conf.set(_CLEANUP, before)


#: Bits of a bitmap of text keys, 16 MB. It spares shuffling, and decides nothing.
KEY_BITS = 1 << 27


def _key_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(KEY_BITS - 1))
        cell, first = np.unique(bit >> np.uint64(6), return_index=True)
        if len(cell):
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(bits.view(np.int64))], names=["cell", "bits"])


def marked_keys(keys: DataFrame, key: str) -> Broadcast:
    """Values of the bigint column ``key``, marked in a bitmap of a fixed size that every task gets."""
    found = keys.select(key).mapInArrow(_key_cells, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(KEY_BITS // 64, dtype=np.uint64)
    bitmap[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def is_marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for each value that is marked, and for few others."""
    bit = values.view(np.uint64) & np.uint64(KEY_BITS - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def marked_by(shared: Broadcast) -> Callable[[Column], Column]:
    """``is_marked`` for a column.

    Rows that have no partner need not be shuffled to a join with the keys, which stays
    exact. Where a step in Python follows in the same task, the test belongs into that step, as
    each of the two would hold a Python worker.
    """
    @F.arrow_udf("boolean")
    def marked(values: pa.Array) -> pa.Array:
        return pa.array(is_marked(shared.value, values.to_numpy()))

    return marked


def rows_and_text(docs: DataFrame, text_col: str, keep_row: bool) -> Column:
    """What a task gets of a row: its text, or with ``keep_row`` the row itself as ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_row else F.col(text_col).alias("text")


def texts_of(column: pa.Array, text_col: str) -> pa.Array:
    """The texts of a column made by ``rows_and_text``."""
    return column.field(text_col).cast(pa.string()) if pa.types.is_struct(column.type) else column


def text_key(c: str = "text") -> Column:
    """64 bits of a text; a null text counts as empty. With the id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(c), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text key) is in ``decisions`` with ``kept`` true, one for each kept decision.

    ``decisions`` has a row (id_col, text_key, kept) for each row of ``docs``. Rows that
    repeat both id and text are told apart by nothing, so of such rows one stays.
    """
    key, rid = free_name(docs, "__text_key"), "__kept_id"
    marked = decisions.groupBy(F.col(id_col).alias(rid), F.col("text_key").alias("__kept_key")).agg(
        F.count("*").alias("__all"), F.sum(F.col("kept").cast("int")).alias("__rows"))
    single = marked.filter("__rows = __all").select(rid, "__kept_key")
    repeated = marked.filter("__rows > 0 AND __rows < __all").select(rid, "__kept_key")
    with_key = docs.withColumn(key, text_key(text_col))
    same = lambda right: F.col(id_col).eqNullSafe(right[rid]) & (F.col(key) == right["__kept_key"])
    whole = with_key.join(single, same(single), "left_semi").drop(key)
    if repeated.isEmpty():
        return whole
    parts = with_key.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, key]).drop(key)
    return whole.unionByName(parts)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) with at most ``limit`` bytes of text, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, column.slice(first, last - first)
        first = last


def batch_rows(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def nulls_last(c: str) -> list[Column]:
    """Sort keys that put the smallest value first and nulls at the end."""
    return [F.col(c).isNull(), F.col(c)]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def id_remainder(c: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)
