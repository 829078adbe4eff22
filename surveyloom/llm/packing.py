"""Best-fit packing of tokenised documents into sequences, by rounds over residual bins.

Round 0 runs where the text is: a task tokenises its rows, cuts long documents, and packs
what it has by best fit in decreasing length. Bins that are nearly full are final; the
others become items of the next round, dealt to groups of about ``GROUP_ITEMS`` bins, each of
which is packed again. From then on only bins that are half full at most can be joined with
one another, and best fit leaves one of these in a group at most, so a round makes them
fewer by about that factor; rounds go on to the root of the tree, where a single one is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import shared_table
from surveyloom.llm.tokens import byte_bpe

CAPACITY = 1024
END_OF_DOCUMENT = 2
LOCAL_ITEMS = 50_000
GROUP_ITEMS = 20_000

#: A bin with so few free tokens is final.
NEARLY_FULL = 8

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN_SCHEMA = "bin bigint, part bigint, fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the open bin that it fills best.

    Bins with the same room stand in one stack; a bit mask of the rooms in use gives the
    smallest that is large enough. Ties go to the earlier index.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be shorter."""
    at = 0
    if n % capacity:
        yield 0, n % capacity
        at = n % capacity
    while at < n:
        yield at, capacity
        at += capacity


def _bins(ids, part, fills, members) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(fills, pa.int32()), pa.array(members, pa.list_(_MEMBER))],
                                      names=["bin", "part", "fill", "members"])


def _tokenise_and_pack(capacity: int, paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(*paths)
        part = TaskContext.get().partitionId()
        number = part << 40
        items: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            bins = best_fit([i[3] for i in items], capacity)
            ids = range(number, number + len(bins))
            number += len(bins)
            return _bins(ids, part, [sum(items[i][3] for i in b) for b in bins], [[items[i] for i in b] for b in bins])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([END_OF_DOCUMENT], dtype="<u4")).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    items.append((doc, piece, start, length, zlib.crc32(ids[start: start + length].tobytes())))
            if len(items) >= LOCAL_ITEMS:
                yield packed()
                items = []
        if items:
            yield packed()
    return run


def _merge(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bin", "fill", "members"]).to_pylist()
        rows.sort(key=lambda r: r["bin"])
        bins = best_fit([r["fill"] for r in rows], capacity)
        return pa.Table.from_batches([_bins(
            [min(rows[i]["bin"] for i in b) for b in bins], table.column("part")[0].as_py(), [sum(rows[i]["fill"] for i in b) for b in bins],
            [[m for i in b for m in rows[i]["members"]] for b in bins])])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id, so an empty or null text is one token. Only
    documents longer than ``capacity`` are cut; all pieces but the first are then full.
    Rows that repeat an id are packed like other rows. Offsets in a sequence are gapless
    from 0. An empty table gives no rows; other columns are not read.
    """
    from surveyloom.llm.tokens import tokenizer_path

    paths = (json_path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    bins = shared_table(source.mapInArrow(_tokenise_and_pack(capacity, paths), BIN_SCHEMA))
    full = F.col("fill") >= capacity - NEARLY_FULL
    done, open_bins = [bins.filter(full)], bins.filter(~full)
    while (n := open_bins.count()) > 1:
        groups = -(-n // GROUP_ITEMS)
        part = F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("bigint")
        merged = shared_table(open_bins.withColumn("part", part).groupBy("part").applyInArrow(_merge(capacity), BIN_SCHEMA))
        # Two bins that are more than half full never fit into one.
        small = F.col("fill") <= capacity // 2
        done.append(merged.filter(~small))
        open_bins = merged.filter(small)
        if groups == 1:
            break
    done.append(open_bins)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    before = F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (s, m) -> s + m.length))")
    return (
        rows.select("bin", F.inline(F.arrays_zip(F.col("members").alias("m"), before.alias("offset"))))
        .select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    )
