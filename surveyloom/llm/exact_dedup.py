"""Exact deduplication by exchange of Golomb-coded fingerprints.

Senders are blocks of rows of one input partition. A block keeps its digests and sends
each owner (a range of fingerprints) its distinct fingerprints, sorted and Golomb-Rice
coded. Owners send back one bit for each fingerprint: seen in another block or not.
Only rows with such a bit, or with a twin in their own block, are suspects. Their
fingerprints are marked in a bitmap of a fixed size that every task gets; a text whose
mark is not set stays where it is, the others are shuffled, met with the exact list of
suspects and grouped by their bytes, equal texts of one batch counted before. Everything
else travels as digests.

Sizes: a block holds at most ``BLOCK_ROWS`` rows, an owner about (distinct
fingerprints of all blocks / owners). A group of copies, however large, is one
fingerprint per block in the exchange, one row per batch in the verification, one
row per task in the choice of the row that stays, and one row per block when it is told to
its members.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import shared_table, text_key, text_slices

BLOCK_ROWS = 16_384

#: Bits of the bitmap of suspect fingerprints. It spares shuffling, and decides nothing.
BITS = 1 << 27

_DELETE = b" \t\n\x0b\x0c\r"

BLOCK_SCHEMA = "sender string, doc_id array<bigint>, text_key array<bigint>, digests binary, code_points array<bigint>, sent array<struct<owner:int,code:binary>>"
ROW_SCHEMA = "sender string, place int, doc_id bigint, text_key bigint, digest binary, fingerprint bigint, code_points bigint, suspect boolean"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit values as gaps: quotients in unary, remainders in a fixed number of bits.

    The number of remainder bits follows the mean gap, which is Golomb's choice for
    uniform values restricted to powers of two.
    """
    n = len(values)
    if n == 0:
        return struct.pack("<IBQ", 0, 0, 0)
    gaps = np.diff(values, prepend=values[:1])
    mean = int(values[-1] - values[0]) // n
    bits = max(mean.bit_length() - 1, 0)
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IBQ", n, bits, int(values[0])) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    n, bits, low = struct.unpack_from("<IBQ", code)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    body = np.frombuffer(code, dtype=np.uint8, offset=13)
    tail = (n * bits + 7) // 8
    unary = np.unpackbits(body[: len(body) - tail])
    ends = np.flatnonzero(unary)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    if bits:
        rest = np.unpackbits(body[len(body) - tail:])[: n * bits].reshape(n, bits).astype(np.uint64)
        gaps |= (rest << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps[0] = np.uint64(low)
    return np.cumsum(gaps, dtype=np.uint64)


def owner_width(owners: int) -> int:
    """Size of an owner's range of 64-bit values."""
    return min(((1 << 64) - 1) // owners + 1, (1 << 64) - 1)


def _normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def _fingerprints(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype=">u8").reshape(-1, 4)[:, 0].astype(np.uint64)


def _send(owners: int):
    width = owner_width(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, keys, digests, points = [], [], [], []

        def block() -> pa.RecordBatch:
            nonlocal number
            values = np.unique(_fingerprints(b"".join(digests)))
            owner = (values // np.uint64(width)).astype(np.int64)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sent = [{"owner": int(owner[a]), "code": rice_encode(values[a:b])} for a, b in zip(starts, [*starts[1:], len(values)])]
            sender = f"{part}-{number}"
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([sender]), pa.array([ids], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.int64())),
                pa.array([b"".join(digests)], pa.binary()), pa.array([points], pa.list_(pa.int64())),
                pa.array([sent], pa.list_(pa.struct([("owner", pa.int32()), ("code", pa.binary())]))),
            ], names=["sender", "doc_id", "text_key", "digests", "code_points", "sent"])

        for batch in batches:
            for text, doc, key, n in zip(batch.column(2), batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.utf8_length(batch.column(2)).to_pylist()):
                ids.append(doc)
                keys.append(key)
                digests.append(hashlib.sha256(_normalised(text.as_py())).digest())
                points.append(n or 0)
                if len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, keys, digests, points = [], [], [], []
        if ids:
            yield block()
    return run


def _own(table: pa.Table) -> pa.Table:
    """All codes of one owner -> for each sender a bitmap of fingerprints that another sender has too."""
    senders = table.column("sender").to_pylist()
    values = [rice_decode(code) for code in table.column("code").to_pylist()]
    seen, times = np.unique(np.concatenate(values), return_counts=True)
    twice = seen[times > 1]
    bitmaps = []
    for v in values:
        at = np.searchsorted(twice, v)
        hit = np.zeros(len(v), dtype=bool)
        inside = at < len(twice)
        hit[inside] = twice[at[inside]] == v[inside]
        bitmaps.append(np.packbits(hit).tobytes())
    return pa.table({"sender": pa.array(senders, pa.string()), "owner": table.column("owner").combine_chunks().cast(pa.int32()), "bitmap": pa.array(bitmaps, pa.binary())})


def _mark(owners: int):
    width = owner_width(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                prints = _fingerprints(row["digests"])
                values, place, times = np.unique(prints, return_inverse=True, return_counts=True)
                hit = times > 1
                bounds = np.searchsorted((values // np.uint64(width)).astype(np.int64), np.arange(owners + 1))
                for reply in row["replies"]:
                    a, b = bounds[reply["owner"]], bounds[reply["owner"] + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(reply["bitmap"], dtype=np.uint8))[: b - a].astype(bool)
                n = len(prints)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["sender"]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(row["doc_id"], pa.int64()), pa.array(row["text_key"], pa.int64()),
                    pa.array([row["digests"][i * 32: i * 32 + 32] for i in range(n)], pa.binary()),
                    pa.array(prints.view(np.int64)), pa.array(row["code_points"], pa.int64()), pa.array(hit[place]),
                ], names=["sender", "place", "doc_id", "text_key", "digest", "fingerprint", "code_points", "suspect"])
    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the bitmap with the bits of a batch of fingerprints."""
    for batch in batches:
        bit = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(BITS - 1))
        if len(bit):
            cell = (bit >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first).view(np.int64))], names=["cell", "bits"])


def _copies(shared):
    """Normalised texts whose fingerprint is marked, equal ones of a batch counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                counted: dict[bytes, int] = {}
                for text in part.to_pylist():
                    norm = _normalised(text)
                    counted[norm] = counted.get(norm, 0) + 1
                texts = list(counted)
                digests = [hashlib.sha256(norm).digest() for norm in texts]
                prints = _fingerprints(b"".join(digests))
                bit = prints & np.uint64(BITS - 1)
                at = np.flatnonzero((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints[at].view(np.int64)), pa.array([digests[i] for i in at], pa.binary()),
                    pa.array([texts[i] for i in at], pa.binary()), pa.array([counted[texts[i]] for i in at], pa.int64()),
                ], names=["fingerprint", "digest", "bytes", "rows"])
    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal if they are identical without the bytes 0x20 and 0x09-0x0D; a null
    text counts as empty. Of equal texts the row with the most code points in the
    original stays, then the smallest id (null ids last), then an arbitrary one of rows
    that repeat id and text. ``owners``: fingerprint ranges, by default the number of
    shuffle partitions. An empty table gives no rows. Columns beside the two named are
    not read.

    Two different texts with one SHA-256 digest, if ever met, end the job with an error.
    """
    spark = docs.sparkSession
    owners = max(owners or int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    blocks = shared_table(source.mapInArrow(_send(owners), BLOCK_SCHEMA))

    replies = (
        blocks.select("sender", F.inline("sent")).groupBy("owner")
        .applyInArrow(_own, "sender string, owner int, bitmap binary")
        .groupBy("sender").agg(F.collect_list(F.struct("owner", "bitmap")).alias("replies"))
    )
    rows = shared_table(blocks.drop("sent").join(replies, "sender").mapInArrow(_mark(owners), ROW_SCHEMA))

    suspects = rows.filter("suspect")
    prints = suspects.select("fingerprint").distinct()
    marks = suspects.select("fingerprint").mapInArrow(_marked, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    bitmap[marks.column("cell").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)
    verified = (
        source.select("text").mapInArrow(_copies(shared), "fingerprint bigint, digest binary, bytes binary, rows bigint")
        .join(prints.hint("shuffle_hash"), "fingerprint", "left_semi")
        .groupBy("fingerprint", "digest", "bytes").agg(F.sum("rows").alias("rows"))
        .groupBy("digest").agg(F.sum("rows").alias("verified_rows"), F.count("*").alias("texts"))
    )
    groups = (
        suspects.groupBy("digest").agg(
            F.count("*").alias("group_size"),
            F.min(F.struct((-F.col("code_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "sender", "place")).alias("best"))
        .join(verified, "digest")
        .withColumn("group_size", F.when((F.col("texts") == 1) & (F.col("verified_rows") == F.col("group_size")), F.col("group_size"))
                    .otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("bigint")))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.sender").alias("keep_sender"), F.col("best.place").alias("keep_place"))
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "text_key"]
    single = rows.filter("NOT suspect").select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")).select(*columns)
    # A block meets the groups once per digest and tells its own rows.
    members = suspects.groupBy("sender", "digest").agg(F.collect_list(F.struct("place", "doc_id", "text_key")).alias("rows"))
    told = members.join(groups, "digest").select("sender", "digest", "group_size", "keep_id", "keep_sender", "keep_place", F.inline("rows"))
    several = told.withColumn("kept", (F.col("sender") == F.col("keep_sender")) & (F.col("place") == F.col("keep_place"))).select(*columns)
    return single.unionByName(several)
