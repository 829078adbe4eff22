"""Removal of long passages that occur more than once, over a compacted De Bruijn graph.

An edge is a window of ``k`` words, its ends the k - 1 words it shares with the windows
before and after. Edges are dealt out by their minimizer, the least hash of the short
word runs inside (as in parallel compaction of genome graphs), so equal edges meet
wherever they stand. Neighbouring edges with one minimizer form a path without branches,
which is one item, identified by the hash of its words, until a branch is found:

1. Each block of texts sends, for every minimizer, one coded entry to the owner of its
   hash range: the path's hash, or the sign that the path branches inside the block (or may
   meet itself, in periodic text).
   The owner answers: alone, one path everywhere, or branching.
2. Paths that stand alone are done. A path that is the same at all its coordinates is
   repeated whole. Both never become edges.
3. Of every branching path one source coordinate is fetched, its edges are laid out and
   counted over all coordinates; a join takes the repeated ones back to the path.
4. The repeated edges of a text, from whole and branching paths, say which words go.

An entry per (block, minimizer) and partial sums keep frequent passages small. Edges are
compared by 128 bits, paths by 96 bits and their minimizer's 64.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from surveyloom.llm.common import WORD_BYTES, is_marked, marked_by, marked_keys, rows_and_text, shared_table, text_key, text_slices, texts_of
from surveyloom.llm.exact_dedup import owner_width, rice_decode, rice_encode
from surveyloom.llm.words import ROLLER_A, ROLLER_B, Words, hash_words, split_words, window_starts

WINDOW = 35
SEED_WORDS = 8

_ALONE, _WHOLE, _BRANCH = 0, 1, 2

BLOCK_SCHEMA = (
    "sender string, doc_id array<bigint>, text_key array<bigint>, path_text binary, start binary, edges binary, "
    "minimizer binary, c1 binary, c2 binary, sent array<struct<owner:int,code:binary>>"
)
PATH_SCHEMA = "doc_id bigint, text_key bigint, start int, edges int, c1 bigint, c2 int, branch boolean"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def paths_of(words: Words, k: int, seed: int):
    """(text, first edge as word, edges, minimizer, hash, second hash, own branch) of each path.

    A path that holds its minimizer more than once may pass an edge twice: its own branch.
    """
    hashes = hash_words(words)
    prefix = ROLLER_A.prefix(hashes)
    at = np.arange(max(len(hashes) - seed + 1, 0))
    runs = ROLLER_A.span(prefix, at, at + seed)
    least = sliding_min(runs, k - seed + 1)
    edge, text = window_starts(words.counts(), words.first, k)
    value = least[edge]
    new = np.ones(len(edge), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(begin, append=len(edge))
    first, last = edge[begin], edge[begin] + n + k - 1
    c1 = ROLLER_A.span(prefix, first, last)
    c2 = ROLLER_B.span(ROLLER_B.prefix(hash_words(words, 1)), first, last).astype(np.uint32)
    inside = n + k - seed
    begins = np.cumsum(inside) - inside
    same = runs[np.arange(int(inside.sum())) + np.repeat(first - begins, inside)] == np.repeat(value[begin], inside)
    twice = np.add.reduceat(same, begins, dtype=np.int64) > 1 if len(begins) else np.zeros(0, dtype=bool)
    return text[begin], first - words.first[text[begin]], n, value[begin], c1, c2, twice


def _paths_by_parts(texts: pa.Array, k: int, seed: int) -> Iterator[tuple]:
    """``paths_of`` the texts, words laid out part by part."""
    for row, some in text_slices(texts, WORD_BYTES):
        text, *rest = paths_of(split_words(some), k, seed)
        yield text + row, *rest


def _block_paths(k: int, seed: int, owners: int):
    width = owner_width(owners)

    def entries(minimizer, c1, c2, twice) -> list[dict]:
        order = np.lexsort((c2, c1, minimizer))
        m, a, b = minimizer[order], c1[order], c2[order]
        starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        ends = np.append(starts[1:], len(m))
        own = np.maximum.reduceat(twice[order], starts)
        state = np.where(own | (a[starts] != a[ends - 1]) | (b[starts] != b[ends - 1]), _BRANCH, np.where(ends - starts > 1, _WHOLE, _ALONE)).astype(np.uint8)
        m, a, b = m[starts], a[starts], b[starts]
        owner = (m // np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for i, j in zip(cuts, [*cuts[1:], len(m)]):
            code = rice_encode(m[i:j])
            out.append({"owner": int(owner[i]), "code": struct.pack("<II", j - i, len(code)) + code + a[i:j].tobytes() + b[i:j].tobytes() + state[i:j].tobytes()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, texts in text_slices(batch.column(2)):
                text, start, n, minimizer, c1, c2, twice = map(np.concatenate, zip(*_paths_by_parts(texts, k, seed)))
                if not len(text):
                    continue
                used, place = np.unique(text, return_inverse=True)
                take = pa.array(used + row)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{part}-{number}"]),
                    pa.array([batch.column(0).take(take).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(1).take(take).to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (place.astype(np.uint32), start.astype(np.uint32), n.astype(np.uint32), minimizer, c1, c2)),
                    pa.array([entries(minimizer, c1, c2, twice)], pa.list_(pa.struct([("owner", pa.int32()), ("code", pa.binary())]))),
                ], names=["sender", "doc_id", "text_key", "path_text", "start", "edges", "minimizer", "c1", "c2", "sent"])
                number += 1
    return run


def _decode(code: bytes):
    n, size = struct.unpack_from("<II", code)
    at = 8 + size
    return (rice_decode(code[8:at]), np.frombuffer(code, "<u8", n, at), np.frombuffer(code, "<u4", n, at + 8 * n), np.frombuffer(code, np.uint8, n, at + 12 * n))


def _own(table: pa.Table) -> pa.Table:
    """Entries of one owner -> for each sender the state of its minimizers in order."""
    parts = [_decode(code) for code in table.column("code").to_pylist()]
    m, a, b, state = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((b, a, m))
    starts = np.flatnonzero(np.concatenate([[True], m[order][1:] != m[order][:-1]]))
    ends = np.append(starts[1:], len(m))
    first, last = order[starts], order[ends - 1]
    local = np.maximum.reduceat(state[order], starts)
    found = np.where((local == _BRANCH) | (a[first] != a[last]) | (b[first] != b[last]), _BRANCH, np.where((local == _WHOLE) | (ends - starts > 1), _WHOLE, _ALONE)).astype(np.uint8)
    answer = np.empty(len(m), dtype=np.uint8)
    answer[order] = np.repeat(found, ends - starts)
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pa.table({"sender": table.column("sender").combine_chunks().cast(pa.string()), "owner": table.column("owner").combine_chunks().cast(pa.int32()),
                     "states": pa.array([x.tobytes() for x in np.split(answer, cuts)], pa.binary())})


def _repeated_paths(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                minimizer = np.frombuffer(row["minimizer"], "<u8")
                known = np.unique(minimizer)
                # Owners cover rising ranges, so their answers in order are those of the sorted minimizers.
                states = np.frombuffer(b"".join(r["states"] for r in sorted(row["replies"], key=lambda r: r["owner"])), np.uint8)
                state = states[np.searchsorted(known, minimizer)]
                keep = np.flatnonzero(state != _ALONE)
                text = np.frombuffer(row["path_text"], "<u4")[keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], pa.int64()).take(pa.array(text)), pa.array(row["text_key"], pa.int64()).take(pa.array(text)),
                    *(pa.array(np.frombuffer(row[c], "<u4")[keep].view(np.int32)) for c in ("start", "edges")),
                    pa.array(np.frombuffer(row["c1"], "<i8")[keep]), pa.array(np.frombuffer(row["c2"], "<i4")[keep]), pa.array(state[keep] == _BRANCH),
                ], names=["doc_id", "text_key", "start", "edges", "c1", "c2", "branch"])
    return run


def _edges(k: int):
    """Edges of the paths that have their source coordinate in a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(0), WORD_BYTES):
                words = split_words(texts)
                a, b = ROLLER_A.prefix(hash_words(words)), ROLLER_B.prefix(hash_words(words, 1))
                sources = batch.column(1).slice(row, len(texts)).to_pylist()
                for i, paths in enumerate(sources):
                    n = np.array([p["edges"] for p in paths])
                    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    at = words.first[i] + np.repeat([p["start"] for p in paths], n) + place
                    which = np.repeat(np.arange(len(paths)), n)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ROLLER_A.span(a, at, at + k).view(np.int64)), pa.array(ROLLER_B.span(b, at, at + k).view(np.int64)),
                        pa.array(np.array([p["c1"] for p in paths], dtype=np.int64)[which]), pa.array(np.array([p["c2"] for p in paths], dtype=np.int32)[which]),
                        pa.array(place.astype(np.int32)), pa.array(np.array([p["times"] for p in paths], dtype=np.int64)[which]),
                    ], names=["e1", "e2", "c1", "c2", "place", "times"])
    return run


def _cut(k: int, text_col: str, keep_row: bool, others: Broadcast | None = None):
    """Texts without the words of their paths. Rows whose key is marked in ``others`` are not dealt with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(texts_of(batch.column(1), text_col), WORD_BYTES):
                some = batch.slice(row, len(texts))
                if others is not None:
                    some = some.filter(pa.array(~is_marked(others.value, some.column(3).to_numpy())))
                    if not some.num_rows:
                        continue
                words = split_words(texts_of(some.column(1), text_col))
                marks = np.zeros(len(words.start) + 1, dtype=np.int64)
                for i, paths in enumerate(some.column(2).to_pylist()):
                    for p in paths or ():
                        places = np.arange(p["edges"]) if not p["branch"] else np.array(p["places"] or [], dtype=np.int64)
                        first = words.first[i] + p["start"] + np.unique(places)
                        marks[first] += 1
                        np.subtract.at(marks, first + k, 1)
                gone = np.cumsum(marks[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                raw = words.data.tobytes()
                kept_words = []
                for i in range(words.texts):
                    keep = words.first[i] + np.flatnonzero(~gone[words.first[i]: words.first[i + 1]])
                    kept_words.append(b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())]))
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(3), pa.array(words.counts(), pa.int64()), pa.array(removed[words.first[1:]] - removed[words.first[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in kept_words]), pa.array(kept_words, pa.binary()).cast(pa.string()),
                    *([some.column(1)] if keep_row else []),
                ], names=["doc_id", "text_key", "n_words", "n_removed", "kept_sha256", "kept_text", *(["row"] if keep_row else [])])
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, owners: int | None = None, keep_row: bool = False) -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_removed, kept_sha256, kept_text.

    Words are runs outside 0x20 and 0x09-0x0D, taken unchanged. A word goes if a window
    of ``k`` words that covers it starts at another place too, in any text, the same one
    included; windows are judged on the input. A null text has no words. Texts with
    fewer than ``k`` words stay whole. Repeated rows count as other places. An empty
    table gives no rows; columns beside the two named are not read, unless ``keep_row``
    asks for the input row as a struct ``row``.
    """
    spark = docs.sparkSession
    owners = max(owners or int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    seed = min(SEED_WORDS, k)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))

    blocks = shared_table(source.mapInArrow(_block_paths(k, seed, owners), BLOCK_SCHEMA))
    replies = (
        blocks.select("sender", F.inline("sent")).groupBy("owner")
        .applyInArrow(_own, "sender string, owner int, states binary")
        .groupBy("sender").agg(F.collect_list(F.struct("owner", "states")).alias("replies"))
    )
    paths = shared_table(blocks.drop("sent").join(replies, "sender").mapInArrow(_repeated_paths(owners), PATH_SCHEMA))

    def with_paths(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        """Texts joined with what is known of them; ``rows``: (r_id, r_key, paths), one for a text.

        Texts are always shuffled, so that the test of their marks and the step after the
        join never need two Python workers for one task.
        """
        return texts.join(rows.hint("merge"), texts["doc_id"].eqNullSafe(rows["r_id"]) & (texts["text_key"] == rows["r_key"]), how)

    sources = shared_table(
        paths.filter("branch").groupBy("c1", "c2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "start", "edges")).alias("at"))
        .groupBy(F.col("at.doc_id").alias("r_id"), F.col("at.text_key").alias("r_key"))
        .agg(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.edges").alias("edges"), "c1", "c2", "times")).alias("paths"))
    )
    edges = shared_table(
        with_paths(source.filter(marked_by(marked_keys(sources, "r_key"))(F.col("text_key"))), sources, "inner").select("text", "paths").mapInArrow(_edges(k), "e1 bigint, e2 bigint, c1 bigint, c2 int, place int, times bigint"))
    repeated = edges.groupBy("e1", "e2").agg(F.sum("times").alias("n")).filter("n > 1").select("e1", "e2")
    places = edges.join(repeated, ["e1", "e2"], "left_semi").groupBy("c1", "c2").agg(F.collect_list("place").alias("places"))

    branching = paths.filter("branch").join(places, ["c1", "c2"])
    whole = paths.filter("NOT branch").withColumn("places", F.lit(None).cast("array<int>"))
    found = shared_table(
        whole.unionByName(branching).groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"))
        .agg(F.collect_list(F.struct("start", "edges", "branch", "places")).alias("paths")))
    whole_rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), rows_and_text(docs, text_col, keep_row))
    carried = whole_rows.columns[2]
    # Texts without a path stay where they are; those that a path is known of meet it.
    has_path = marked_keys(found, "r_key")
    met = with_paths(whole_rows.filter(marked_by(has_path)(F.col("text_key"))), found, "left").select("doc_id", carried, "paths", "text_key")
    alone = whole_rows.select("doc_id", carried, F.lit(None).cast(found.schema["paths"].dataType).alias("paths"), "text_key")
    schema = StructType([
        StructField("doc_id", LongType()), StructField("text_key", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept_sha256", StringType()), StructField("kept_text", StringType()), *([met.schema[carried]] if keep_row else []),
    ])
    return alone.mapInArrow(_cut(k, text_col, keep_row, has_path), schema).unionByName(met.mapInArrow(_cut(k, text_col, keep_row), schema))
