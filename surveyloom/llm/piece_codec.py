"""SentencePiece encoding and decoding by best total score, giant texts in parallel.

The vocabulary of a model file is read as a unigram model: the encoding of a text is the
segmentation with the largest sum of piece scores (of equal ones the one whose last
piece is longest, then the one before it). Characters without a piece cost a fixed
penalty and become byte pieces.

No piece of the vocabulary has a word mark after another character, so words are
segmented alone, each distinct one once, all words of a batch side by side. Giant texts
are cut into chunks anywhere. The state at a cut is how many characters a piece from the
left reaches over it. A chunk gives the matrix of best scores from each entry state to
each exit state; matrices are combined by (max, +) products, chunks to blocks, blocks to
texts, which gives the best scores of all states at every cut. With these a chunk knows by
itself from which entry state the rule for ties comes to each exit state; these maps are
composed from the end of the text to its start, the state at every cut follows, and each chunk
is segmented on its own. Scores are multiples of a power of two, so sums do not depend on
their order, and the ids are those of the text as a whole, whatever the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from surveyloom.llm.common import shared_table, text_slices
from surveyloom.llm.words import mix

MARK = "▁"

#: Texts of more code points go by chunks of so many, blocks hold so many chunks.
GIANT_CHARS = 65_536
CHUNK_CHARS = 4_096
BLOCK_CHUNKS = 64

#: Chunks that a task lays side by side, and words that a worker remembers.
SIDE_BY_SIDE = 32
REMEMBERED = 200_000

#: Rows decoded before they are handed back.
DECODE_ROWS = 256

#: Bytes of text whose words a task holds at once.
SLICE = 1_000_000

#: Pieces below this score (runs of word marks, scored as no merge) count as one less than the least other.
NO_SCORE = -1e8
UNKNOWN_PENALTY = 10.0

#: Scores are rounded to multiples of this, so that their sums are exact.
SCORE_STEP = 2.0 ** -16

_RUN = re.compile(f"{MARK}*[^{MARK}]*")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = -np.inf


class Pieces:
    """Scores of pieces by the hash of their characters, and the bytes each id stands for."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        hashes, ids, scores = [], [], []
        longest = 1
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.encode().replace(MARK.encode(), b" "))
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses the start of a word")
                hashes.append(self.hash_of(piece))
                ids.append(i)
                scores.append(model.get_score(i))
                longest = max(longest, len(piece))
        order = np.argsort(np.array(hashes, dtype=np.uint64))
        self.hash = np.array(hashes, dtype=np.uint64)[order]
        self.id = np.array(ids, dtype=np.int64)[order]
        self.score = np.round(np.array(scores, dtype=np.float64)[order] / SCORE_STEP) * SCORE_STEP
        scored = self.score > NO_SCORE
        self.score[~scored] = self.score[scored].min() - 1
        self.longest = longest
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        # First entry for the leading bits of a hash, so that a look-up compares few.
        self.bits = 18
        self.slot = np.searchsorted(self.hash, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.probes = int(np.bincount((self.hash >> np.uint64(64 - self.bits)).astype(np.int64)).max())

    @staticmethod
    def hash_of(piece: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in piece:
            h = mix(h * _FACTOR + np.uint64(ord(c) + 1))
        return int(h[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the pieces, -1 without one."""
        at = self.slot[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(h.shape, -1, dtype=np.int32)
        for _ in range(self.probes):
            inside = np.minimum(at, len(self.hash) - 1)
            hit = self.hash[inside] == h
            out[hit] = inside[hit]
            at = at + 1
        return out

    def lattice(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece index of points[:, i: i + length] at every start i."""
        out, h = [], np.zeros(points.shape, dtype=np.uint64)
        for length in range(1, min(self.longest, points.shape[1]) + 1):
            n = points.shape[1] - length + 1
            h = mix(h[:, :n] * _FACTOR + points[:, length - 1: length - 1 + n] + np.uint64(1))
            out.append(self.find(h))
        return out

    def best_pieces(self, points: np.ndarray, lattice: list[np.ndarray], start: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, length of the last piece) of the best way to each position; rows run side by side.

        ``start``: (rows, entries, positions + 1) scores to begin with, changed in place.
        Pieces begin within the first ``chars`` points of a row only.
        """
        value, back = start, np.zeros(start.shape, dtype=np.int8)
        scores = np.append(self.score, _NONE)
        inside = np.arange(points.shape[1]) < chars[:, None]
        tables = [np.where(inside[:, : x.shape[1]], scores[x], _NONE) for x in lattice]
        tables[0] = np.where(inside & (lattice[0] < 0), self.unknown, tables[0])
        some = [(x > _NONE).any(axis=0) for x in tables]
        for end in range(1, points.shape[1] + 1):
            best, last = value[:, :, end], back[:, :, end]
            for length in range(min(len(tables), end), 0, -1):
                at = end - length
                if some[length - 1][at]:
                    now = value[:, :, at] + tables[length - 1][:, at][:, None]
                    better = now > best
                    best = np.where(better, now, best)
                    last = np.where(better, np.int8(length), last)
            value[:, :, end], back[:, :, end] = best, last
        return value, back

    def trace(self, points: np.ndarray, lattice: list[np.ndarray], back: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Ids (u2) of each row, walking back from ``end`` until a position that nothing led to."""
        rows = np.arange(len(points))
        at, found = end.copy(), []
        while True:
            length = back[rows, at].astype(np.int64)
            if not length.any():
                break
            begin = at - length
            index = np.full(len(points), -1, dtype=np.int64)
            for n in np.unique(length[length > 0]):
                chosen = length == n
                index[chosen] = lattice[n - 1][chosen, begin[chosen]]
            ids = np.where(index >= 0, self.id[index], -2 - points[rows, np.maximum(begin, 0)].astype(np.int64))
            found.append(np.where(length > 0, ids, -1))
            at = begin
        if not found:
            return [b""] * len(points)
        found = np.stack(found[::-1], axis=1)
        out = []
        known, gaps = found != -1, (found < -1).any(axis=1)
        for ids, keep, unknown in zip(found, known, gaps):
            ids = ids[keep]
            if unknown:
                ids = np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")])])
            out.append(ids.astype("<u2").tobytes())
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, segmented alone."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            groups.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 128 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in groups.items():
            step = max(1, 40_000 // width)
            for low in range(0, len(members), step):
                part = members[low: low + step]
                text = "".join(words[i].ljust(width, "\0") for i in part)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), width).astype(np.uint64)
                size = np.array([len(words[i]) for i in part])
                lattice = self.lattice(points)
                start = np.full((len(part), 1, width + 1), _NONE)
                start[:, :, 0] = 0
                _, back = self.best_pieces(points, lattice, start, size)
                for i, ids in zip(part, self.trace(points, lattice, back[:, 0, :], size)):
                    out[i] = ids
        return out


@lru_cache(maxsize=1)
def load_pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def escaped(text: str) -> str:
    """The text as it is segmented: a word mark for each space, and one in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def _encode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path)
        known: dict[str, bytes] = {}
        for batch in batches:
            for row, some in text_slices(batch.column(2), SLICE):
                texts = [_RUN.findall(escaped(t.as_py()))[:-1] for t in some]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list({w for words in texts for w in words if w not in known})
                known.update(zip(new, pieces.words(new)))
                ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u2") for words in texts]
                yield _id_batch(batch.column(0).slice(row, len(some)), batch.column(1).slice(row, len(some)), ids)
    return run


def _id_batch(doc_id, text_key, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint16)
    return pa.RecordBatch.from_arrays([doc_id, text_key, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=["doc_id", "text_key", "ids"])


def _chunks(size: int, reach: int):
    """Chunks of the escaped texts, each with the characters a piece may reach into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = escaped(text)
                n = -(-len(text) // size)
                name = f"{part}-{number}"
                number += 1
                for low in range(0, n, 256):
                    some = range(low, min(low + 256, n))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(some)), pa.array([doc] * len(some), pa.int64()), pa.array([key] * len(some), pa.int64()), pa.array(list(some), pa.int32()),
                        pa.array([min(size, len(text) - i * size) for i in some], pa.int32()), pa.array([text[i * size: (i + 1) * size + reach] for i in some]),
                    ], names=["name", "doc_id", "text_key", "chunk", "chars", "body"])
    return run


def _points(bodies: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(bodies), width), dtype=np.uint64)
    for i, body in enumerate(bodies):
        p = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[i, : len(p)] = p
    return out


def _transfer(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path)
        states = pieces.longest
        for batch in batches:
            for low in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(low, SIDE_BY_SIDE)
                chars = part.column("chars").to_numpy()
                bodies = part.column("body").to_pylist()
                width = int(chars.max()) + states - 1
                value = _forward(pieces, _points(bodies, width), chars, np.where(np.eye(states) > 0, 0.0, _NONE)[None].repeat(len(bodies), axis=0))[0]
                reach = chars[:, None] + np.arange(states)
                matrix = value[np.arange(len(bodies))[:, None], :, reach].transpose(0, 2, 1)
                # The end of a text is no place to reach over.
                inside = reach <= np.array([len(b) for b in bodies])[:, None]
                matrix = np.where(inside[:, None, :], matrix, _NONE)
                yield pa.RecordBatch.from_arrays([part.column("name"), part.column("chunk"), pa.array([m.tobytes() for m in matrix], pa.binary())], names=["name", "chunk", "matrix"])
    return run


def _forward(pieces: Pieces, points: np.ndarray, chars: np.ndarray, entry: np.ndarray):
    """Best ways from entry states (rows, entries, states) over the chunk and its reach."""
    lattice = pieces.lattice(points)
    start = np.full((entry.shape[0], entry.shape[1], points.shape[1] + 1), _NONE)
    start[:, :, : entry.shape[2]] = entry
    return (*pieces.best_pieces(points, lattice, start, chars), lattice)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _matrices(column) -> np.ndarray:
    raw = column.to_pylist()
    states = int(round((len(raw[0]) // 8) ** 0.5))
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, states, states)


def _product(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    out = None
    for m in _matrices(table.column("matrix")):
        out = m if out is None else max_plus(out, m)
    return pa.table({"name": table.column("name").combine_chunks().slice(0, 1).cast(pa.string()), "block": table.column("block").combine_chunks().slice(0, 1).cast(pa.int32()), "matrix": pa.array([out.tobytes()], pa.binary())})


def forward(matrices: np.ndarray, enter: np.ndarray) -> list[np.ndarray]:
    """Best score of each state before every matrix."""
    out = [enter]
    for m in matrices[:-1]:
        out.append((out[-1][:, None] + m).max(axis=0))
    return out


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(raw, dtype=np.float64) for raw in column.to_pylist()])


def _enter_blocks(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    matrices = _matrices(table.column("matrix"))
    enter = forward(matrices, np.where(np.arange(matrices.shape[1]) == 0, 0.0, _NONE))
    return pa.table({"name": table.column("name").combine_chunks().cast(pa.string()), "block": table.column("block").combine_chunks().cast(pa.int32()), "enter": pa.array([v.tobytes() for v in enter], pa.binary())})


def _enter_chunks(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    enter = forward(_matrices(table.column("matrix")), np.frombuffer(table.column("enter")[0].as_py(), dtype=np.float64))
    return pa.table({"name": table.column("name").combine_chunks().cast(pa.string()), "block": table.column("block").combine_chunks().cast(pa.int32()),
                     "chunk": table.column("chunk").combine_chunks().cast(pa.int32()), "enter": pa.array([v.tobytes() for v in enter], pa.binary())})


def _maps(model_path: str):
    """For each exit state of a chunk the entry state that its best way comes from (-1 without one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path)
        states = pieces.longest
        for batch in batches:
            for low in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(low, SIDE_BY_SIDE)
                chars, bodies = part.column("chars").to_numpy(), part.column("body").to_pylist()
                points = _points(bodies, int(chars.max()) + states - 1)
                value, back, _ = _forward(pieces, points, chars, _vectors(part.column("enter"))[:, None, :])
                rows = np.arange(len(bodies))[:, None]
                at = chars[:, None] + np.arange(states)
                reached = value[rows, 0, at] > _NONE
                while (length := back[rows, 0, at].astype(np.int64)).any():
                    at = at - length
                yield pa.RecordBatch.from_arrays([
                    part.column("name"), part.column("block"), part.column("chunk"), pa.array([np.where(r, a, -1).astype(np.int8).tobytes() for r, a in zip(reached, at)], pa.binary()),
                ], names=["name", "block", "chunk", "map"])
    return run


def _map_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(raw, dtype=np.int8) for raw in column.to_pylist()])


def composed(maps: np.ndarray) -> np.ndarray:
    """From the exit state of the last chunk to the entry state of the first."""
    out = maps[-1]
    for m in maps[-2::-1]:
        out = np.where(out >= 0, m[np.maximum(out, 0)], -1).astype(np.int8)
    return out


def leaving(maps: np.ndarray, last: int) -> list[int]:
    """Exit state of every chunk, given that of the last."""
    states = [last]
    for m in maps[:0:-1]:
        states.append(int(m[states[-1]]))
    return states[::-1]


def _compose_block(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    return pa.table({"name": table.column("name").combine_chunks().slice(0, 1).cast(pa.string()), "block": table.column("block").combine_chunks().slice(0, 1).cast(pa.int32()),
                     "map": pa.array([composed(_map_rows(table.column("map"))).tobytes()], pa.binary())})


def _leave_blocks(table: pa.Table) -> pa.Table:
    """A text ends where its last chunk does."""
    table = table.sort_by("block")
    return pa.table({"name": table.column("name").combine_chunks().cast(pa.string()), "block": table.column("block").combine_chunks().cast(pa.int32()),
                     "leave": pa.array(leaving(_map_rows(table.column("map")), 0), pa.int32())})


def _leave_chunks(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    return pa.table({"name": table.column("name").combine_chunks().cast(pa.string()), "chunk": table.column("chunk").combine_chunks().cast(pa.int32()),
                     "after": pa.array(leaving(_map_rows(table.column("map")), table.column("leave")[0].as_py()), pa.int32())})


def _segment(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, SIDE_BY_SIDE):
                part = batch.slice(low, SIDE_BY_SIDE)
                chars, bodies = part.column("chars").to_numpy(), part.column("body").to_pylist()
                points = _points(bodies, int(chars.max()) + pieces.longest - 1)
                _, back, lattice = _forward(pieces, points, chars, _vectors(part.column("enter"))[:, None, :])
                ids = pieces.trace(points, lattice, back[:, 0, :], chars + part.column("after").to_numpy())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("name", "doc_id", "text_key", "chunk")), pa.array([np.frombuffer(x, "<u2").tolist() for x in ids], pa.list_(pa.int32()))],
                                                 names=["name", "doc_id", "text_key", "chunk", "ids"])
    return run


def _encode_giants(source: DataFrame, path: str, chunk_chars: int, block_chunks: int) -> DataFrame:
    reach = load_pieces(path).longest - 1
    chunks = shared_table(source.mapInArrow(_chunks(chunk_chars, reach), "name string, doc_id bigint, text_key bigint, chunk int, chars int, body string"))
    matrices = shared_table(chunks.mapInArrow(_transfer(path), "name string, chunk int, matrix binary").withColumn("block", F.floor(F.col("chunk") / block_chunks).cast("int")))
    blocks = matrices.groupBy("name", "block").applyInArrow(_product, "name string, block int, matrix binary")
    block_enter = blocks.groupBy("name").applyInArrow(_enter_blocks, "name string, block int, enter binary")
    enter = matrices.join(block_enter, ["name", "block"]).groupBy("name", "block").applyInArrow(_enter_chunks, "name string, block int, chunk int, enter binary")
    entered = shared_table(chunks.join(enter, ["name", "chunk"]).select("name", "doc_id", "text_key", "block", "chunk", "chars", "body", "enter"))
    maps = shared_table(entered.select("name", "block", "chunk", "chars", "body", "enter").mapInArrow(_maps(path), "name string, block int, chunk int, map binary"))
    block_leave = maps.groupBy("name", "block").applyInArrow(_compose_block, "name string, block int, map binary").groupBy("name").applyInArrow(_leave_blocks, "name string, block int, leave int")
    after = maps.join(block_leave, ["name", "block"]).groupBy("name", "block").applyInArrow(_leave_chunks, "name string, chunk int, after int")
    parts = entered.join(after, ["name", "chunk"]).select("name", "doc_id", "text_key", "chunk", "chars", "body", "enter", "after").mapInArrow(_segment(path), "name string, doc_id bigint, text_key bigint, chunk int, ids array<int>")
    return parts.groupBy("name").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids")).drop("name")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """One row per input row: doc_id, text_key, ids. ``text_key`` is that of the text with word marks as spaces.

    A null text counts as empty and has no ids. Texts of more than ``giant_chars`` code
    points are encoded by chunks, with the same ids. Rows may repeat; an empty table gives
    no rows; columns beside the two named are not read.
    """
    from surveyloom.llm.tokens import tokenizer_path

    path = model_path or tokenizer_path("piece_bpe_32k.model")
    if chunk_chars < load_pieces(path).longest:
        raise ValueError("a chunk must be longer than the longest piece")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.replace(text, F.lit(MARK), F.lit(" "))).alias("text_key"), text.alias("text"))
    giant = F.char_length("text") > giant_chars
    short = source.filter(~giant).mapInArrow(_encode(path), "doc_id bigint, text_key bigint, ids array<int>")
    return short.unionByName(_encode_giants(source.filter(giant), path, chunk_chars, block_chunks))


def _decode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = load_pieces(model_path).bytes_of
        for batch in batches:
            for low in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(low, DECODE_ROWS)
                texts = []
                for ids in part.column(0):
                    raw = b"".join(map(bytes_of.__getitem__, ids.values.to_numpy().tolist())) if ids.is_valid else b""
                    texts.append((raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])
    return run


def decode(encoded: DataFrame, *keep: str, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``text``, decoded from the ids. Null ids are an empty text.

    The space in front that encoding adds is taken off, byte pieces are joined to
    characters, bytes that are none become U+FFFD; control ids stand for nothing.
    """
    from pyspark.sql.types import StringType, StructType

    from surveyloom.llm.tokens import tokenizer_path

    path = model_path or tokenizer_path("piece_bpe_32k.model")
    rows = encoded.select(ids_col, *keep)
    schema = StructType([*rows.schema.fields[1:]]).add("text", StringType())
    return rows.mapInArrow(_decode(path), schema)
