"""Phrase collocations by direct-address tiling.

Words are lower-cased, counted per language and ranked by frequency. A pair of frequent
words is an address: the ranks fall into blocks of ``TILE``, two blocks make a tile, and
the fullest tiles are counted in place by ``bincount`` over a dense array that a task
carries along. All other pairs are counted as sorted coordinates of a slice. Frequent
pairs are then ranked again and take the first place of the address, which counts phrases
of three words, and so on. Tasks send (words, count) rows only; Spark sums them.

What a task holds beside its slice has a fixed bound: the ranks of ``HEAD`` words and
``HEAD`` phrases, ``DENSE_TILES`` tiles, and per length a bitmap of ``BITS`` bits in which
every frequent phrase of that length is marked by its hash. The bitmap only spares work: a
phrase can be frequent only if its parts are, and what passes by chance is dropped by its count.

Words are told apart by 64 bits that depend on the language; were two words of a table ever
to share them, which the word counts show, the hash is changed and the words counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.llm.common import shared_table, text_slices
from surveyloom.llm.words import hash_words, mix, split_words

#: Ranks along one side of a tile.
TILE = 512

#: Tiles counted in place; those where most occurrences are expected.
DENSE_TILES = 64

#: Words, and phrases of each length, that have a rank.
HEAD = 1 << 16

#: Bits of the bitmap of frequent phrases of one length.
BITS = 1 << 27

#: Bytes of text handled at once.
SLICE = 4_000_000

#: A task sends its dense counts when it has seen so many words, long before a count can overflow.
FLUSH_WORDS = 1 << 30

#: The best of a language are chosen among those of about so many parts, theirs among as many, and so on.
MERGED_PARTS = 8

NO_LANGUAGE = "und"

_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_OUTSIDE = _CUT.copy()
_OUTSIDE[[0x20, 0x09]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of a phrase from the keys of its words."""
    h = columns[0]
    for c in columns[1:]:
        h = mix(h * _ODD + c)
    return h


@dataclass
class Tokens:
    """Words of a slice: keys, and whether the next word follows in the same piece."""

    words: object
    key: np.ndarray
    text: np.ndarray
    followed: np.ndarray


def tokens_of(texts: pa.Array, langs: list[str], seed: int) -> Tokens:
    words = split_words(pc.ascii_lower(texts), _OUTSIDE)
    text = words.text_of()
    known = {lang: int.from_bytes(hashlib.blake2b(f"{seed} {lang}".encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    salt = np.array([known[lang] for lang in langs], dtype=np.uint64)
    key = mix(hash_words(words, seed) ^ salt[text]) if len(text) else np.zeros(0, dtype=np.uint64)
    piece = np.cumsum(_CUT[words.data], dtype=np.int32)[words.start]
    followed = np.zeros(len(text), dtype=bool)
    followed[:-1] = (piece[:-1] == piece[1:]) & (text[:-1] == text[1:])
    return Tokens(words, key, text, followed)


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Tokens, list[str]]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, part in text_slices(batch.column(1), SLICE):
            yield tokens_of(part, langs[row: row + len(part)], seed), langs[row: row + len(part)]


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, langs in _slices(batches, seed):
            key, at, times = np.unique(tokens.key, return_index=True, return_counts=True)
            raw, start, end = tokens.words.data.tobytes(), tokens.words.start[at].tolist(), tokens.words.end[at].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array([langs[i] for i in tokens.text[at].tolist()], pa.string()),
                pa.array([raw[s:e] for s, e in zip(start, end)], pa.binary()).cast(pa.string()), pa.array(times, pa.int64()),
            ], names=["k1", "lang", "phrase", "f"])
    return run


@dataclass
class Head:
    """The most frequent phrases of one length in blocks of ranks, found by hash and checked by key."""

    hashes: np.ndarray
    place: np.ndarray
    columns: list[np.ndarray]

    def places(self, columns: list[np.ndarray]) -> np.ndarray:
        """Block * TILE + rank in the block of each phrase, -1 where it has no rank."""
        h = phrase_hash(columns)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        found = self.hashes[at] == h
        for mine, theirs in zip(self.columns, columns):
            found &= mine[self.place[at]] == theirs
        return np.where(found, self.place[at], -1)


def _head(rows: list, length: int) -> tuple[Head, dict[str, np.ndarray]]:
    """The head, and the occurrences in each block by language. Blocks never mix languages."""
    by_lang: dict[str, list] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    places, keys, mass, block = [], [], {}, 0
    for lang, members in sorted(by_lang.items()):
        members.sort(key=lambda r: (-r["f"], *[r[f"k{i + 1}"] for i in range(length)]))
        blocks = -(-len(members) // TILE)
        places += range(block * TILE, block * TILE + len(members))
        keys += [[r[f"k{i + 1}"] for i in range(length)] for r in members]
        sums = np.add.reduceat([float(r["f"]) for r in members], np.arange(0, len(members), TILE))
        mass[lang] = (block, sums)
        block += blocks
    table = np.array(keys, dtype=np.int64).reshape(-1, length).view(np.uint64)
    place = np.array(places, dtype=np.int64)
    columns = []
    for i in range(length):
        column = np.zeros(block * TILE, dtype=np.uint64)
        column[place] = table[:, i]
        columns.append(column)
    hashes, first = np.unique(phrase_hash([table[:, i] for i in range(length)]), return_index=True)
    return Head(hashes, place[first], columns), mass


def _dense_tiles(items: dict, words: dict, totals: dict[str, int]) -> np.ndarray:
    """(item block, word block) of the tiles where most occurrences are expected, sorted."""
    expected = []
    for lang, (item_block, item_mass) in items.items():
        if lang in words:
            word_block, word_mass = words[lang]
            # Blocks are ordered by frequency, so the fullest tiles lie among the first of both sides.
            grid = np.outer(item_mass[:DENSE_TILES], word_mass[:DENSE_TILES]) / max(totals[lang], 1)
            expected += [(-v, item_block + i, word_block + j) for (i, j), v in np.ndenumerate(grid)]
    return np.array(sorted((i, j) for _, i, j in sorted(expected)[:DENSE_TILES]), dtype=np.int64).reshape(-1, 2)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _extend(item: np.ndarray, length: int, tokens: Tokens) -> np.ndarray:
    """Starts of the phrases of ``length`` + 1 words both of whose parts are marked."""
    both = (item[:-1] >= 0) & (item[1:] >= 0)
    if length == 1:
        both &= tokens.followed[:-1]
    return np.flatnonzero(both)


def _count_longer(length: int, seed: int, shared):
    """Counts of phrases of ``length`` + 1 words, from marked phrases of ``length`` words and one word more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, items, words, tiles = shared.value
        codes = tiles[:, 0] * (1 << 32) + tiles[:, 1]
        dense = np.zeros((len(tiles), TILE * TILE), dtype=np.int32)
        seen = 0

        def rows(columns: list[np.ndarray], times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], pa.array(times, pa.int64())],
                                              names=[*[f"k{i + 1}" for i in range(length + 1)], "f"])

        def dense_rows() -> Iterator[pa.RecordBatch]:
            for (a, b), counts in zip(tiles.tolist(), dense):
                at = np.flatnonzero(counts)
                yield rows([*[c[a * TILE + at // TILE] for c in items.columns], words.columns[0][b * TILE + at % TILE]], counts[at].astype(np.int64))

        for tokens, _ in _slices(batches, seed):
            if len(tokens.key) <= length:
                continue
            key, word = np.unique(tokens.key, return_inverse=True)
            columns = [key]
            item = np.where(_has(bitmaps[0], key)[word], word, -1)
            for m in range(1, length):
                start = _extend(item, m, tokens)
                address, found = np.unique(item[start] * len(key) + word[start + m], return_inverse=True)
                columns = [c[address // len(key)] for c in columns] + [key[address % len(key)]]
                item = np.full(len(word), -1, dtype=np.int64)
                item[start] = np.where(_has(bitmaps[m], phrase_hash(columns))[found], found, -1)
            start = _extend(item, length, tokens)
            first, last = item[start], word[start + length]
            item_place, word_place = items.places(columns)[first], words.places([key])[last]
            ranked = (item_place >= 0) & (word_place >= 0)
            code = (item_place // TILE) * (1 << 32) + word_place // TILE
            slot = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            tiled = ranked & (codes[slot] == code) if len(codes) else np.zeros(len(start), dtype=bool)
            inside = (item_place[tiled] % TILE) * TILE + word_place[tiled] % TILE
            order = np.argsort(slot[tiled], kind="stable")
            bounds = np.searchsorted(slot[tiled][order], np.arange(len(codes) + 1))
            for t in np.flatnonzero(np.diff(bounds)):
                dense[t] += np.bincount(inside[order[bounds[t]: bounds[t + 1]]], minlength=TILE * TILE).astype(np.int32)
            address, times = np.unique(first[~tiled] * len(key) + last[~tiled], return_counts=True)
            if len(address):
                yield rows([*[c[address // len(key)] for c in columns], key[address % len(key)]], times)
            seen += len(word)
            if seen > FLUSH_WORDS:
                yield from dense_rows()
                dense[:] = 0
                seen = 0
        yield from dense_rows()
    return run


def _mark(length: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(length)]
            bit = np.unique(phrase_hash(columns) & np.uint64(cells * 64 - 1))
            if len(bit):
                cell = (bit >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell[first]), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first).view(np.int64))], names=["cell", "bits"])
    return run


def _bitmap(frequent: DataFrame, length: int, bits: int) -> np.ndarray:
    """Marks of all frequent phrases of one length; at most ``bits`` / 64 numbers reach the driver."""
    cells = bits // 64
    marks = frequent.select(*[f"k{i + 1}" for i in range(length)]).mapInArrow(_mark(length, cells), "cell bigint, bits bigint")
    found = marks.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells, dtype=np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _keys(first: int, last: int) -> list[str]:
    return [f"k{i}" for i in range(first, last + 1)]


def _look_up(rows: DataFrame, table: DataFrame, at: int, length: int, values: dict[str, str]) -> DataFrame:
    """Columns of the phrase of ``length`` words that starts at word ``at`` of each row."""
    right = table.select(*[F.col(f"k{i}").alias(f"k{at + i - 1}") for i in range(1, length + 1)], *[F.col(c).alias(n) for c, n in values.items()])
    return rows.join(right, _keys(at, at + length - 1))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50,
    head: int = HEAD, bits: int = BITS, seed: int = 0,
) -> DataFrame:
    """The best phrases of two to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; ``.,;:!?`` and 0x0A-0x0D end a piece, space and tab a word. A
    phrase lies within a piece; all its occurrences count, overlapping ones too. A null
    language is ``und``; null and empty texts have no words. ``a``: occurrences, at least
    ``least``; ``l``, ``r``: those of the two parts at the cut with the lowest score, the
    first of equal ones; ``n``: words of the language; ``score``: floor(10^6 a^2 / (l r)),
    exact. A phrase that lies within a longer one which has ``inside_percent`` of its
    occurrences goes. The order is score and a downwards, then the bytes of the phrase.
    Repeated rows count each. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    while True:
        counted = source.mapInArrow(_count_words(seed), "k1 bigint, lang string, phrase string, f bigint")
        words = shared_table(counted.groupBy("k1", "lang", "phrase").agg(F.sum("f").alias("f")))
        if words.groupBy("k1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = {1: words.filter(F.col("f") >= least)}
    best = lambda m: known[m].select("lang", "f", *_keys(1, m)).orderBy(F.desc("f"), *_keys(1, m)).limit(head).collect()
    word_rows = best(1)
    langs = sorted({r["lang"] for r in word_rows})
    n = {r["lang"]: r["n"] for r in totals.filter(F.col("lang").isin(langs)).collect()}
    word_head, word_mass = _head(word_rows, 1)
    bitmaps = [_bitmap(known[1], 1, bits)]
    candidates: dict[int, DataFrame] = {}
    for m in range(1, longest):
        item_head, item_mass = (word_head, word_mass) if m == 1 else _head(best(m), m)
        if m > 1:
            bitmaps.append(_bitmap(known[m], m, bits))
        shared = spark.sparkContext.broadcast((bitmaps, item_head, word_head, _dense_tiles(item_mass, word_mass, n)))
        schema = ", ".join(f"{k} bigint" for k in [*_keys(1, m + 1), "f"])
        counts = shared_table(
            source.mapInArrow(_count_longer(m, seed, shared), schema).groupBy(*_keys(1, m + 1)).agg(F.sum("f").alias("f")).filter(F.col("f") >= least))
        rows = counts
        for k in range(1, m + 1):
            rows = _look_up(rows, known[k], 1, k, {"f": f"l{k}"} | ({"lang": "lang", "phrase": "before"} if k == m else {}))
            rows = _look_up(rows, known[m + 1 - k], k + 1, m + 1 - k, {"f": f"r{k}"} | ({"phrase": "word"} if k == m else {}))
        wide = "decimal(38,0)"
        cuts = [F.struct(
            F.expr(f"(cast(f as {wide}) * cast(f as {wide}) * 1000000) div (cast(l{k} as {wide}) * cast(r{k} as {wide}))").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m + 1)]
        lowest = F.least(*cuts) if m > 1 else cuts[0]
        known[m + 1] = shared_table(
            rows.withColumn("phrase", F.concat_ws(" ", "before", "word")).withColumn("cut", lowest)
            .select(*_keys(1, m + 1), "lang", "phrase", "f", "cut.score", "cut.l", "cut.r"))
        candidates[m + 1] = known[m + 1]
    kept = []
    for m in range(2, longest + 1):
        inside = None
        for longer in range(m + 1, longest + 1):
            for at in range(1, longer - m + 2):
                part = candidates[longer].select(*[F.col(f"k{at + i - 1}").alias(f"k{i}") for i in range(1, m + 1)], F.col("f").alias("longer"))
                inside = part if inside is None else inside.unionByName(part)
        rows = candidates[m].withColumn("salt", F.xxhash64(*_keys(1, m)))
        if inside is not None:
            most = inside.groupBy(*_keys(1, m)).agg(F.max("longer").alias("longer"))
            rows = rows.join(most, _keys(1, m), "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("f")))
        kept.append(rows.select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score", "salt"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    while parts > 1:
        part = Window.partitionBy("lang", F.pmod("salt", F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
        parts = parts // MERGED_PARTS
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
