"""Words of whole texts as arrays: boundaries, 64-bit hashes and window hashes.

A word is a run of bytes outside space and 0x09-0x0D. All functions work on the UTF-8
buffer of an Arrow string array, so a batch costs a few passes over it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(self.texts), self.counts())


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text offsets; nulls count as empty texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, outside: np.ndarray = _SPACE) -> Words:
    """Words of texts; ``outside``: for each byte whether it lies between words."""
    data, offsets = buffer_of(texts)
    inside = ~outside[data]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    padded = np.concatenate([words.data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(shape=(len(words.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = words.end - words.start
    h = mix((length.astype(np.uint64) + np.uint64(seed + 1)) * _MULTIPLIER)
    h = mix(h ^ (lanes[words.start] & _MASKS[np.minimum(length, 8)]))
    long = np.flatnonzero(length > 8)
    at = 8
    while len(long):
        rest = np.minimum(length[long] - at, 8)
        h[long] = mix(h[long] * _MULTIPLIER ^ (lanes[words.start[long] + at] & _MASKS[rest]))
        at += 8
        long = long[length[long] > at]
    return h


class Roller:
    """Hashes of all runs of ``k`` items by prefix sums with powers of an odd base."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            have = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, have, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, have, 1 << 64))])

    def prefix(self, items: np.ndarray) -> np.ndarray:
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * self.powers[: len(items)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of items[start:end] for each pair; equal runs have equal hashes."""
        return mix((prefix[end] - prefix[start]) * self.inverses[start] + (end - start).astype(np.uint64) * _MULTIPLIER)


ROLLER_A = Roller(0xD1342543DE82EF95)
ROLLER_B = Roller(0xAF251AF3B0F025B5)


def window_starts(counts: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of ``k`` words that lies in one text, and the text of each."""
    n = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][text] + within, text
