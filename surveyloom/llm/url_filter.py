"""URL filters: all wildcard rules at once by a bit-parallel Shift-And automaton.

Each rule is one or more globs over the canonical form of a URL, host + NUL + path, both
as UTF-8 bytes. Positions of all globs lie one after another in a bit mask of as many
64-bit words as needed. A position may loop on a class of bytes (a star); one step per byte
moves every glob of every URL of a batch, the URLs side by side in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Host and path rules: (action, host, path). A fixed list.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Globs over host and path for URLs that no host rule fits; the rest is allowed.
DEFAULT_BLOCK = ("*ads-track.*/*", "*/login*", "*/wp-admin/*", "*.exe", "*.zip")

SPLIT = "\0"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Glob:
    """``tokens``: characters, ``*`` for any run, ``*.`` style host runs as ``host*``; ``rule``: what it stands for."""

    tokens: tuple[str, ...]
    rule: int


def globs_of(rules, defaults) -> list[Glob]:
    """A host rule is the host itself and any subdomain, then its path and any rest."""
    out = []
    for i, (_, host, path) in enumerate(rules):
        tail = (*host.translate(_LOWER), SPLIT, *path, "any*")
        out += [Glob(tail, i), Glob(("host*", ".", *tail), i)]
    for pattern in defaults:
        host, slash, path = pattern.partition("/")
        if slash:
            tokens = (*("host*" if c == "*" else c for c in host), SPLIT, "/", *("any*" if c == "*" else c for c in path))
        else:
            tokens = tuple("any*" if c == "*" else c for c in pattern)
        out.append(Glob(tokens, -1))
    return out


class Automaton:
    """Bit i * 64 + j is position 64 i + j of the globs laid end to end.

    Every glob has a start position, then one position for each byte. A star is no
    position of its own: it lets the position before it loop.
    """

    def __init__(self, globs: list[Glob]):
        moves, loops, starts, ends = [], [], [], []
        for g in globs:
            starts.append(len(moves))
            moves.append(None)
            loops.append(None)
            for token in g.tokens:
                if token in ("any*", "host*"):
                    loops[-1] = token
                else:
                    moves += token.encode()
                    loops += [None] * len(token.encode())
            ends.append(len(moves) - 1)
        self.words = (len(moves) + 63) // 64
        self.rules = np.array([g.rule for g in globs])
        self.ends = np.array(ends)
        self.start = self._mask(starts)
        self.move = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros((256, self.words), dtype=np.uint64)
        for c in range(256):
            self.move[c] = self._mask([i for i, m in enumerate(moves) if m == c])
            self.loop[c] = self._mask([i for i, m in enumerate(loops) if m == "any*" or (m == "host*" and c != 0)])

    def _mask(self, positions: list[int]) -> np.ndarray:
        out = [0] * self.words
        for p in positions:
            out[p // 64] |= 1 << (p % 64)
        return np.array(out, dtype=np.uint64)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs): does the glob match the whole text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        length = np.array([len(texts[i]) for i in order], dtype=np.int64)
        offset = np.concatenate([[0], np.cumsum(length)])
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        active = len(texts)
        for step in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length[:active], -step, side="left"))
            c = data[offset[:active] + step]
            now = state[:active]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (shifted & self.move[c]) | (now & self.loop[c])
        hit = np.zeros((len(texts), len(self.ends)), dtype=bool)
        hit[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1) > 0
        return hit


def _judge(rules, defaults):
    names = [f"{host}{path}" for _, host, path in rules]
    rank = np.array([len(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs_of(rules, defaults))
        for batch in batches:
            host, path = (batch.column(i).to_pylist() for i in (1, 2))
            hit = automaton.run([(h.replace(SPLIT, " ") + SPLIT + p.replace(SPLIT, " ")).encode() for h, p in zip(host, path)])
            fits = np.zeros((len(host), len(rules)), dtype=bool)
            for g, rule in enumerate(automaton.rules):
                if rule >= 0:
                    fits[:, rule] |= hit[:, g]
            blocked = hit[:, automaton.rules < 0].any(axis=1) if len(hit) else np.zeros(0, dtype=bool)
            best = np.where(fits, rank, 0).argmax(axis=1) if len(hit) and rules else np.zeros(len(host), dtype=np.int64)
            found = fits.any(axis=1)
            rule = [names[b] if f else None for b, f in zip(best, found)]
            verdict = [rules[b][0] if f else ("block" if x else "allow") for b, f, x in zip(best, found, blocked)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])
    return run


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    found = F.instr(url, "://") > 0
    rest = F.substring_index(F.substring_index(F.substr(url, F.instr(url, F.lit("://")) + F.lit(3)), "#", 1), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + F.lit(1))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = F.lit("")
    return F.coalesce(F.when(found, lower), empty), F.coalesce(F.when(found, path), empty)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=HOST_RULES, defaults=DEFAULT_BLOCK) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest (host and path together) decides, the first listed of equally long ones.
    Without a fitting rule a page is blocked if a default glob matches, else allowed, so
    a null URL or one without ``://`` is allowed. Rows may repeat; an empty table gives
    no rows; other columns are not read. No shuffle.
    """
    host, path = url_parts(F.col(url_col))
    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    return source.mapInArrow(_judge(tuple(rules), tuple(defaults)), "page_id bigint, host string, path string, rule string, verdict string")
