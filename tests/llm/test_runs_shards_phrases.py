"""Periodic runs, k-d shards and collocations against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import by_value

from surveyloom.llm import collocations as phrases, periodic_runs as runs_module
from surveyloom.llm.collocations import collocations
from surveyloom.llm.kd_shards import kd_shards
from surveyloom.llm.periodic_runs import periodic_runs, runs_of
from surveyloom.llm.queries import with_periods
from surveyloom.llm.words import ROLLER_A

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, shortest, repeats):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(shortest, repeats * q) and not any(all(w[i + k] == w[i + k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_with_periods(rng):
    alphabet = [f"w{i}" for i in range(rng.choice([1, 2, 3, 40]))]
    w = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        at, base = rng.randint(0, len(w)), [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
        w[at:at] = (base * rng.randint(2, 9))[: rng.randint(1, 60)]
    return w


@pytest.mark.parametrize("shortest,repeats", [(6, 4), (4, 2), (2, 2), (12, 3)])
def test_runs_of_ids(shortest, repeats):
    rng = random.Random(shortest)
    for _ in range(300):
        texts = [text_with_periods(rng) for _ in range(rng.randint(1, 5))]
        first = np.cumsum([0] + [len(t) for t in texts])
        ids = np.array([i * 1000 + int(w[1:]) for i, t in enumerate(texts) for w in t], dtype=np.int64)
        want = [(int(s + first[i]), n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t, shortest, repeats)]
        assert [tuple(r) for r in runs_of(ids, first, shortest, repeats, ROLLER_A).tolist()] == want


def test_periodic_runs(spark):
    rng = random.Random(3)
    texts = [rng.choice([" ", "\n", "  "]).join(text_with_periods(rng)) for _ in range(120)] + [None, "", " \t", "a", "é " * 7]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "b " * 9)], "doc_id bigint, text string").withColumn("runs", F.lit("x")).repartition(3)
    rows = periodic_runs(docs, keep_text=True).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        w = WORDS.findall((texts[r.doc_id] if r.doc_id is not None else "b " * 9) or "")
        want = plain_runs(w, 6, 4)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.collapsed, r.n_dropped, r.collapsed_sha256) == (kept, len(gone), hashlib.sha256(kept.encode()).hexdigest())
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (tuple(r.best) if r.best else None) == best
    assert periodic_runs(docs.limit(0)).count() == 0


def test_runs_survive_colliding_hashes(monkeypatch, spark):
    """Words that share their hash are told apart by their bytes."""
    monkeypatch.setattr(runs_module, "hash_words", lambda words: (words.end - words.start).astype(np.uint64))
    texts = ["a b c d e f g h", "x y x y x y x y z", "aa " * 6 + "b"]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 0, 0]), pa.array(texts)], names=["doc_id", "text_key", "text"])
    got = [r for out in runs_module._find(6, 4, False)(iter([batch])) for r in out.to_pylist()]
    assert [[tuple(x.values()) for x in r["runs"]] for r in got] == [plain_runs(t.split(), 6, 4) for t in texts]


def test_long_runs_are_linear(spark):
    docs = spark.createDataFrame([(1, "x " * 400_000), (2, " ".join(str(i % 5) for i in range(400_000)))], "doc_id bigint, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs).collect()} == {1: [(0, 400_000, 1)], 2: [(0, 400_000, 5)]}


def test_with_periods(spark):
    texts = [" ".join(f"v{i}" for i in range(n)) for n in range(120)] + [None, " \n"]
    got = {r.doc_id: r.text for r in with_periods(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    changed = 0
    for d, t in enumerate(texts):
        w = WORDS.findall(t or "")
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            changed += 1
        assert WORDS.findall(got[d] or "") == w
    assert changed > 5


def plain_shards(rows, dims, shards):
    """Shard by row index: the tree read off the definition."""
    top = 1 << 50
    word = lambda b: xxhash.xxh64_intdigest(b, 42) >> 1
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    def places(values, number):
        if number:
            lo, hi = min(v for v in values if v is not None), max(v for v in values if v is not None)
            return [0 if v is None else int((v / 2 - lo / 2) / (hi / 2 - lo / 2) * top) + 1 if hi > lo else 1 for v in values]
        return [0 if v is None else signed(xxhash.xxh64_intdigest(v.encode(), 42)) % top + 1 for v in values]
    columns = [places([r[c] for r in rows], number) for c, number in dims]
    spread = [len(set(c)) for c in columns]
    key = [(word((r["text"] or "").encode()), word(r["doc_id"].to_bytes(8, "little", signed=True))) for r in rows]
    size = [len((r["text"] or "").encode()) + 1 for r in rows]
    out = {}

    def descend(members, first, leaves):
        if leaves == 1 or not members:
            out.update({i: first for i in members})
            return
        width = []
        for c, (_, number), n in zip(columns, dims, spread):
            v = [c[i] for i in members]
            width.append((max(v) - min(v)) / top if number else (len(set(v)) - 1) / max(n - 1, 1))
        axis = columns[width.index(max(width))]
        members = sorted(members, key=lambda i: (axis[i], *key[i]))
        goal, at, left = sum(size[i] for i in members) * 2 * (leaves // 2) // leaves, 0, 0
        while left < len(members) and 2 * at + size[members[left]] <= goal:
            at += size[members[left]]
            left += 1
        descend(members[:left], first, leaves // 2)
        descend(members[left:], first + leaves // 2, leaves - leaves // 2)

    descend(list(range(len(rows))), 0, shards)
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_shards(spark, shards, monkeypatch):
    from surveyloom.llm import kd_shards as module
    monkeypatch.setattr(module, "LAST_ROWS", 60)
    monkeypatch.setattr(module, "BUCKETS", 32)
    rng = random.Random(shards)
    copies = "the same text " * 9
    rows = [{"doc_id": d, "text": rng.choice([copies, copies, None, "", "ab " * rng.randint(0, 90)]), "lang": rng.choice(["en", "de", None]), "n": rng.choice([None, rng.randint(0, 99)])} for d in range(400)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["n"], "x", "y") for r in rows], "doc_id bigint, text string, lang string, n int, shard string, row string").repartition(4)
    got, tree = kd_shards(docs, {"lang": F.col("lang"), "n": F.col("n")}, shards=shards)
    got = got.collect()
    want = plain_shards(rows, [("lang", False), ("n", True)], shards)
    assert {r.doc_id: r.shard for r in got} == want
    assert {r.doc_id: (r["_shard"], r["shard"]) for r in tree.shard_of(docs).collect()} == {d: (s, "x") for d, s in want.items()}
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        raw = (rows[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)


def test_shards_awkward(spark):
    docs = spark.createDataFrame([(None, None, None, float("nan"))] * 3 + [(1, "a" * 300_000, "en", float("inf")), (1, "", None, None), (1, "", None, 2.0)], "doc_id bigint, text string, lang string, x double")
    got, _ = kd_shards(docs, {"lang": F.col("lang"), "x": F.col("x")}, shards=4)
    assert got.count() == 6
    assert kd_shards(docs.limit(0), {"lang": F.col("lang"), "x": F.col("x")}, shards=4)[0].count() == 0
    assert kd_shards(docs, {"x": F.col("x")}, target_bytes=100_000)[1].shards == 4


CUTS = re.compile(r"[.,;:!?\x0A-\x0D]")


def plain_collocations(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in CUTS.split(lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i: i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("longest,head,tile,bits", [(3, 1 << 16, 512, 1 << 20), (4, 40, 8, 1 << 8), (2, 0, 512, 64)])
def test_collocations(spark, longest, head, tile, bits, monkeypatch):
    """Few ranks, small tiles and a bitmap with hardly a clear bit change the way, not the result."""
    monkeypatch.setattr(phrases, "TILE", tile)
    monkeypatch.setattr(phrases, "DENSE_TILES", 5)
    rng = random.Random(longest)
    vocabulary = ["the", "The", "of", "cat", "é", "naïve", "x\x00y", "ÀB"] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(["en", "en", "fr", None, ""]), "".join(rng.choice(vocabulary[: rng.choice([4, 38])]) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 90)))) for _ in range(200)]
    rows += [("en", None), ("en", ""), (None, " . "), *[("en", "one phrase that every copy holds in full")] * 60]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int").repartition(3)
    got = collocations(docs, longest=longest, least=10, top=30, head=head, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, longest, 10, 30)
    assert collocations(docs.limit(0)).count() == 0


def test_words_that_share_their_hash(spark, monkeypatch):
    """Were two words to share their hash, they would be counted anew under another one."""
    import pyarrow as pa

    by_value(__name__)
    real, seeds = phrases._count_words, []

    def same_key_first(seed):
        seeds.append(seed)
        inner = real(seed)

        def run(batches):
            for b in inner(batches):
                yield pa.RecordBatch.from_arrays([pa.array([7] * b.num_rows, pa.int64()), *b.columns[1:]], names=b.schema.names) if seed == 0 else b
        return run

    monkeypatch.setattr(phrases, "_count_words", same_key_first)
    rows = [("en", "a b c " * 20)] * 3
    got = collocations(spark.createDataFrame(rows, "lang string, text string"), top=9).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 3, 10, 9) and seeds == [0, 1]
