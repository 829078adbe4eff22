"""Operators against brute force, libraries and round trips on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surveyloom.llm import language_id, near_join as near_module, piece_codec, quality_rules, substring_dedup as substring_module, toxicity
from surveyloom.llm.common import keep_rows
from surveyloom.llm.exact_dedup import exact_dedup, rice_decode, rice_encode
from surveyloom.llm.graph import components
from surveyloom.llm.near_join import least_equal, near_join, shared_shingles
from surveyloom.llm.packing import best_fit, cut, pack
from surveyloom.llm.substring_dedup import substring_dedup
from surveyloom.llm.token_counts import count_tokens
from surveyloom.llm.tokens import tokenizer_path
from surveyloom.llm.url_filter import Automaton, globs_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_with_copies(seed: int, n: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijé", k=rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        kind = i % 6
        if kind == 1 and out:
            words = WORDS.findall(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 2:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20):]
        elif kind == 3:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))] * rng.randint(1, 30)
        out.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in words))
    return out


@pytest.fixture(scope="module")
def texts():
    return texts_with_copies(1) + ["", " ", "one", "x " * 40]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize("k", [5, 35])
def test_substring(docs, texts, k):
    words = [WORDS.findall(t) for t in texts]
    seen = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    got = {r.doc_id: r for r in substring_dedup(docs, k=k).collect()}
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_near_join(docs, texts):
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(WORDS.findall, texts)]
    links, root = Counter(), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join(docs).collect()}
    assert got == {d: (root[d], links[d]) for d in range(len(texts))}


def test_chained_rows_are_components_of_surviving_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (4, 128), dtype=np.uint8)
    codes = base[rng.integers(0, 4, 90)].copy()
    codes[rng.random(codes.shape) < 0.3] = 7
    least = least_equal(0.8, 1e-6)
    root = np.arange(len(codes))
    linked = [(i, j) for i in range(90) for j in range(i) if all((codes[i, :n] == codes[j, :n]).sum() >= least[n] for n in range(16, 129, 16))]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if root[i] != root[j]:
                root[[i, j]], changed = min(root[i], root[j]), True
    assert 4 <= len(set(root.tolist())) < 90
    assert near_module.chained(codes, 0.8, 1e-6).tolist() == root.tolist()


def test_chance_bands_do_not_gather(spark, monkeypatch):
    """Texts that share bands but are not near are no component; links are those of a brute-force comparison."""
    monkeypatch.setattr(near_module, "BUCKET_BLOCK", 8)
    rng = random.Random(11)
    texts, now = [], [f"w{i}" for i in range(60)]
    for step in range(80):
        # Each text keeps about half of the shingles of the one before, every fourth nearly all.
        now = [w if rng.random() > (0.005 if step % 4 == 3 else 0.07) else f"n{step}_{i}" for i, w in enumerate(now)]
        texts.append(" ".join(now))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(56)} for t in texts]
    want = [sum(1 for j in range(80) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(80)]
    sizes = []
    gathered = near_module.components

    def noted(edges):
        found = gathered(edges)
        sizes.append(found.groupBy("root").count().agg({"count": "max"}).first()[0] or 0)
        return found

    monkeypatch.setattr(near_module, "components", noted)
    got = {r.doc_id: r.n_links for r in near_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(80)] == want
    assert sizes[0] < 20


def test_near_join_split_group(spark, monkeypatch):
    """A group over several blocks, and dense verification, find every link."""
    from surveyloom.llm import near_join as module

    monkeypatch.setattr(module, "BLOCK_WEIGHT", 8)
    monkeypatch.setattr(module, "DENSE_PAIRS", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[rng.randrange(120)] = f"v{rng.random()}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert set(got.values()) == {(0, 39)}


def test_pruning_table_and_shared_shingles():
    least = least_equal(0.8, 1e-6)
    assert least[16] > 0 and least[128] > 70 and (np.diff(least[1:]) >= 0).all()
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, 120).astype(np.uint64)) for _ in range(80)]
    p, q = np.nonzero(np.ones((80, 80)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(p, q)]
    assert shared_shingles(sets, sets, p, q).tolist() == want
    assert shared_shingles(sets, sets, p[:50], q[:50]).tolist() == want[:50]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges * 40:
        if a in root and b in root:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == root


def test_exact_dedup(docs, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t) for t in texts]
    groups = {}
    for d, t in enumerate(norm):
        groups.setdefault(t, []).append(d)
    for r in exact_dedup(docs, owners=3).collect():
        members = groups[norm[r.doc_id]]
        keep = min(members, key=lambda d: (-len(texts[d]), d))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(members), r.doc_id == keep, hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert keep_rows(docs, exact_dedup(docs)).count() == len(groups)


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_golomb_code(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (rice_decode(rice_encode(values)) == values).all()
    assert n < 1000 or len(rice_encode(values)) < 8 * n


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = pack(docs, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for d, t in enumerate(texts):
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        total += len(ids)
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in pieces] == list(cut(len(ids), 64))
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()) for r in pieces]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= 1.1 * total / 64 + 2
    assert sorted(i for b in best_fit([5, 5, 3, 3, 2, 2], 10) for i in b) == list(range(6)) and len(best_fit([5, 5, 3, 3, 2, 2], 10)) == 2


def test_special_texts_tokenise_like_the_library(spark):
    from tokenizers import Tokenizer

    special = ["<|endoftext|>a <|endoftext|>", "naïve café’s — “x” 你好 \u200d ﬁ", "it's\n\n  x\t\ty  ", "\x1c\x85\xa0 z", "١٢ ½ Ⅷ"]
    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack(spark.createDataFrame(list(enumerate(special)), "doc_id bigint, text string")).collect()}
    for d, t in enumerate(special):
        ids = model.encode(t, add_special_tokens=False).ids + [2]
        assert got[d] == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def test_token_counts(spark, texts):
    import sentencepiece

    special = ["<s> </s> <unk>", "  a  b ", "▁a▁ b", "\x00 x\u3000y", " ", "你好 world", "a" * 5000, "<0x0A> \n\n"]
    values = texts + special
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string"), limit=100).collect()}
    for d, t in enumerate(values):
        n = len(model.encode(t))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 100)


@pytest.fixture(scope="module")
def unigram():
    """The library itself, told to read the model as a unigram model with the same scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    least = min(p.score for p in proto.pieces if p.score > -1e8)
    for p in proto.pieces:
        if p.score < -1e8:
            p.score = least - 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_codec(spark, texts, unigram):
    values = texts + ["  the  quick é you👍 x", "a" * 300, "\x00b", "the end", *("ab" + " " * n + "cd ef" for n in (1, 14, 15, 16, 17, 20, 33, 40)), " " * 50, "the" + " " * 31]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
    whole = {r.doc_id: r.ids for r in piece_codec.encode(frame).collect()}
    chunked = {r.doc_id: r.ids for r in piece_codec.encode(frame, giant_chars=20, chunk_chars=17, block_chunks=3).collect()}
    for d, t in enumerate(values):
        if not any(c in t for c in "👍\x00"):
            assert whole[d] == unigram.encode(t)
        assert chunked[d] == whole[d]
    for encoded in (piece_codec.encode(frame), piece_codec.encode(frame, giant_chars=20, chunk_chars=17, block_chunks=3)):
        assert {r.doc_id: r.text for r in piece_codec.decode(encoded, "doc_id").collect()} == dict(enumerate(values))


def test_statistics(texts):
    got = quality_rules.text_statistics(pa.array(texts + ["a\nb\na\na \n\n\n", "x#y |&\nÉ"]))
    for i, t in enumerate(texts + ["a\nb\na\na \n\n\n", "x#y |&\nÉ"]):
        words, lines, dup = WORDS.findall(t), set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in lines
                lines.add(line)
        seen = Counter(tuple(words[j:j + 8]) for j in range(len(words) - 7))
        repeat = [False] * len(words)
        for j in range(len(words) - 7):
            if seen[tuple(words[j:j + 8])] > 1:
                repeat[j:j + 8] = [True] * 8
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(repeat), len(set(words)))
        assert tuple(got[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")) == want


def test_rules_find_thresholds():
    rng = np.random.default_rng(4)
    x = {"n_words": rng.uniform(0, 1000, 3000), "upper_share": rng.uniform(0, 1, 3000)}
    bad = (x["upper_share"] >= 0.7) & (x["n_words"] >= 300)
    rules = quality_rules.learn_rules(x, bad, rng.random(3000) < 1 / 3)
    said = np.zeros(3000, dtype=bool)
    for rule in rules:
        said |= quality_rules._covered(rule, x, 3000)
    assert (said == bad).mean() > 0.98


def test_maximal_segments():
    """Against the definition: split off the best segment, then both sides."""
    def plain(s, at=0):
        best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (x[0], -(x[2] - x[1])), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        v, i, j = best
        return plain(s[:i], at) + [(at + i, at + j, v)] + plain(s[j:], at + j)

    rng = random.Random(5)
    for _ in range(200):
        s = [rng.choice([-3, -2.5, -1, 1.25, 2, 4.5]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(s)]
        assert np.allclose([v for _, _, v in got], [v for _, _, v in plain(s)])


def test_label_words_is_viterbi():
    rng = np.random.default_rng(6)
    counts = np.array([4, 0, 1, 6])
    scores = rng.normal(0, 2, (int(counts.sum()), 3))
    prior = np.array([0.1, 0.2, 0.3])
    got = language_id.label_words(scores, counts, prior, 1.5)
    at = 0
    for n in counts:
        s = scores[at: at + n]
        if n:
            value = lambda p: prior[p[0]] + sum(s[i, p[i]] for i in range(n)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert value(got[at: at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))
        at += n


def test_automaton_many_words():
    rules = tuple(("block", f"h{i}.example", f"/p{i}/") for i in range(20))
    automaton = Automaton(globs_of(rules, ("*.exe", "a*/b*c")))
    assert automaton.words > 3
    hit = automaton.run([b"x.h7.example\0/p7/q", b"h7.example\0/p8/", b"n.net\0/a.exe", b"aXX\0/bYc", b"aXX\0/bYcd", b"\0"])
    assert [sorted({int(r) for r, h in zip(automaton.rules, row) if h}) for row in hit] == [[7], [], [-1], [-1], [], []]


def test_words_are_laid_out_in_small_parts(monkeypatch):
    """A batch of longer texts is laid out a megabyte at a time, with the same results."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5_000)], k=40_000)) for _ in range(12)]
    laid_out = []
    split = substring_module.split_words

    def noted(some):
        laid_out.append(sum(len(t) for t in some.to_pylist()))
        return split(some)

    monkeypatch.setattr(near_module, "split_words", noted)
    monkeypatch.setattr(substring_module, "split_words", noted)
    numbers, text = pa.array(range(12), pa.int64()), pa.array(texts)
    sets = [*near_module._shingles(5)([pa.RecordBatch.from_arrays([text, numbers, numbers, numbers, numbers, text], names=list("abcdef"))])]
    assert sum(b.num_rows for b in sets) == 12
    cut_rows = [*substring_module._cut(35, "text", False)([pa.RecordBatch.from_arrays([numbers, text, pa.nulls(12), numbers], names=list("abcd"))])]
    assert [t for b in cut_rows for t in b.column(5).to_pylist()] == texts
    whole = substring_module.paths_of(split(text), 35, 8)
    parts = [np.concatenate(p) for p in zip(*substring_module._paths_by_parts(text, 35, 8))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(parts[0]) > 12
    assert max(laid_out) <= 1_000_000


def test_cutting_holds_one_python_worker(docs, capsys):
    """No task tests marks in one Python worker and handles texts in another."""
    substring_dedup(docs).explain()
    above = []
    for line in capsys.readouterr().out.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, n) for d, n in above if d < depth] + [(depth, line)]
        if "ArrowEvalPython" in line:
            since = max([i for i, (_, n) in enumerate(above) if "Exchange" in n], default=0)
            assert not any("MapInArrow" in n for _, n in above[since:])
