"""Rules that hold for whole texts and every label, whatever the texts open with."""

from __future__ import annotations

import pytest

from surveyloom.llm import toxicity


@pytest.mark.parametrize("words", [0, 12])
def test_toxicity_counts_texts_not_openings(spark, words):
    banner = "".join(f"banner{i} " for i in range(words))
    bodies = [f"tail{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} rest of it" for i in range(40)]
    rows = [(i, banner + b) for i, b in enumerate(bodies)] + [(100 + i, (banner + b).upper().replace(" ", "\t ")) for i, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 100 % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    clean, toxic = toxicity.fit(docs, labels).tables
    assert (clean[0, -1], toxic[0, -1]) == (30, 10)


def test_long_white_space_is_encoded(spark):
    """As the library does it, where the fast pattern would run out of stack."""
    from tokenizers import Tokenizer

    from surveyloom.llm.tokens import byte_bpe, tokenizer_path

    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    library, encode = Tokenizer.from_file(paths[0]), byte_bpe(*paths)
    for text in ("a" + " " * 1_500_000 + "b", "x " + "\n" * 50_000 + "y", "a" + " " * 9_999 + "b", " " * 20_000):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_goes_to_the_root(spark, monkeypatch):
    """However small the groups, one bin at most is left half empty."""
    from surveyloom.llm import packing

    monkeypatch.setattr(packing, "GROUP_ITEMS", 4)
    docs = spark.createDataFrame([(i, "word " * (5 + i * 7 % 60)) for i in range(300)], "doc_id bigint, text string").repartition(40)
    rows = packing.pack(docs, capacity=64).collect()
    fill: dict = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(f <= 32 for f in fill.values()) <= 1 and max(fill.values()) <= 64
    assert sorted({r.doc_id for r in rows}) == list(range(300))


def test_unlearned_scripts_are_rejected(spark):
    import corpus_pipeline

    rows = [(i, f"the quick fox {i} and the dog of the house", "en", 1) for i in range(30)] + [(i, f"le chat {i} et le chien de la maison", "fr", 1) for i in range(30, 60)]
    rows += [(100, "быстрая лиса прыгает через собаку", None, 1), (101, "the dog собака and the fox of the house", None, 1), (102, "12 !!", None, 1), (103, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == set(range(60)) | {101}


def test_rules_outside_ascii(spark):
    from surveyloom.llm.url_filter import filter_urls

    urls = ["http://é.com/x", "http://a.é.com/", "http://例.com/y", "http://a.com/é/z", "http://a.com/e/z", "http://b.org/naïve.pdf", "http://b.org/naive.pdf"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = (("block", "é.com", "/"), ("block", "例.com", "/"), ("block", "A.com", "/é/"))
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules=rules, defaults=("*/naï*",)).collect()}
    assert got == {0: ("é.com/", "block"), 1: ("é.com/", "block"), 2: ("例.com/", "block"), 3: ("A.com/é/", "block"), 4: (None, "allow"), 5: (None, "block"), 6: (None, "allow")}


def test_language_pass_holds_little(spark):
    """Memory of a task does not grow with the bytes of a batch beyond the texts themselves."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from surveyloom.llm import language_id as lid

    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3_000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(2_400)]
    table = lambda rows: np.zeros((rows, 5), dtype=np.float32)
    model = lid.LanguageModel(list("abcde"), table(lid.BUCKETS), table(lid.BUCKETS), np.ones((len(lid.SCRIPTS), 5), dtype=bool), np.zeros(5))
    shared = type("Shared", (), {"value": model})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
    lid._tables()
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in lid._predict(shared, lid.SWITCH_PENALTY, "text", False)(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()
