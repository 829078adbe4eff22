"""Every operator on awkward rows: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import language_id, piece_codec, quality_rules, toxicity
from surveyloom.llm.common import keep_rows
from surveyloom.llm.exact_dedup import exact_dedup
from surveyloom.llm.near_join import near_join
from surveyloom.llm.packing import pack
from surveyloom.llm.substring_dedup import substring_dedup
from surveyloom.llm.token_counts import count_tokens
from surveyloom.llm.url_filter import filter_urls

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, kept string, row string, label string, l_id string, paths string, sender string"
EXTRA = ("x",) * 7
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 4, *EXTRA), (1, "the cat sat on the mat and looked at the dog", "en", "a", 4, *EXTRA),
    (2, "the cat  sat on the mat and looked at the dog", None, None, None, *EXTRA), (3, None, None, "b", None, *EXTRA), (4, "", "en", "b", 0, *EXTRA),
    (5, " \t\n ", "fr", None, 4, *EXTRA), (None, "le chat est sur le tapis avec le chien", "fr", "c", 9, *EXTRA), (None, None, None, None, None, *EXTRA),
    (6, LONG, "en", "c", 1, *EXTRA), (7, "12 34 !!", "de", "c", 1, *EXTRA), (8, "a\x00b \U0001f600 ▁x <s> <|endoftext|>", "de", "c", 1, *EXTRA),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (6, 0, 1, "x"), (None, 1, 1, "x"), (7, None, None, "x")], "doc_id bigint, quality int, toxic int, text string")


OPERATORS = {
    "language": lambda d, lab: language_id.identify(d, language_id.fit(language_id.training_rows(d))),
    "codec": lambda d, lab: piece_codec.decode(piece_codec.encode(d, giant_chars=100_000), "doc_id"),
    "quality": lambda d, lab: quality_rules.judge(quality_rules.document_statistics(d), quality_rules.fit(quality_rules.document_statistics(d), lab)),
    "near": lambda d, lab: near_join(d),
    "exact": lambda d, lab: exact_dedup(d),
    "toxicity": lambda d, lab: toxicity.score_toxicity(d, toxicity.fit(d, toxicity.training_rows(lab))),
    "substring": lambda d, lab: substring_dedup(d),
    "packing": lambda d, lab: pack(d).groupBy("doc_id", "sequence_id", "offset").count(),
    "tokens": lambda d, lab: count_tokens(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://A.Example.ORG/en/1x?q#f", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "x://org", "h"), (5, "x://org/", "h"), (5, "x://org/", "h"),
        (6, "http://b.com/de/", "h"), (7, "http://notcom/de/", "h"), (8, "http://m.ads-track.example.net/", "h"), (9, "http://x.org/y.com/de/", "h"), (10, "http://é.com/fr/é", "h"),
    ], "page_id bigint, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages).collect())
    assert got == [
        (1, "a.example.org", "/en/1x", "example.org/en/1", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "org", "", None, "allow"),
        (5, "org", "/", "org/", "allow"), (5, "org", "/", "org/", "allow"), (6, "b.com", "/de/", "com/de/", "block"), (7, "notcom", "/de/", None, "allow"),
        (8, "m.ads-track.example.net", "/", None, "block"), (9, "x.org", "/y.com/de/", "org/", "allow"), (10, "é.com", "/fr/é", "com/fr/", "allow"),
    ]
    assert filter_urls(pages.limit(0)).count() == 0


def test_exact_groups(docs):
    rows = exact_dedup(docs).collect()
    by = {(r.doc_id, r.group_size): r for r in rows}
    # The longer original stays, then one of the rows with the least id; null, empty and blank texts are equal.
    assert by[(2, 3)].kept and by[(2, 3)].keep_id == 2
    assert [r.kept for r in rows if r.doc_id == 1] == [False, False]
    blank = [r for r in rows if r.group_size == 4]
    assert len(blank) == 4 and [r.doc_id for r in blank if r.kept] == [5]


def test_repeated_rows_keep_one(docs):
    twice = docs.filter("doc_id = 1")
    decisions = exact_dedup(twice)
    assert decisions.filter("kept").count() == 1
    kept = keep_rows(twice, decisions)
    assert kept.count() == 1 and kept.columns == docs.columns


def test_near_links(docs):
    by = {r.doc_id: r for r in near_join(docs.filter("doc_id is not null").withColumn("text", F.col("text"))).collect()}
    assert by[1].n_links == 2 and by[2].n_links == 2 and by[2].class_id == 1
    assert by[3].n_links == 0 and by[3].class_id == 3 and by[7].n_links == 0


def test_unknown_language(docs):
    by = {r.doc_id: r for r in OPERATORS["language"](docs, None).collect()}
    assert {by[i].lang_pred for i in (3, 4, 5, 7)} == {"und"} and by[1].lang_pred in ("en", "fr", "de")
