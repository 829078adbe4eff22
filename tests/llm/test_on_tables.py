"""The registered queries on the smallest tables: SQL where there is some, held-out accuracy elsewhere."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle_check
from surveyloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    n, problem = oracle_check.compare(spark, FOLDER, name, QUERIES[name], ORACLE[name])
    assert problem is None and n > 0


def test_all_registered():
    assert [name.split("_")[0] for name in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, LARGER).join(docs, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_quality(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op3_quality_rules"](spark, LARGER).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


def test_toxicity_held_out(spark):
    """Most labels of rows that were not learned from, and few false alarms."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op6_toxicity"](spark, LARGER).filter("held_out").join(labels, "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert sum(r.predicted for r in clean) / len(clean) < 0.03 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_pipeline(spark, tmp_path):
    """Against a plain version of each stage's decision, on the rows the stage got."""
    import re

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == columns
        kept.append(({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: getattr(r, "text", None) for r in out.collect()}))
        docs = out
    before, after = kept[1]
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in before.items()}
    best = {}
    for d, t in norm.items():
        if t not in best or (-len(before[d] or ""), d) < (-len(before[best[t]] or ""), best[t]):
            best[t] = d
    assert set(after) == set(best.values())
    before, after = kept[2]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, w in ((d, (t or "").split()) for d, t in before.items())}
    for d in set(before) - set(after):
        assert any(len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in before if e != d)
    alive = sorted(after)
    for x, a in enumerate(alive):
        for b in alive[x + 1:]:
            assert not sets[a] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    before, after = kept[3]
    assert set(before) == set(after)
    before, after = kept[4]
    assert set(before) == set(after)
