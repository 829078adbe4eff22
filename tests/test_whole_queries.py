"""Queries without SQL that describe every column, try every trial and fit every target."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from surveyloom.queries import QUERIES
from surveyloom.queries.schema import TABLES, sampled_columns

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_column_is_described_by_samples(spark):
    rows = sampled_columns(spark, FOLDER).collect()
    want = [(t, i, c) for t in TABLES for i, c in enumerate(spark.read.parquet(f"{FOLDER}/{t}.parquet").columns)]
    assert sorted((r["table"], r.position, r["column"]) for r in rows) == sorted(want)
    assert {len(r.sample_embs) for r in rows} == {4}


def test_every_column_is_matched_or_reported(spark):
    got = QUERIES["match_columns"](spark, FOLDER).collect()
    for pair, side, t in (("customer>supplier", "column_a", "customer"), ("part>orders", "column_b", "orders")):
        assert {r[side] for r in got if r.pair == pair and r[side]} == set(spark.read.parquet(f"{FOLDER}/{t}.parquet").columns)


def test_sweep_tries_the_whole_grid(spark):
    got = QUERIES["sweep"](spark, FOLDER).agg(F.countDistinct("trial").alias("trials"), F.max("n").alias("n"), F.max("accuracy").alias("best")).first()
    assert got.trials == 729 and got.n == 15 and got.best > 0.3


def test_forest_covers_all_targets(spark):
    got = QUERIES["forest_adoption"](spark, FOLDER).collect()
    targets = {"has_emissions_target", "has_netzero_target", "has_internal_carbon_price", "has_renewable_initiative"}
    assert {r.target for r in got} == targets
    for t in targets:
        value = {r.measure: r.value for r in got if r.target == t}
        assert {"accuracy", "precision", "recall", "f1"} <= set(value)
        importances = {m.removeprefix("importance "): v for m, v in value.items() if m.startswith("importance ")}
        assert sum(importances.values()) == pytest.approx(1.0)
        assert {"year", "specificity"} <= set(importances) and all(any(c in f for f in importances) for c in ("sector", "region", "sentiment", "tcfd"))
        assert {f"adoption {y}" for y in range(1995, 2005)} <= set(value)
