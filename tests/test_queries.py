"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import oracle_check
from surveyloom.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = {"cluster_profile", "feature_projection", "forest_adoption"}

# No name is repeated often enough on the smallest tables.
MAY_BE_EMPTY = {"eda_redundant"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) / len(QUERIES) > 0.85


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SLOW:
        assert QUERIES[name](spark, FOLDER).limit(1).count() == 1
        return
    n, problem = oracle_check.compare(spark, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert problem is None
    assert n > 0 or name in MAY_BE_EMPTY
