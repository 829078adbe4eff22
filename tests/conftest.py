from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from surveyloom.session import build_session

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from surveyloom.session import remove_intermediate

    remove_intermediate(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small hand-written frames: frame(schema, rows)."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def by_value(module_name):
    """Let workers get a test module's functions by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
