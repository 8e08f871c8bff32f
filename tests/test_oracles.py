"""Every core query on the smallest tables against its SQL."""

import os
from importlib import import_module

import pytest
from oracle import DATA, compare, connect

import __spark_entry__ as entry

MODULES = [import_module(m) for m in entry.CORE]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "word", "seq"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
