"""Every llm query on the smallest tables against its SQL."""

import os

import pytest
from oracle import DATA, compare, connect

from lexoria.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    compare(spark, connect(), QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
