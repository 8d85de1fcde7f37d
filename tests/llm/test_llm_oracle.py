"""Queries with SQL give the same rows as that SQL."""

import oracle
import pytest

from staylens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = oracle.connect(FOLDER)
    assert oracle.difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()
