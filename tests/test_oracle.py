"""Every registered query against its SQL; the others must return rows."""

import oracle
import pytest

from staylens.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = oracle.connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_entry_points():
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
