"""Each query against its SQL twin on the smallest tables."""

import pytest

from loomspan import catalog, plans
from tests.oracle import connection, difference

assert plans
SLOW = {"permutation_test_v2"}


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, sf, con, name):
    assert difference(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_runs(spark, sf, name):
    assert len(catalog.QUERIES[name](spark, sf).columns) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
