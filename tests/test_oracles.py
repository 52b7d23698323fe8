"""Every registered query with a SQL twin must give the same rows."""

import pytest
from harness import connect, difference

from tidemill import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, folder, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) is None
