"""Every query against its SQL in DuckDB."""

import pytest
from compare import connect, differences

from loomgraph import catalog

SQL = catalog.oracle_sql()
#: Conditions that no row of the smallest tables meets.
MAY_BE_EMPTY = {"data_flow_both", "scoped_hits", "search_logs"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SQL)
def test_query(spark, sf, con, name):
    found = differences(catalog.queries()[name](spark, sf), con, SQL[name])
    assert not found or (found == "no rows" and name in MAY_BE_EMPTY), found


def test_without_sql():
    assert set(catalog.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["depth", "path", "back_edge"]
    assert set(e.oracle_sql()) <= set(e.queries())
