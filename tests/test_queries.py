"""Every registered query against its SQL on the driver's tables."""

from __future__ import annotations

import pytest

from tapewright import plans

from .oracle import DATA, database, difference

SF = "sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(QUERIES[name](spark, str(DATA / SF)), con.execute(ORACLES[name]).fetch_df()) == ""


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
