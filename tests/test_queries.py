"""Every registered query of the engine against its DuckDB twin."""

import pytest
from oracle import DATA, compare, connect

from docloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        compare(df, ORACLES[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(entry.queries())
