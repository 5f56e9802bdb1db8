import pytest

from cladeforge import registry
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, same, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    frame = registry.QUERIES[name](spark, DATA)
    assert frame.count() > 0
    assert len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
