import pytest

from lectern import registry
from tests.oracle import connect, expected, rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    columns, found = rows(registry.QUERIES[name](spark, sf))
    assert columns
    if name in registry.ORACLES:
        assert (columns, found) == expected(connect(sf), registry.ORACLES[name])
    else:
        assert found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())
