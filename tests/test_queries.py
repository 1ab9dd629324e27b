import pytest
from oracle import check

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    check(spark, SF, registry.QUERIES[name], registry.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.SQL) <= set(e.oracle_sql()) and set(registry.QUERIES) <= set(e.queries())
