import pytest

from keelson import registry

from .oracle import same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, registry.queries()[name], registry.oracle_sql()[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).collect()[0]["matches"] == 6000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
