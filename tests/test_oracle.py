import pytest

from flowloom.plans import registered

from . import oracle


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    oracle.check(spark, registered.QUERIES[name], registered.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[-3:] == ["bytes", "packets", "flows"]
    assert out.count() > 0
