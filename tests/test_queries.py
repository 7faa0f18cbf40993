import pytest
from oracle import compare

import tidelog.queries as core


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, core.QUERIES[name], core.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
