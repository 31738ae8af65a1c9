"""Every query against its SQL on the smallest test tables."""

import pytest

from tessella.plans import ORACLE_SQL, QUERIES
from tests.conftest import bag


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, small, duck):
    got, expected = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert bag(got, columns) == bag(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_imports(spark, small):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
