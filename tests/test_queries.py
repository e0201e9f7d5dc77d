"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from attestra import catalog
from tests.compare import of_duckdb, of_spark

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, rows = of_spark(df)
    assert names
    if name in SQL:
        assert (names, rows) == of_duckdb(sf_dir, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
