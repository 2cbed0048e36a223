"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from marlstone import catalog

from oracle import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    assert rows_of(df) == sql_rows(connect(data), sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
