"""Queries with SQL give the SQL's rows."""

import pytest

from marlstone.llm import queries
from oracle import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, data, name):
    assert rows_of(queries.queries()[name](spark, data)) == sql_rows(connect(data), queries.oracle_sql()[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
