"""Rows are dealt into tasks whose number follows the table, with the results of the SQL."""

import duckdb
import pytest

from marlstone import catalog
from marlstone.session import tasks_for


def test_number_of_tasks(spark):
    assert [tasks_for(spark.range(n), 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """Lines and orders with missing keys and flags."""
    base = str(tmp_path_factory.mktemp("odd"))
    li, o = spark.read.parquet(f"{data}/lineitem.parquet"), spark.read.parquet(f"{data}/orders.parquet")
    li.selectExpr(*(f"CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = {n} THEN NULL ELSE {c} END AS {c}" if c in ("l_partkey", "l_returnflag", "l_orderkey") else c for n, c in enumerate(li.columns))).coalesce(1).write.parquet(f"{base}/lineitem.parquet")
    o.selectExpr(*("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey" if c == "o_custkey" else c for c in o.columns)).coalesce(1).write.parquet(f"{base}/orders.parquet")
    return base


@pytest.mark.parametrize("name", ["confidence_badges", "position_histogram_per_set", "position_histogram_running", "snapshot_badges", "play_counts", "modal_position_order"])
def test_dealt_rows_give_what_the_sql_gives(spark, odd, monkeypatch, name):
    from marlstone.operators import setlists as ops
    from marlstone.plans import assembly, setlists

    for m in (ops, assembly, setlists):
        monkeypatch.setattr(m, "tasks_for", lambda df: tasks_for(df, 500))
    df = catalog.queries()[name](spark, odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "12), REPARTITION_BY_NUM" in plan  # 6,000 lines
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    order = [c[0] for c in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.select(order).collect()), key=key) == sorted(want.fetchall(), key=key)
