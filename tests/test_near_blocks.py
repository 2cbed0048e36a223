"""Rows at the same place, or of the same name, meet as blocks and become pairs without a shuffle."""

import random
from collections import Counter

import pytest
from test_geo_and_fills import km

from marlstone.operators import geo


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK", 3), ("NAMED", 3), ("SHARE", 5), ("PAIRS", 200)):
        monkeypatch.setattr(geo, name, n)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_at_few_places(spark, small):
    rng = random.Random(4)
    at = [(53.5, 10.0), (53.6, 10.1), (48.1, 11.6), (-0.0, 180.0), (0.0, -179.9), (None, 1.0)]
    a, b = ([(i if i % 10 else None, *rng.choice(at)) for i in range(1, 120)] for _ in range(2))
    df = geo.within_radius(spark.createDataFrame(a, "a long, lat double, lon double"), spark.createDataFrame(b, "b long, lat double, lon double"), 50, 6)
    want = [(i, j, round(km(p, q), 6)) for i, *p in a for j, *q in b if p[0] is not None and q[0] is not None and km(p, q) <= 50]
    plan = _plan(df)  # before it runs
    assert Counter(tuple(r) for r in df.collect()) == Counter(want) and len(want) > 1000
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.index("explode(_bs") < plan.index("explode(_as") < plan.index("Exchange")
    assert geo._tasks(10001) == 51 and geo._tasks(None) == 1


def test_many_rows_of_few_names(spark, small):
    names = [(i if i else None, n) for i in range(40) for n in (["Hamburg", "burg "] if i % 3 else ["Bonn", None, ""])]
    cities = [(j if j else None, c) for j in range(30) for c in (["HAMBURG", "bei Hamburg"] if j % 2 else ["Bonn-Hamburg", None])]
    df = geo.by_name(spark.createDataFrame(names, "a long, name string"), spark.createDataFrame(cities, "b long, city string"))
    want = {(a, b) for a, n in names if (n or "").strip() for b, c in cities if c and n.strip().lower() in c.lower()}
    assert Counter(tuple(r) for r in df.collect()) == Counter(want) and len(want) > 300
    assert "Aggregate" not in _plan(df)[: _plan(df).index("explode(_as")]


def test_near_query_rounds_before_rows_are_made(spark, data):
    from marlstone import catalog

    plan = _plan(catalog.queries()["suppliers_near"](spark, data))
    assert plan.index("explode(_as") < plan.index("round(")
