"""Radius joins, fills and running values against plain Python."""

import math
import random

import pytest

from marlstone.operators import fills, geo
from marlstone.operators.running import in_order, running
from marlstone.scratch import Tables
from pyspark.sql import functions as F


def km(p, q):
    f, g = math.radians(p[0]), math.radians(q[0])
    a = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


@pytest.mark.parametrize("radius", [5, 50, 700, 4000])
def test_radius_join_meets_each_pair_once(spark, radius):
    rng = random.Random(radius)
    place = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), -90.0, 90.0, rng.uniform(53, 54)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179), 180.0, -180.0, rng.uniform(9, 11)]))
    a, b = ([(i, *place()) for i in range(150)] for _ in range(2))
    got = [tuple(r) for r in geo.within_radius(spark.createDataFrame([*a, (900, None, 1.0)], "a long, lat double, lon double"), spark.createDataFrame([*b, (901, 1.0, None)], "b long, lat double, lon double"), radius).collect()]
    want = {(i, j) for i, *p in a for j, *q in b if km(p, q) <= radius}
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} == want and want


def test_names_where_coordinates_are_missing(spark):
    a = spark.createDataFrame([(1, 53.55, 10.0), (2, 48.1, 11.6)], "a long, lat double, lon double")
    names = spark.createDataFrame([(1, "Hamburg"), (1, "harburg"), (2, "München"), (2, ""), (2, None)], "a long, name string")
    b = spark.createDataFrame([(1, 53.6, 10.1, "x"), (2, 0.0, 0.0, "HAMBURG-Harburg"), (3, None, 9.0, "bei München"), (4, 0.0, 9.0, "Hamburg"), (5, 0.0, 0.0, None), (6, None, None, "Ham")], "b long, lat double, lon double, city string")
    assert sorted((r["a"], r["b"], r["km"] is None) for r in geo.near_or_named(a, names, b, 50).collect()) == [(1, 1, False), (1, 2, True), (2, 3, True)]


def test_running_values_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.choice([None, rng.randrange(-9, 99)])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v long")
    placed = Tables(spark, "t").save(in_order(df.repartition(5), ["k", "t", "i"], ranges=7), "placed")
    assert placed.where("k = 'hot'").select("bucket").distinct().count() > 1
    got = running(placed, ["k"], "bucket", ["place"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "x": ("xor", F.col("v"))}).collect()
    want = {}
    for key in ("hot", "b", None):
        s = x = None
        seen = []
        for n, (_, t, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]), 1):
            if v is not None:
                s, x = (s or 0) + v, (x or 0) ^ v
                seen.append(v)
            want[i] = (s, n, max(seen, default=None), min(seen, default=None), x or 0)
    assert {r["i"]: (r["s"], r["n"], r["hi"], r["lo"], r["x"]) for r in got} == want


def test_until_enough_and_whole_groups(spark):
    import datetime as dt

    day = lambda n: dt.date(2026, 1, n)
    rows = [(1, 10, day(9), 1, "A"), (1, 10, day(9), 2, "b"), (1, 11, day(8), 1, "a"), (1, 11, day(8), 2, "C"), (1, 11, day(8), 3, "D"), (1, 12, day(1), 1, "E"), (2, 20, None, 1, "Z")]
    df = spark.createDataFrame(rows, "owner long, group long, day date, nth int, title string")
    take = lambda **kw: sorted((r["owner"], r["rank"], r["title"]) for r in fills.until_enough(df, 3, Tables(spark, "t"), **kw).collect())
    assert take() == [(1, 1, "A"), (1, 2, "b"), (1, 3, "C"), (2, 1, "Z")]
    assert take(whole=True) == [(1, 1, "A"), (1, 2, "b"), (1, 3, "C"), (1, 4, "D"), (2, 1, "Z")]
    assert fills.until_enough(df.limit(0), 3, Tables(spark, "t")).count() == 0


def test_tiers_take_what_is_left(spark):
    tier = lambda rows: spark.createDataFrame(rows, "owner long, id long, nth int")
    out = fills.in_tiers([(tier([(1, 5, 1), (1, 6, 2), (1, 5, 3), (1, 7, 4)]), 2), (tier([(1, 6, 1), (1, 8, 2), (1, 9, 3), (2, 1, 1)]), 3), (tier([(1, i, i) for i in range(20)] + [(2, 1, 1), (2, 2, 2)]), 5)], Tables(spark, "t"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 2, 4), (1, 1, 2, 5), (1, 5, 0, 1), (1, 6, 0, 2), (1, 8, 1, 3), (2, 1, 1, 1), (2, 2, 2, 2)]


def test_places_by_ranges_with_and_without_ties(spark):
    from marlstone.operators.running import places

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", None]), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(4)
    order = [F.asc_nulls_last("v"), "id"]
    own = {r["id"]: r["n"] for r in places(df, ["g"], order, "n", Tables(spark, "t")).collect()}
    shared = {r["id"]: r["n"] for r in places(df, ["g"], order, "n", Tables(spark, "t"), ["v"]).collect()}
    for g in ("a", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [own[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert all(shared[r[2]] == 1 + next(i for i, x in enumerate(mine) if x[1] == r[1]) for r in mine)
