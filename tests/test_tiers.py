"""Tiers by conditions: one reading of the rows, owners of many rows in shares, and what the SQL gives on odd rows."""

import random

import duckdb
import pytest

from marlstone import catalog
from marlstone.operators import fills
from marlstone.scratch import Tables
from pyspark.sql import functions as F


def plain(rows, tiers):
    """The tiers of one owner after another."""
    out = []
    for owner in {r[0] for r in rows}:
        given = []
        for n, (flag, most) in enumerate(tiers):
            first = {}
            for o, i, at, flags in rows:
                if o == owner and flag in flags:
                    first[i] = min(first.get(i, (True, 0)), (at is None, at or 0))
            new = [i for i in sorted(first, key=lambda i: (first[i], i)) if i not in given]
            new = new[: max(0, most - len(given))]
            out += [(owner, i, n, len(given) + k) for k, i in enumerate(new, 1)]
            given += new
    return sorted(out)


@pytest.mark.parametrize("share", [20, 4096])
def test_owners_in_shares(spark, monkeypatch, share):
    monkeypatch.setattr(fills, "SHARE", share)
    rng = random.Random(share)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.randrange(60), rng.choice([None, *range(30)]), "".join(f for f in "abc" if rng.random() < 0.5)) for _ in range(400)]
    tiers = [("a", 4), ("b", 3), ("c", 40), ("a", 45)]
    df = spark.createDataFrame(rows, "owner long, id long, nth int, flags string")
    out = fills.tiers_of(df, [(F.col("flags").contains(f), most) for f, most in tiers], Tables(spark, "t"))
    assert ("_share" in out._jdf.queryExecution().analyzed().toString()) == (share == 20)
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, tiers)


def test_odd_rows_give_what_the_sql_gives(spark, data, tmp_path):
    li, o, p = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    odd = {"l_suppkey": "l_partkey % 3 = 0", "l_returnflag": "l_partkey % 5 = 0", "l_quantity": "l_partkey % 7 = 0"}
    li.selectExpr(*(f"CASE WHEN {odd[c]} THEN NULL ELSE {c} END AS {c}" if c in odd else c for c in li.columns)).write.parquet(f"{tmp_path}/lineitem.parquet")
    o.selectExpr(*("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey" if c == "o_custkey" else c for c in o.columns)).write.parquet(f"{tmp_path}/orders.parquet")
    p.write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.queries()["track_fill"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.select("owner", "id", "tier", "rank").collect()), key=key)
    assert got == sorted(con.execute(catalog.oracle_sql()["track_fill"]).fetchall(), key=key)
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
