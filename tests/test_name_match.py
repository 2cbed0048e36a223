"""Names meet keys by equi-joins, and every key is looked for."""

from marlstone.operators import merging
from marlstone.plans import merges


def test_contained_keys_by_brute_force(spark):
    names = ["red bolt", "infrared bolt", "bolt", "aé🙂z", "", "x", None, "boltred", "long " * 30]
    keys = ["red", "bolt", "é🙂", "ng l", "nowhere", "b", None]
    got = merging.exact_then_contained(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string"), "name", "key")
    want = set()
    for n in filter(None, names):
        inside = sorted(k for k in keys if k and k in n)
        if n in keys or inside:
            want.add((n, n, "exact") if n in keys else (n, inside[0], "contains"))
    assert {tuple(r) for r in got.collect()} == want and len(want) == 6
    assert "NestedLoopJoin LeftSemi" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "contains(" not in plan.lower().replace("contains as kind", "")


def test_keys_are_all_suppliers_and_first_words(spark, tmp_path):
    spark.createDataFrame([(1, "Odd part"), (2, "other-part")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "Acme"), (2, "part")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {tuple(r) for r in merges.name_match_whole(spark, str(tmp_path)).collect()}
    assert got == {("odd part", "odd", "contains"), ("other part", "other", "contains"), ("acme", "acme", "exact"), ("part", "part", "exact")}
