"""List queries see every line of a list."""

from marlstone.operators import merging
from marlstone.plans import merges


def test_same_lists_beyond_two_lines(spark):
    lists = {
        "equal": ([(1, 5), (1, 6), (1, 7), (9000, 8)], [(2, 5), (2, 6), (2, 7), (9001, 8)]),
        "later": ([(1, 5), (1, 6), (1, 7)], [(2, 5), (2, 6), (2, 9)]),
        "moved": ([(1, 5), (9000, 4), (9000, 6)], [(2, 6), (2, 4), (9001, 5)]),
        "longer": ([(1, 5), (1, 5)], [(2, 5), (2, 5), (2, 5)]),
        "only_old": ([(1, 5)], []),
    }
    rows = [(k, t, s, i == 0) for k, both in lists.items() for i, x in enumerate(both) for s, t in x]
    got = merging.same_lists(spark.createDataFrame(rows, "artist string, title long, seq long, old boolean"), "artist", "title", "seq", "old").collect()
    assert {r["artist"]: (r["same_list"], r["same_songs"]) for r in got} == {"equal": (True, True), "later": (False, False), "moved": (False, True), "longer": (False, False)}


def test_diff_has_all_lines(spark, tmp_path):
    spark.sql("SELECT 1L o_orderkey, 1L o_custkey, timestamp_ntz'1997-01-01' o_orderdate UNION ALL SELECT 2L, 1L, timestamp_ntz'1999-01-01'").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(o, t, n) for o in (1, 2) for n, t in enumerate((1, 2, 2 + o, 4), 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r["title"], r["seq"], r["change"]) for r in merges.playlist_diff_whole(spark, str(tmp_path)).collect())
    assert got == [(1, 2, "unchanged"), (2, 2, "unchanged"), (3, 1, "removed"), (4, 2, "unchanged"), (4, 2, "unchanged")]
