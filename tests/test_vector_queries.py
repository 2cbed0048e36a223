"""Vector search by every query, and what is built on it, against brute force."""

import math
import random

import pytest

from marlstone.operators import retrieval, vector_index
from marlstone.plans import retrieval as plans
from marlstone.scratch import Tables


def cosine(a, b):
    n = math.hypot(*a) * math.hypot(*b)
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def nearest(rows, q, k):
    return [i for _, i in sorted((-round(cosine(v, q), 9), i) for i, v in rows if v is not None)[:k]]


def clustered(seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(n)]
    return rows + [(1000, None), (1020, [0.0] * 6), (1021, [0.0] * 6), (1040, list(rows[3][1])), (1041, list(rows[3][1]))]


@pytest.mark.parametrize("lists", [1, 3, 9])
def test_inverted_file_is_exact(spark, lists):
    rows = clustered(lists)
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    rows = [(r["id"], r["v"]) for r in df.collect()]  # as floats
    found = vector_index.InvertedFile(df, Tables(spark, "t"), lists=lists, rows=37)
    got = {}
    for r in found.nearest(df.where("id % 20 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["vrank"]] = r["id"]
    assert set(got) == {i for i, v in rows if v is not None and i % 20 == 0}
    for i, v in rows:
        if i in got:
            assert [got[i][n] for n in (1, 2, 3, 4)] == nearest(rows, v, 4)


def test_clusters_spare_lists(spark):
    df = spark.createDataFrame([r for r in clustered(1) if r[0] < 1000], "id long, v array<float>")
    asked = []

    class Counting(vector_index.Lists):
        def nearest(self, queries, k):
            asked.append(queries.count())
            return super().nearest(queries, k)

    found = vector_index.InvertedFile(df, Tables(spark, "t"), lists=5)
    found.lists.__class__ = Counting
    assert found.nearest(df.where("id % 20 = 0"), 4).count() == 80
    assert asked[0] == 20 and asked[1] < 20 * 4 / 2  # of four other lists each


def test_no_cross_join_and_no_broadcast_of_vectors(spark, data):
    plan = plans.vector_topk_whole(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "ResolvedHint (strategy=broadcast)" not in plan


def test_no_query_row(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert plans.vector_topk(spark, str(tmp_path)).count() == plans.vector_topk_whole(spark, str(tmp_path)).count() == 0
    assert plans.memory_recall_whole(spark, str(tmp_path)).count() == 0


def test_recall_by_all_ways(spark):
    rng = random.Random(4)
    memories = [(o, 100 * o + i, [rng.gauss(0, 1) for _ in range(3)] if o != 3 else None) for o, n in ((1, 5), (2, 30), (3, 30)) for i in range(n)]
    asks = [(100 * o + i, o, [rng.gauss(0, 1) for _ in range(3)]) for o in (1, 2, 3) for i in (0, 1)] + [(900, 9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(memories, "owner long, id long, v array<double>")
    got = {}
    for r in retrieval.recall_all(df, spark.createDataFrame(asks, "id long, owner long, v array<double>"), 4, Tables(spark, "t"), whole=10).collect():
        got.setdefault(r["query_id"], []).append((r["how"], r["place"], r["id"]))
    for q, o, v in asks:
        own = [(i, x) for p, i, x in memories if p == o]
        if o == 9:
            assert q not in got
        elif o == 1:
            assert sorted(got[q], key=lambda r: r[2]) == [("all", None, i) for i, _ in own]
        elif o == 2:
            assert sorted(got[q]) == [("near", n + 1, i) for n, i in enumerate(nearest(own, v, 4))]
        else:
            assert sorted(got[q]) == [("newest", n + 1, i) for n, i in enumerate(sorted((i for i, _ in own), reverse=True)[:4])]
