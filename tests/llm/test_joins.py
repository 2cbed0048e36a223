import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import jaccard_join, vector_dedup
from marlstone.llm.shared import components


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark, scratch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 300)]
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(parent, n) for n in parent if n in got} and set(got) >= {n for e in edges if e[0] != e[1] for n in e}
    assert components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("num, den", [(8, 10), (9, 10)])
def test_bands_hold_every_linked_pair(num, den):
    for n in [*range(1, 90), 250, 256, 300, 1000, 5000]:
        for m in range(n, n * den // num + 1):
            most = jaccard_join.allowed(n + m, num, den)
            if m - n <= most and (n != m or most >= 2):
                shared = set(jaccard_join.bands(n, num, den)) & set(jaccard_join.bands(m, num, den))
                assert shared and max(p for _, p in shared) > most


@pytest.mark.parametrize("width, num", [(3, 9), (5, 8)])
def test_jaccard_join_is_brute_force(spark, scratch, width, num):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 2, 3, 8, 12, 16, 20, 30, 60, 120, 300):
        for _ in range(5):
            text = [rng.choice(words) for _ in range(size)]
            texts.append(text)
            for _ in range(8):
                t = list(rng.choice(texts[-9:]))
                for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
                    t[rng.randrange(len(t)) :] = t[rng.randrange(len(t)) :] if rng.random() < 0.1 else [rng.choice(words)] + t[rng.randrange(len(t)) + 1 :] if len(t) > 1 and rng.random() < 0.2 else t[rng.randrange(len(t)) :]
                k = rng.randrange(len(t)) if t else 0
                if t:
                    t[k] = rng.choice(words) if rng.random() < 0.5 else t[k].upper()
                texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, rows_text := "x y"), (9004, "X  Y"), (9005, rows_text)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 10 * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(parent, x), find(parent, y)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, scratch, width, num, 10).collect()}
    assert got == {i: (len(sets[i]), find(parent, i)) for i in sets}


def test_jaccard_join_on_odd_rows(spark, scratch, odd_docs):
    got = jaccard_join.join(odd_docs, scratch).collect()
    assert len(got) == odd_docs.count() and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.join(odd_docs.limit(0), scratch).count() == 0


def test_vectors_are_brute_force(spark, scratch):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            v = rng.standard_normal(16)
            for k in range(rng.integers(1, 6)):
                rows.append([len(rows), (v + rng.standard_normal(16) * 0.04 * k).astype(np.float32).tolist(), label])
    dense = rng.standard_normal(16)
    rows += [[len(rows) + i, (dense + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1] for i in range(300)]
    rows += [[5000 + i, rows[0][1], 0] for i in range(40)]
    rows += [[6000, None, 0], [6001, [0.0] * 16, 0], [6002, [float("nan")] * 16, 0], [6003, [1.0] * 15 + [None], 0], [6004, [1.0] * 15 + [float("inf")], 0], [6005, [1.0] * 8, 0], [6006, [], 0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    good = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = dict.fromkeys((r[0] for r in rows), 0), {r[0]: r[0] for r in rows}
    for x, u, a in good:
        for y, v, b in good:
            if x != y and a == b and len(u) == len(v) and u @ v >= 0.98:
                links[x] += 1
                p, q = find(parent, x), find(parent, y)
                parent[max(p, q)] = min(p, q)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df, scratch).collect()}
    assert got == {i: (links[i], find(parent, i), find(parent, i) == i) for i in links}
    assert vector_dedup.near_duplicates(df.limit(0), scratch).count() == 0
