"""Large regions: Voronoi cells, windows and block pairs against brute force."""

import random

import numpy as np
import pytest

from marlstone.llm import jaccard_join


def sets_of(rows, width):
    return {i: frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for i, w in rows}


def classes_of(sets, num):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sorted(sets):
        for y in sorted(sets):
            both = len(sets[x] & sets[y])
            if x < y and 10 * both >= num * (len(sets[x]) + len(sets[y]) - both) > 0:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_copies(rng, words, size, many, changes):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(many):
        t = list(base)
        for _ in range(rng.choice(changes)):
            t[rng.randrange(size)] = rng.choice(words)
        yield t


@pytest.mark.parametrize("changes", [(0, 1, 2, 4, 6), (9, 10, 11), (3, 4)])
def test_large_regions_are_brute_force(spark, scratch, changes):
    rng = random.Random(len(changes))
    words = [f"w{i}" for i in range(5000)]
    texts = [t for _ in range(2) for t in near_copies(rng, words, 200, 70, changes)]
    passage = [rng.choice(words) for _ in range(60)]
    texts += [[rng.choice(words) for _ in range(90)] + passage for _ in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs, scratch, 5, 8, 10, cell=12).collect()}
    assert got == classes_of(sets_of(rows, 5), 8)


def test_cells_hold_every_linked_pair(spark, scratch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(6) for t in near_copies(rng, words, 120, 40, (0, 1, 2, 3, 5))]
    sets = sets_of(enumerate(texts), 3)
    grams = {i: np.unique(np.array([hash(g) & ((1 << 63) - 1) for g in s], np.uint64)) for i, s in sets.items()}
    rows = [(7, i, 0, len(g), jaccard_join.parity_sketch(g, 160).tolist(), i) for i, g in grams.items()]
    members = spark.createDataFrame(rows, "key long, node long, band int, size long, bits array<long>, component long")
    cells = jaccard_join.voronoi_cells(members, scratch, 9, 10, cell=30, pivots=8, block=50).collect()
    groups = {}
    for r in cells:
        groups.setdefault((r["cell"], r["i"], r["j"]), []).append(r)
    met = {(a["node"], b["node"]) for g in groups.values() for a in g if a["asks"] for b in g if b["answers"]}
    linked = [(x, y) for x in sets for y in sets if x < y and 10 * len(sets[x] & sets[y]) >= 9 * len(sets[x] | sets[y])]
    assert linked and all((x, y) in met or (y, x) in met for x, y in linked)
    assert len(groups) > 1 and len({tuple(sorted(p)) for p in met}) < len(texts) * (len(texts) - 1) / 2  # windows prune
