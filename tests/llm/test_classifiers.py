import zlib

import numpy as np
import pyarrow as pa

from marlstone.llm import queries, quality_model, toxicity


def test_trees_learn_a_rule_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = quality_model.fit(x, y)
    assert ((m.scores(x) > 0.5) == y).mean() > 0.97
    one = m.feature, m.threshold, m.leaf
    row = x[7]
    total = m.base
    for f, t, leaf in zip(*one):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + (row[f[node]] > t[node])
        total += leaf[node - len(f)]
    assert abs(m.margins(x[7:8])[0] - total) < 1e-9
    assert quality_model.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 17))).tolist() == [0.5, 0.5]


def test_swaps_do_not_change_scores():
    """Without the penalty a group's name that goes with the label carries weight; with it, it does not."""
    texts = [f"the muslim neighbours are idiot number {i}" for i in range(40)] + [f"the christian neighbours are kind number {i}" for i in range(40)]
    texts += [f"idiot things {i}" for i in range(20)] + [f"kind things {i}" for i in range(20)]
    y = np.array([1.0] * 40 + [0.0] * 40 + [1.0] * 20 + [0.0] * 20)
    names = sorted({f for t in texts for f in toxicity.features_in(t)})
    number = {f: i for i, f in enumerate(names)}
    ids = lambda fs: np.array(sorted(number[f] for f in fs if f in number), np.int64)
    rows = [ids(toxicity.features_in(t)) for t in texts]
    swaps = [(ids(a - b), ids(b - a)) for t in texts for a, b in toxicity.swaps_in(t)]
    probe = pa.array(["the muslim neighbours", "the christian neighbours", "such an idiot"])
    free = toxicity.fit(rows, y, names, []).scores(probe)
    fair = toxicity.fit(rows, y, names, swaps).scores(probe)
    assert abs(free[0] - free[1]) > 0.2 > 0.05 > abs(fair[0] - fair[1]) and fair[2] > 0.5


def test_held_out_accuracy_and_contract(spark):
    data = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for name, label, least in (("op3_toxicity", "toxic", 0.85), ("op7_quality_trees", "quality", 0.95)):
        got = queries.queries()[name](spark, data).collect()
        assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
        right = [r["predicted"] == labels[r["doc_id"]][label] for r in got if r["held_out"] and r["doc_id"] in labels]
        assert np.mean(right) > least


def test_odd_rows(spark, scratch, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, None), (6, 0, 0), (6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for ls in (labels, none):
        q = quality_model.score(odd_docs, quality_model.train(odd_docs, ls), keep=odd_docs.columns)
        t = toxicity.score(odd_docs, toxicity.train(odd_docs, ls, scratch))
        assert q.columns == [*odd_docs.columns, "score"]
        for df in (q, t):
            assert df.count() == odd_docs.count() and df.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(odd_docs.limit(0), toxicity.Model()).count() == 0
