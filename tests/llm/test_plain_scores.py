"""The toxicity scores, counts and chosen features against plain Python; recall and labels of the vector passes."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from marlstone.llm import toxicity, vector_dedup
from marlstone.llm.learning import training_rows
from marlstone.session import table


def features(text):
    out = set()
    for w in set(re.findall(r"\w+", (text or "").lower())):
        out.add(w)
        out |= {"^" + w[:k] for k in (3, 4, 5, 6, 7) if len(w) > k}
    return out


def test_scores_are_sums_of_weights():
    model = toxicity.Model({"bad": 1.5, "^stup": 0.75, "good": -2.0, "ärger": 0.5}, -0.25)
    texts = ["Bad bad GOOD", "stupid, stupidly!", "", None, "Ärger bad-stupendous", "nothing here", "good\nbad " * 50]
    got = model.scores(pa.array(texts, pa.string()))
    want = [1 / (1 + math.exp(-(model.bias + sum(w for f, w in model.weights.items() if f in features(t))))) for t in texts]
    assert np.allclose(got, want, atol=1e-12)
    assert np.allclose(toxicity.Model({}, 0.0).scores(pa.array(["x"], pa.string())), [0.5])


def test_trained_model_by_a_plain_version(spark, scratch):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels, scratch)
    rows = training_rows(docs.select("doc_id", "text"), labels, "toxic", toxicity.MAX_TRAIN_ROWS).collect()
    counts = {0: Counter(), 1: Counter()}
    for r in rows:
        counts[r["y"]].update(features(r["text"]))
    n0, n1 = (sum(r["y"] == y for r in rows) for y in (0, 1))
    z = {}
    for f in set(counts[0]) | set(counts[1]):
        a, b = counts[0][f], counts[1][f]
        if a + b >= toxicity.LEAST_DOCS:
            p = (a + b) / (n0 + n1)
            z[f] = abs((b / n1 - a / n0) / math.sqrt(p * (1 + 1e-9 - p) * (1 / n0 + 1 / n1)))
    least = sorted(z.values(), reverse=True)[: toxicity.MAX_FEATURES][-1]
    assert model.weights and all(f in z and z[f] >= least - 1e-9 for f in model.weights)
    some = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{folder}/documents.parquet')").fetchall()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for d, t in some[:300]:
        have = features(t)
        assert abs(got[d] - 1 / (1 + math.exp(-(model.bias + sum(w for f, w in model.weights.items() if f in have))))) < 1e-9


def test_recall_of_planted_pairs(spark, scratch):
    rng = np.random.default_rng(3)
    n, planted = 12_000, 300
    base = rng.normal(size=(n, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(planted, 32))
    noise -= (noise * base[:planted]).sum(axis=1, keepdims=True) * base[:planted]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    twins = 0.9803 * base[:planted] + math.sqrt(1 - 0.9803**2) * noise
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.vstack([base, twins]))]
    got = {r["vec_id"]: r["component_id"] for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), scratch).collect()}
    assert sum(got[n + i] == i for i in range(planted)) >= 0.97 * planted


def test_labels_that_are_no_whole_numbers(spark, scratch):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 1.2, v), (2, 1.7, v), (3, 1.2, [1.0, 2.0, 3.01]), (4, None, v)]
    got = {r["vec_id"]: r["component_id"] for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label double, embedding array<double>"), scratch).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
