"""Statistics, scores and clashes of the classifiers against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import quality_model


def plain_statistics(text):
    words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    n, some = len(raw), max(1, len(words))
    classes = [lambda b: 97 <= b < 123, lambda b: 65 <= b < 91, lambda b: 48 <= b < 58, lambda b: b in b"#*$%&|<>", lambda b: b == 33, None, lambda b: b == 10, lambda b: b in b" \t\x0b\x0c\r", lambda b: b >= 192, lambda b: 128 <= b < 192]
    counts = [sum(map(c, raw)) if c else 0 for c in classes]
    counts[5] = n - sum(counts)
    return [
        math.log1p(len(words)), sum(len(w.encode()) for w in words) / some, len(set(words)) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
        sum(w.lower().strip(".,;:!?") in quality_model._STOP for w in words) / some, sum(w.isupper() and len(w) > 1 for w in words) / some, math.log1p(n), *(c / max(1, n) for c in counts),
    ]


def test_statistics_are_plain(odd_docs, spark):
    texts = [r["text"] for r in odd_docs.collect()] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = quality_model.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t or "") for t in texts], rtol=1e-12, atol=1e-12)


def test_trees_are_walked_row_by_row():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((400, len(quality_model.STATISTICS))), rng.integers(0, 2, 400).astype(float)
    y[x[:, 0] > 0.3] = 1
    model = quality_model.fit(x, y, trees=12)
    inner = model.feature.shape[1]

    def margin(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < inner:
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - inner]
        return total

    assert np.allclose(model.margins(x), [margin(r) for r in x], rtol=1e-12)


def test_score_gives_way_to_a_clash(spark, odd_docs):
    model = quality_model.fit(np.zeros((0, len(quality_model.STATISTICS))), np.zeros(0))
    docs = odd_docs.withColumn("score", F.lit("mine")).withColumn("y", F.lit(1))
    got = quality_model.score(docs, model, keep=docs.columns)
    assert got.columns.count("score") == 1 and {r["score"] for r in got.collect()} == {0.5}
    other = quality_model.score(docs, model, keep=docs.columns, into="_q")
    assert {(r["score"], r["_q"]) for r in other.collect()} == {("mine", 0.5)}


def test_no_machine_local_scratch_on_a_cluster(spark):
    import pytest

    from marlstone.llm import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.scratch_root(Cluster)
