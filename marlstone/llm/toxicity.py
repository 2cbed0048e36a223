"""Toxicity: a counterfactually regularised linear classifier over words and word beginnings.

Features are chosen by how far their document frequency differs between labels, counted in Spark over the
labelled sample. The weights then minimise the logistic loss plus a penalty on every labelled sentence with
an identity term: swapping the term for another of its group must not change the score. So neutral mentions
of a group carry no weight of their own.

Nulls: a null text counts as empty and gets the score of no feature. A text is scored whole, in a batch of its own if it
is very long, which takes some 30 bytes a byte of it. Repeated rows score alike. Without any
label to learn from, every score is 0.5. An empty table gives an empty result. Labels, language, source and
ids are never inputs; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import coded_words, training_rows
from .shared import Scratch
from .tokens import slices

MAX_TRAIN_ROWS = 12_000
MAX_FEATURES = 4_000
LEAST_DOCS = 4
#: Lengths of word beginnings that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
PENALTY = 10.0
CUT = 0.5

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "citizens", "refugees", "migrants"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> tuple[str, ...]:
    """A lower-case word and its beginnings, the latter with a leading ``^``."""
    return (word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k))


def features_in(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


def swaps_in(text: str) -> list[tuple[set[str], set[str]]]:
    """Features of each sentence with identity terms, as it is and with the terms swapped."""
    out = []
    for s in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(s)
        if any(w in SWAP for w in words):
            out.append(tuple({f for w in ws for f in features_of(w)} for ws in (words, [SWAP.get(w, w) for w in words])))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Sum of the weights of the features that a text has, through the logistic function."""
        distinct, codes, doc = coded_words(texts)
        number = {f: i for i, f in enumerate(self.weights)}
        weight = np.fromiter(self.weights.values(), float, len(number))
        hits = [[number[f] for w in _WORD.findall(x.lower()) for f in features_of(w) if f in number] for x in distinct]
        many = np.fromiter(map(len, hits), np.int64, len(hits))
        flat = np.fromiter((i for h in hits for i in h), np.int64, int(many.sum()))
        hit = many[codes] > 0
        codes, doc = codes[hit], doc[hit]
        first = np.cumsum(many) - many
        size = many[codes]
        at = np.repeat(first[codes] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        pairs = np.unique(np.repeat(doc, size) * max(1, len(number)) + flat[at])
        sums = np.bincount(pairs // max(1, len(number)), weight[pairs % max(1, len(number))], len(texts)) if len(pairs) else np.zeros(len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.bias + sums, -40, 40)))


def fit(rows: list[np.ndarray], y: np.ndarray, names: list[str], swaps: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY, ridge: float = 2e-4, steps: int = 300) -> Model:
    """Full-batch Adam over sparse rows of feature numbers; both labels weigh the same in all."""
    if not len(y) or y.min() == y.max():
        return Model(bias=0.0 if not len(y) else float(np.sign(y[0] - 0.5)) * 4)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64)
    k = len(names)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    pair = np.concatenate([np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])]) if swaps else np.zeros(0, np.int64)
    pair_col = np.concatenate([np.concatenate([a, b]) for a, b in swaps]).astype(np.int64) if swaps else np.zeros(0, np.int64)
    pair_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in swaps]) if swaps else np.zeros(0)
    w, m, v, rate = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1), 0.08
    for step in range(1, steps + 1):
        z = w[k] + np.bincount(row, w[col], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.append(np.bincount(col, r[row], k) + ridge * w[:k], r.sum())
        if swaps:
            gap = np.bincount(pair, pair_sign * w[pair_col], len(swaps))
            g[:k] += 2 * penalty / len(swaps) * np.bincount(pair_col, pair_sign * gap[pair], k)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(names, w[:k]) if abs(x) > 1e-6}, float(w[k]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            n[y == 1].update(features_in(text or ""))
        names = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[0][f] for f in names], pa.int64()), pa.array([n[1][f] for f in names], pa.int64())], ["feature", "n0", "n1"])


def _numbered(number: dict[str, int]):
    def ids(fs: set[str]) -> list[int]:
        return sorted(number[f] for f in fs if f in number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pairs = [[{"a": ids(a - b), "b": ids(b - a)} for a, b in swaps_in(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([ids(features_in(t)) for t in texts], pa.list_(pa.int32())), pa.array(pairs, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))],
                ["y", "row", "swaps"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learns from a bounded sample; what reaches the driver is bounded by ``max_rows`` and ``max_features``."""
    sample = scratch.save(training_rows(docs, labels, "toxic", max_rows).repartition(12), "sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(sum(n for y, n in totals.items() if y != 1))
    if not n0 or not n1:
        return Model(bias=0.0 if not n0 + n1 else (4.0 if n1 else -4.0))
    counted = sample.mapInArrow(_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / F.lit(n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (F.lit(1.0 + 1e-9) - p) * (1 / n0 + 1 / n1))
    chosen = counted.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).select("feature", F.abs(z).alias("z")).orderBy(F.desc("z"), "feature").limit(max_features)
    names = sorted(r["feature"] for r in chosen.collect())
    rows = sample.mapInArrow(_numbered({f: i for i, f in enumerate(names)}), "y int, row array<int>, swaps array<struct<a: array<int>, b: array<int>>>").collect()
    rows.sort(key=lambda r: (r["y"], r["row"]))
    swaps = [(np.array(s["a"], np.int64), np.array(s["b"], np.int64)) for r in rows for s in r["swaps"] if s["a"] or s["b"]]
    return fit([np.array(r["row"], np.int64) for r in rows], np.array([float(r["y"] == 1) for r in rows]), names, swaps)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), f"doc_id {kind}, score double")
