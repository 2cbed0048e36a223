"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken batch by batch with Arrow and numpy. The trees are grown on the driver
from the statistics of at most ``MAX_TRAIN_ROWS`` labelled documents (a bounded number of short rows), then
flattened into arrays that tasks traverse for all rows and trees of a batch at once.

Nulls: a null text counts as empty and gets a score like any other. A very long text is a batch of its own and takes some
24 bytes of index a byte of it. Repeated rows score alike. Without any
label to learn from, every score is 0.5. An empty table gives an empty result. Labels, language, source and
ids are never inputs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import coded_words, training_rows
from .quality_rules import STOP_WORDS
from .shared import held_out, ship
from .tokens import slices

MAX_TRAIN_ROWS = 20_000
CUT = 0.3

_CLASSES = ("lower", "upper", "digit", "symbol", "bang", "punct", "newline", "blank", "lead", "inner")
STATISTICS = ("log_words", "mean_word_bytes", "distinct_words", "same_as_before", "stop_words", "upper_words", "log_chars", *(f"{c}_bytes" for c in _CLASSES))


def _byte_classes() -> np.ndarray:
    out = np.full(256, 5, np.int64)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[ord(c) for c in "#*$%&|<>"]] = 3
    out[ord("!")], out[10] = 4, 6
    out[[32, 9, 11, 12, 13]] = 7
    out[128:192], out[192:] = 9, 8
    return out


_BYTE_CLASS = _byte_classes()
_STOP = frozenset(STOP_WORDS)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    t = texts.fill_null("").cast(pa.large_string())
    n = len(t)
    at = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2], np.uint8)[at[0] : at[-1]] if n and t.buffers()[2] is not None else np.zeros(0, np.uint8)
    k, sizes = len(_CLASSES), np.diff(at)
    per_class = np.bincount(np.repeat(np.arange(n) * k, sizes) + _BYTE_CLASS[data], minlength=n * k).reshape(n, k).astype(float)
    distinct, codes, doc = coded_words(texts)
    bytes_of = np.fromiter((len(w.encode()) for w in distinct), float, len(distinct))
    stop = np.fromiter((w.lower().strip(".,;:!?") in _STOP for w in distinct), float, len(distinct))
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in distinct), float, len(distinct))
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    pairs = np.unique(doc * max(1, len(distinct)) + codes) // max(1, len(distinct))
    same = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    over = lambda weights: np.bincount(doc, weights=weights[codes], minlength=n) / some
    columns = [np.log1p(words), over(bytes_of), np.bincount(pairs, minlength=n) / some, np.bincount(doc[1:][same], minlength=n) / some, over(stop), over(upper), np.log1p(sizes)]
    return np.column_stack([*columns, per_class / np.maximum(sizes, 1)[:, None]])


@dataclass(frozen=True)
class Trees:
    """Complete trees, flattened: inner nodes of a tree breadth-first, then its leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree, rows = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while len(x) and trees and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + (self.leaf[tree, node - inner].sum(axis=1) if trees and len(x) else np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosting with logistic loss; a level's splits come from histograms of gradients per node, feature and bin."""
    n, width = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(rate_of / (1 - rate_of))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.full(many, 1e-6)
            pick = [(0, np.inf, bins)] * many
            for j in range(width):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, many * bins).reshape(many, bins).cumsum(axis=1)
                hs = np.bincount(key, h, many * bins).reshape(many, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(many), at] > best):
                    best[k] = gain[k, at[k]]
                    pick[k] = (j, cuts[j][at[k]], at[k])
            right = np.zeros(n, bool)
            for k, (j, cut, at) in enumerate(pick):
                feature[first + k], threshold[first + k] = j, cut
                mine = local == k
                right[mine] = binned[mine, j] > at
            node = 2 * node + 1 + right
        local = node - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        margin += leaf[local]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=4 << 20):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(c) for c in x.T)], ["y", *STATISTICS])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    ship(docs.sparkSession)
    schema = "y int, " + ", ".join(f"{c} double" for c in STATISTICS)
    rows = training_rows(docs, labels, "quality", max_rows).mapInArrow(_measure, schema).toPandas()
    x = rows[list(STATISTICS)].to_numpy(float)
    order = np.lexsort(x.T)  # the same trees whatever order rows arrive in
    return fit(x[order], rows["y"].to_numpy(float)[order])


def _scorer(model: Trees, names: list[str], into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                scores = model.scores(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores)], [*names, into])

    return run


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns ``keep`` of every row (default: its id) and its score, named ``into``; a column of that name gives way."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c in (keep or ["doc_id"]) and c != into]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(_scorer(model, names, into), f"{schema}`{into}` double")


def digest(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
