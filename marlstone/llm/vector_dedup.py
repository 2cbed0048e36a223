"""Embedding near-dedup by sorted projection passes, within equal labels.

Equal vectors of a label are one class first. A pass gives each class a code of 64 signs of random
projections, range-sorts by label and code, and compares each vector with a bounded window of the rows before it; a task
holds one batch and one window. Each task passes on only links that join what the links before in its window
did not. Components are the union over all passes. Links are then counted exactly inside each component, in
blocks of bounded size.

Two vectors at the threshold of 0.98 share a sign with probability 0.936, and need to share about
``log2(rows of the label / window)`` leading signs to meet in a pass; there are as many passes as make them
meet with probability 0.99 in the largest label, ``PASSES`` at least. A window that is cut at a partition's
edge loses the pairs across it in that pass, at most the window's rows of each partition.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with
nothing and are kept. Vectors of different length do not link. Repeated rows are copies of one vector. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, sorted_groups

THRESHOLD = 0.98
PASSES = 8
#: Passes that are sorted in one shuffle.
TOGETHER = 4
WINDOW = 128
#: 1 - arccos(0.98) / pi
SHARED_SIGN = 0.936
BLOCK = 1024


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _runs(table: pa.Table, names: list[str]) -> Iterator[tuple[int, int]]:
    """Starts and ends of rows with equal values in ``names``, in a sorted table."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for c in names:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    cuts = [*np.flatnonzero(new).tolist(), n]
    yield from zip(cuts, cuts[1:])


def _unit(vectors: pa.ChunkedArray, start: int, end: int) -> np.ndarray:
    part = vectors.slice(start, end - start).combine_chunks()
    x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(end - start, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(first: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = _unit(pa.chunked_array([rows.column("vector")]), 0, rows.num_rows)
                for k in range(first, first + many):
                    planes = np.random.default_rng([k, dim]).standard_normal((dim, 64))
                    code = np.packbits(x @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                    code = (code ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.num_rows, k, np.int32)), pa.array(code), *(rows.column(c) for c in ("label", "dim", "rep", "vector"))],
                        ["pass", "code", "label", "dim", "rep", "vector"],
                    )

    return run


def _windows(x: np.ndarray, root: np.ndarray, threshold: float, window: int, old: int) -> list[tuple[int, int]]:
    """Links of the rows from ``old`` on with the ``window`` rows before each, that join what earlier links did not.

    ``root`` names the part that a row is joined to so far and is brought up to date.
    """
    out = []
    for start in range(old, len(x), window):
        end, low = min(len(x), start + window), max(0, start - window)
        near = x[start:end] @ x[low:end].T >= threshold
        near &= np.arange(low, end)[None, :] < np.arange(start, end)[:, None]
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            i, js = start + r, np.flatnonzero(near[r]) + low
            roots, at = np.unique(root[js], return_index=True)
            for other, k in zip(roots.tolist(), at.tolist()):
                if other != root[i]:
                    out.append((i, int(js[k])))
                    gone, kept = max(other, root[i]), min(other, root[i])
                    part = root[low:end]
                    part[part == gone] = kept
    return out


def _neighbours(threshold: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_key, x, ids, root, n = None, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            names = table.column("rep").to_numpy()
            links = []
            for a, b in _runs(table, ["pass", "label", "dim"]):
                key = tuple(batch.column(c)[a].as_py() for c in ("pass", "label", "dim"))
                new = _unit(table.column("vector"), a, b)
                if key != run_key:
                    run_key, x, ids, root = key, np.zeros((0, new.shape[1])), np.zeros(0, np.int64), np.zeros(0, np.int64)
                old = len(x)
                x, ids, root = np.vstack([x, new]), np.append(ids, names[a:b]), np.append(root, np.arange(n, n + b - a))
                n += b - a
                links += [(int(ids[i]), int(ids[j])) for i, j in _windows(x, root, threshold, window, old)]
                x, ids, root = x[-window:], ids[-window:], root[-window:]
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def passes_for(rows: int, window: int = WINDOW, least: int = PASSES, recall: float = 0.99) -> int:
    """Passes in which a pair at the threshold meets with probability ``recall`` in a label of ``rows`` vectors."""
    meet = SHARED_SIGN ** max(0.0, math.log2(max(1, rows) / window))
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))


def _link_counts(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["component", "i", "j"]):
            ids, weight, who = (g.column(c).to_numpy() for c in ("rep", "copies", "asks"))
            x = _unit(g.column("vector"), 0, g.num_rows)
            near = x[who == 1] @ x[who == 0].T >= threshold
            near &= ids[who == 1][:, None] != ids[who == 0][None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who == 1]), pa.array(near @ weight[who == 0])], ["rep", "n"])

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Every row as vec_id, n_links, component_id, kept. Without ``passes`` their number follows the largest label."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    v = v.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    v = v.withColumns({"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64(F.lit(1), "vector", "label")})
    classes = scratch.save(
        v.where("ok").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")).withColumn("dim", F.size("vector")),
        "classes",
    )
    narrow = classes.select(F.col("label").cast("long").alias("label") if classes.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label").alias("label"), "dim", "rep", F.col("vector").cast("array<double>").alias("vector") if "double" in classes.schema["vector"].dataType.simpleString() else "vector")
    kind = narrow.schema["vector"].dataType.simpleString()
    if passes is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 0, window)
    links = None
    for first in range(0, passes, TOGETHER):
        many = min(TOGETHER, passes - first)
        coded = narrow.mapInArrow(_codes(first, many), f"pass int, code long, label long, dim int, rep long, vector {kind}")
        ranged = coded.repartitionByRange("pass", "label", "dim", "code", "rep").sortWithinPartitions("pass", "label", "dim", "code", "rep")
        found = scratch.save(ranged.mapInArrow(_neighbours(threshold, window), "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
    whole = components(scratch, links)

    members = classes.select("rep", "copies", "vector").join(whole.withColumnRenamed("node", "rep"), "rep")
    sizes = whole.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = members.join(sizes, "component").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = members.select("component", F.col("_own").alias("i"), F.col("_other").alias("j"), F.lit(1).alias("asks"), "rep", "copies", "vector").unionByName(
        members.select("component", F.col("_other").alias("i"), F.col("_own").alias("j"), F.lit(0).alias("asks"), "rep", "copies", "vector")
    )
    counted = sides.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_link_counts(threshold), "rep long, n long")
    counts = counted.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = (
        classes.select("label", "k1", "k2", "rep", "copies").join(whole.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
        .select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rows = v.select("vec_id", "ok", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in ("label", "k1", "k2"))).join(per_class, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))
