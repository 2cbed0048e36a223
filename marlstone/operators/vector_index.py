"""Nearest vectors for many queries at once, over vectors kept in lists.

Vectors, at length 1, are dealt into lists and each list into blocks of a bounded number of rows; queries that ask a
list are packed into blocks too and go to its blocks, some of which are together. So two bounded blocks meet in a task at
a time, a list of any size is as many keys as it has groups of blocks, and nothing is broadcast. A task returns the best
rows of each query over the blocks it met, so results are few against what was compared.

Lists are given (an owner's vectors), or come from centroids (an inverted file). For those, a first round asks the
nearest list of each query, and its k-th similarity bounds the distance of all better rows; a list whose
centroid is farther than that bound and the list's radius together cannot hold one (triangle inequality), so the second
round asks only the others. The result is that of an exact search; where vectors have no clusters all lists are asked.

Null vectors are in no list; a vector of length 0 has similarity 0 with all. Ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Tables

#: Vectors in a block, blocks that a task compares with a block of queries, lists and sampled rows of an inverted file.
ROWS, TOGETHER, LISTS, SAMPLE = 1000, 16, 16, 4096
#: Similarities are compared at nine digits; bounds leave this much room.
SLACK = 1e-6


def _pack(keys: list[str], rows: int):
    """Rows sorted by ``keys`` as blocks of at most ``rows`` vectors of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, ids, vectors = None, [], []

        def block():
            m = np.array(vectors, np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            values = [[k] for k in open_key] + [[np.array(ids, np.int64).tobytes()], [m.tobytes()]]
            return pa.RecordBatch.from_pydict(dict(zip([*keys, "ids", "m"], values)))

        for b in batches:
            for key, i, v in zip(zip(*(b.column(c).to_pylist() for c in keys)), b.column("id").to_pylist(), b.column("v").to_pylist()):
                if key != open_key or len(ids) == rows:
                    if ids:
                        yield block()
                    open_key, ids, vectors = key, [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block()

    return run


def _best(k: int):
    """The first ``k`` rows of each query over all blocks that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in range(b.num_rows):
                q_ids, q_m, ids, m = (b.column(c)[r].as_py() for c in ("q_ids", "q_m", "ids", "m"))
                vi = np.frombuffer(ids, np.int64)
                q = np.frombuffer(q_m).reshape(len(q_ids) // 8, -1)
                sims = np.round(q @ np.frombuffer(m).reshape(len(vi), -1).T, 9)
                ids = np.broadcast_to(vi, sims.shape)
                if q_ids in best:
                    ids, sims = np.hstack([best[q_ids][0], ids]), np.hstack([best[q_ids][1], sims])
                first = np.lexsort((ids, -sims), axis=1)[:, :k]
                best[q_ids] = np.take_along_axis(ids, first, 1), np.take_along_axis(sims, first, 1)
        for key, (ids, sims) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(key, np.int64), ids.shape[1])), pa.array(ids.ravel()), pa.array(sims.ravel())], ["query_id", "id", "sim"])

    return run


class Lists:
    """Vectors (list long, id long, v array<double>) in written blocks (list, part, ids, m)."""

    def __init__(self, vectors: DataFrame, tables: Tables, rows: int = ROWS):
        self.tables, self.rows = tables, rows
        rows_ = vectors.where("v is not null and list is not null").select(F.col("list").cast("long").alias("list"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        self.sizes = tables.save(rows_.groupBy("list").agg(F.ceil(F.count("*") / rows).alias("parts")), "sizes")
        dealt = rows_.join(self.sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        blocks = self._packed(dealt, ["list", "part"]).withColumn("near", F.floor(F.col("part") / TOGETHER))
        self.blocks = tables.save(blocks.select("list", "near", "ids", "m"), "blocks")

    def _packed(self, dealt: DataFrame, keys: list[str]) -> DataFrame:
        schema = ", ".join(f"{c} long" for c in keys) + ", ids binary, m binary"
        return dealt.select(*keys, "id", "v").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_pack(keys, self.rows), schema)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, sim) for queries (list, id, v): ``k`` rows of each list asked, or more, in no order."""
        share = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("_n") / self.rows)))  # a list asked by many has blocks of queries
        q = queries.where("v is not null").select(F.col("list").cast("long").alias("list"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        asked = q.groupBy("list").agg(F.count("*").alias("_n"))
        packed = self._packed(q.join(asked, "list").withColumn("share", share), ["list", "share"]).select("list", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
        last = F.floor((F.col("parts") - 1) / TOGETHER)
        spread = packed.join(self.sizes, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("near"), "q_ids", "q_m")
        met = spread.join(self.blocks, ["list", "near"])
        return met.select("q_ids", "q_m", "ids", "m").mapInArrow(_best(k), "query_id long, id long, sim double")


def first_k(near: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows of each query with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id", *(by or [])).orderBy(F.desc("sim"), "id"))
    return near.withColumn("vrank", rank).where(F.col("vrank") <= k)


def centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centroids at length 1 of a sample of at most ``sample`` rows, those of least hash of their id."""
    rows = vectors.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("v").cast("array<double>").alias("v")).collect()
    if not rows:
        return np.zeros((0, 1))
    x = np.array([r["v"] for r in rows], np.float64)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    if not len(x):
        return x
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (of == i).any():
                m = x[of == i].mean(axis=0)
                c[i] = m / (np.sqrt(m @ m) or 1.0)
    return c


def _assign(c: np.ndarray, all_: bool):
    """Nearest list and the distance to its centroid, or all lists with their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.array(b.column("v").to_pylist(), np.float64)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            far = np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True) + (c * c).sum(axis=1) - 2 * m @ c.T, 0))
            if all_:
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": b.column("v"), "far": pa.array(list(far), pa.list_(pa.float64()))})
            else:
                of = far.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"list": pa.array(of.astype(np.int64)), "id": b.column("id"), "v": b.column("v"), "far": far[np.arange(len(of)), of]})

    return run


class InvertedFile:
    """All of ``vectors`` (id long, v) in lists by centroid."""

    def __init__(self, vectors: DataFrame, tables: Tables, lists: int = LISTS, sample: int = SAMPLE, rows: int = ROWS):
        rows_ = vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        self.tables, self.c = tables, centroids(rows_, lists, sample)
        if not len(self.c):  # only vectors of length 0, or none
            self.c = np.zeros((1, len((rows_.first() or {"v": [0.0]})["v"])))
        placed = tables.save(rows_.mapInArrow(_assign(self.c, False), "list long, id long, v array<double>, far double"), "placed")
        self.radius = placed.groupBy("list").agg(F.max("far").alias("radius"))
        self.lists = Lists(placed, tables, rows)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, sim, vrank): for each query (id, v) its ``k`` nearest rows by cosine, exactly."""
        q = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        q = self.tables.save(q.mapInArrow(_assign(self.c, True), "id long, v array<double>, far array<double>"), "queries")
        order = F.array_sort(F.transform("far", lambda x, i: F.struct(x.alias("far"), i.cast("long").alias("list"))))
        near = q.select("id", "v", F.explode(order).alias("l")).select("id", "v", "l.*").join(self.radius, "list")  # a row per list: bounded
        nth = F.row_number().over(Window.partitionBy("id").orderBy("far", "list"))
        near = self.tables.save(near.withColumn("_n", nth), "asked")
        first = self.tables.save(self.lists.nearest(near.where("_n = 1"), k), "first")
        kth = first_k(first, k).groupBy("query_id").agg(F.count("*").alias("_have"), F.min("sim").alias("kth"))
        bound = F.when(F.col("_have") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))) + SLACK)
        zero = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) == 0  # similarity says nothing about its distances
        rest = near.where("_n > 1").join(kth.select(F.col("query_id").alias("id"), bound.alias("bound")), "id", "left")
        rest = rest.where(F.col("bound").isNull() | zero | (F.col("far") - F.col("radius") <= F.col("bound")))
        return first_k(first.unionByName(self.lists.nearest(rest, k)), k)
