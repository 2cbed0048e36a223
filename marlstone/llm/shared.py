"""What several operators of this subpackage share: scratch tables, words, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that part words.
BLANKS = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a new temporary one, but only for a local master: executors of a cluster would each
    write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        root = _local_scratch.setdefault(key, "")
        if not root:
            root = _local_scratch[key] = "file://" + tempfile.mkdtemp(prefix="spark-marlstone-")
    return root.rstrip("/")


class Scratch:
    """Written tables of one query run; they cut lineage, so a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{scratch_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")  # the table is written once, so its shuffles can go with the query
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the tables saved here that ``df`` reads and nothing reads any more."""
        jvm = self.spark._jvm
        own = jvm.org.apache.hadoop.fs.Path(self.base).toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(own + "/"):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not on their path already."""
    top = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_marlstone_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-marlstone-zip-")) / "marlstone_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "marlstone").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(target))
    sc._marlstone_shipped = True


def sorted_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``names``, group by group, from batches in which such rows follow one another.

    Only one batch and one open group are held at a time.
    """
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in names:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        new[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if k and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5 are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long) as (node, component), component = its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step only takes a minimum
    per node, which is combined before the shuffle, and joins it back, so no neighbour list is ever
    gathered. Each round is a written table.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a > b").distinct()

    cur = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen, last = mark, cur
        cur = scratch.save(stars(stars(cur, True), False), "stars")
        scratch.drop(last)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
