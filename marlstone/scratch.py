"""Written tables in the shared folder of a session, and tables that are kept between queries."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new temporary one for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _local[app] = _local.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-marlstone-")
    return root.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Tables:
    """Tables written under one folder; they cut lineage, so a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        ship(spark)
        self.spark, self.base, self.n = spark, base or f"{shared_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet, in folders ``by`` where given, and return the written table."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")  # the table is written once, so its shuffles can go with the query
        try:
            (df.write.partitionBy(*by) if by else df.write).parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the tables of this folder that ``df`` reads and nothing reads any more."""
        own = _path(self.spark, self.base)[0].toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path, files = _path(self.spark, folder)
            if path.toUri().getPath().startswith(own + "/"):
                files.delete(path, True)


def version(df: DataFrame) -> str:
    """A name of the files that a table is read from, their sizes and times."""
    m = df.select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("t")).distinct()
    row = m.agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_path", "file_size", "t").cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{row['n']}:{row['h']}".encode()).hexdigest()[:24]


def kept(source: DataFrame, name: str, build: Callable[[Tables], None]) -> str:
    """The folder of what ``build`` makes of ``source``, built once per session folder and version of its files.

    A mark is written last; a folder without mark is another build's or a broken one's, and is left alone.
    """
    spark = source.sparkSession
    ship(spark)
    top = f"{shared_root(spark)}/marlstone/kept/{name}-{version(source)}"
    ready, files = _path(spark, f"{top}/READY")
    if files.exists(ready):
        stream = files.open(ready)
        base = bytes(stream.readAllBytes()).decode()
        stream.close()
        return base
    tables = Tables(spark, name, f"{top}/{uuid.uuid4().hex}")
    build(tables)
    out = files.create(ready, True)
    out.write(bytearray(tables.base.encode()))
    out.close()
    return tables.base


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not on their path already."""
    top, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_marlstone_core_shipped", False):
        return
    import zipfile

    target = Path(tempfile.mkdtemp(prefix="spark-marlstone-zip-")) / "marlstone_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "marlstone").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(target))
    sc._marlstone_core_shipped = True
