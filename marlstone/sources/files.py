"""Readers and writers of the shapes that the applications keep in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking

LESSON = "course string, module string, url string, note string, transcript string"
SETLIST = """artist string, eventDate string, tour struct<name: string>, venue struct<name: string>,
sets struct<set: array<struct<encore: int, song: array<struct<name: string, cover: struct<name: string>>>>>>"""
CHUNK = "id string, file_name string, file_hash string, lesson_index int, chunk_index int, page_number int, content string"


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def lessons(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of lessons as rendered documents; broken records are kept in ``corrupt``, not dropped."""
    raw = spark.read.schema(LESSON + ", corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), _or(F.col("course"), "Unknown course")), F.concat(F.lit("## "), _or(F.col("module"), "Unknown module")), F.nullif(F.trim("note"), F.lit("")), F.nullif(F.trim("transcript"), F.lit("")))
    return raw.select(F.col("_metadata.file_path").alias("file_name"), "course", "module", "url", content.alias("content"), "corrupt")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text and Markdown files with a hash of their bytes; other kinds are left out."""
    b = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(md|txt)$"))
    return b.select(F.col("path").alias("file_name"), F.md5("content").alias("file_hash"), F.decode("content", "UTF-8").alias("content"))


def uploads(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """Images and PDFs up to a size."""
    b = spark.read.format("binaryFile").load(path)
    return b.where((F.col("length") <= most_bytes) & F.lower("path").rlike(r"\.(png|jpe?g|gif|webp|pdf)$")).select("path", "length", "modificationTime")


def setlists(spark: SparkSession, path: str) -> DataFrame:
    """Raw set lists as one row per song, with the place in its set and the running place of own songs."""
    raw = spark.read.schema(SETLIST).json(path).withColumn("concert", F.monotonically_increasing_id())
    day = F.to_date(F.try_to_timestamp("eventDate", F.lit("dd-MM-yyyy")))
    s = raw.select("artist", "concert", day.alias("day"), F.col("tour.name").alias("tour"), F.col("venue.name").alias("venue"), F.posexplode_outer("sets.set").alias("set_no", "s"))
    return s.select("artist", "concert", "day", "tour", "venue", "set_no", F.col("s.encore").isNotNull().alias("encore"), F.posexplode_outer("s.song").alias("pos", "song")).select(
        "artist", "concert", "day", "tour", "venue", "set_no", "encore", (F.col("pos") + 1).alias("place"), F.trim("song.name").alias("song"), F.col("song.cover").isNotNull().alias("cover")
    )


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """§1.9: log records; lines without a head continue the record before them in their file."""
    head = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\w+) \[([^\]]*)\] (.*)"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    part = F.posexplode(F.split("value", r"\n(?=\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} )")).alias("seq", "record")
    r = whole.select("file", part)
    pick = lambda i: F.regexp_extract("record", "(?s)" + head, i)
    return r.where(F.col("record").rlike("(?s)" + head)).select("file", "seq", F.to_timestamp_ntz(pick(1)).alias("ts"), pick(2).alias("level"), pick(3).alias("thread"), F.regexp_replace(pick(4), r"\s+$", "").alias("message"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Stable ids: hash of file hash, lesson and chunk numbers."""
    return chunks.withColumn("id", F.sha2(F.concat_ws("|", "file_hash", F.coalesce("lesson_index", F.lit(-1)), "chunk_index"), 256))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """K1 to K3: partitions of the files in ``chunks`` are replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_name").parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder but for marks and hidden ones."""
    p, fs = _at(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [n for n in names if n[0] not in "._"]


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.delete(p, True)


def delete_files(spark: SparkSession, path: str, names: list[str]) -> int:
    """K2: the stored chunks of these files go, their partitions only; how many chunks went."""
    if not there(spark, path) or not names:
        return 0
    chunks = spark.read.parquet(path).where(F.col("file_name").isin(*names))
    found = chunks.groupBy(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n")).collect()  # a row per file named
    for r in found:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"]))  # names in metadata are written as addresses
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["n"] for r in found)


def reindex(spark: SparkSession, path: str, names: list[str], size: int = 1000) -> DataFrame:
    """K3, K4: stored files whose path or last part is among ``names`` are read, cut and stored anew, whatever their hash.

    (name, file_name, action): 'stored', 'gone' (the file is no more; its chunks stay) or 'unknown' (nothing stored).
    """
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    stored = spark.read.parquet(path).select("file_name").distinct()
    known = wanted.join(stored, (F.col("file_name") == F.col("name")) | F.col("file_name").endswith(F.concat(F.lit("/"), "name")), "left").collect()  # a row per file named
    paths = sorted({r["file_name"] for r in known if r["file_name"] is not None})
    alive = [p for p in paths if there(spark, p)]
    if alive:
        cut = chunking.chunk_documents(texts(spark, alive), "file_name", "content", size)
        hashes = texts(spark, alive).select("file_name", "file_hash")
        rows = cut.join(hashes, "file_name").withColumn("lesson_index", F.lit(None).cast("int")).withColumn("id", F.lit(""))
        write_chunks(chunk_ids(rows).select(*(c.split()[0] for c in CHUNK.split(", "))), path)
    action = lambda f: "unknown" if f is None else "stored" if f in alive else "gone"
    return spark.createDataFrame([(r["name"], r["file_name"], action(r["file_name"])) for r in known], "name string, file_name string, action string")


def without_known(new: DataFrame, stored: DataFrame) -> DataFrame:
    """V5: files whose hash is stored already are skipped."""
    return new.join(stored.select("file_hash").distinct(), "file_hash", "left_anti")


def packed_vectors(spark: SparkSession, path: str, width: int = 1024) -> DataFrame:
    """Rows of little-endian 32-bit floats as (file_name, row, vector); a file that ends inside a row is an error.

    A file is one value of ``binaryFile`` and so below 2 GB; more files make more tasks.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                raw = content.as_buffer()
                if raw.size % (4 * width):
                    raise ValueError(f"{name}: {raw.size} bytes are no whole rows of {width} floats")
                flat = np.frombuffer(raw, "<f4")
                for begin in range(0, len(flat) // width, 4096):
                    part = pa.array(flat[begin * width : (begin + 4096) * width])
                    n = len(part) // width
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), part)
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.array(np.arange(begin, begin + n)), vectors], ["file_name", "row", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "file_name string, row long, vector array<float>")


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents; a path that is not there gives no rows, any other failure is raised."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
