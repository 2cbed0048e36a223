"""Structured Streaming forms of the event operators; each gives its batch query's rows over the same input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lift
from ..scratch import Tables
from ..sources import files

#: How late an event may come and still count.
LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_usage(events: DataFrame) -> DataFrame:
    """Usage in tumbling windows of an hour, bounded by a watermark."""
    g = events.withWatermark("ts", LATE).groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return g.select("user_id", F.col("window.start").alias("hour"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after a gap; a session is out when the watermark has passed its end."""
    g = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return g.select("user_id", "started", "ended", "n")


def unseen(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


STATE = "height double, door double, last timestamp"
OUT = "lift long, seq long, height double, door double"


def _advance(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    height, door, last = state.get if state.exists else (0.0, 0.0, None)
    rows = []
    for r in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples(index=False):
        dt = 0.0 if last is None else min(1.0, max(0.0, (r.ts - pd.Timestamp(last)).total_seconds()))
        last = r.ts
        height, door = lift.step(height, door, dt, r.up, r.down, r.open, r.close)
        rows.append((key[0], r.seq, height, door))
    state.update((height, door, last))
    yield pd.DataFrame(rows, columns=["lift", "seq", "height", "door"])


def lift_states(samples: DataFrame) -> DataFrame:
    """The physics of every lift, kept as state from batch to batch; samples come in order of time."""
    return samples.groupBy("lift").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")


def upsert_latest(events: DataFrame, target: str, checkpoint: str):
    """Every batch appends its newest row per key to a log; readers take the latest per key."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r"))
        newest.select("user_id", "event_type", "r.*", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


LATEST = "user_id, event_type, ts, event_id, value, deleted"


class LatestTable:
    """K12 with K6 to K10: the newest row per key under a folder, as a base in buckets by key and a log of batches.

    Readers take the newest row of both, so a batch or a fold that runs twice changes nothing. A fold merges the log into the
    buckets that it touches and then deletes it; other buckets are not read or written.
    """

    BUCKETS = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log, self.base = spark, f"{folder}/log", f"{folder}/base"

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        order = F.struct("ts", "event_id")
        newest = rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "event_id", "value", "deleted"), order).alias("r"))
        return newest.select("user_id", "event_type", "r.*")

    def _read(self, path: str) -> DataFrame | None:
        return self.spark.read.parquet(path) if files.there(self.spark, path) else None

    def append(self, batch: DataFrame, number: int) -> None:
        rows = self._newest(batch.select(*LATEST.split(", "))).withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(self.BUCKETS)).cast("int"))
        rows.write.mode("overwrite").parquet(f"{self.log}/batch={number}")

    def fold(self) -> int:
        """Merge the log into the base; how many batches went."""
        log = self._read(self.log)
        if log is None:
            return 0
        batches = sorted(r["batch"] for r in log.select("batch").distinct().collect())
        touched = sorted(r["bucket"] for r in log.select("bucket").distinct().collect())  # BUCKETS at most
        base, rows = self._read(self.base), log.drop("batch")
        if base is not None:
            rows = rows.unionByName(base.where(F.col("bucket").isin(touched)))
        merged = self._newest(rows).withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(self.BUCKETS)).cast("int"))
        merged = Tables(self.spark, "fold").save(merged, "merged")  # the base cannot be read while it is written
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.base)
        for n in batches:
            files.remove(self.spark, f"{self.log}/batch={n}")
        if not files.listed(self.spark, self.log):
            files.remove(self.spark, self.log)
        return len(batches)

    def rows(self) -> DataFrame | None:
        """The table as it is: newest rows that are not deleted; None before the first batch."""
        parts = [p.select(*LATEST.split(", ")) for p in (self._read(self.base), self._read(self.log)) if p is not None]
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._newest(both).where("not deleted").drop("deleted")

    def follow(self, events: DataFrame, checkpoint: str, every: int = 10):
        """A writer that appends each batch to the log and folds it every so many batches."""

        def put(batch: DataFrame, number: int) -> None:
            self.append(batch, number)
            if number % every == every - 1:
                self.fold()

        return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
