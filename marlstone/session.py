"""Session and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings the queries rely on for results (time zone) or for large inputs (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``conf`` wins over them, dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int = 200_000) -> int:
    """Into how many tasks to deal the rows of ``df``, so that the memory of one does not grow with the table.

    Adaptive execution joins small shuffle partitions by their packed bytes; narrow rows take many times that in a
    hash table or sort. A number given to ``repartition`` stays.
    """
    return max(1, -(-df.count() // rows))
