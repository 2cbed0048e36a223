"""Listings and status figures: documents, sources, conversations, histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .registry import query


@query("SELECT source AS file_name, count(*) AS n_chunks, max(lang) AS path, max(md5(text)) AS file_hash FROM documents GROUP BY source")
def documents_list(spark, sf_dir):
    """A1, V5: documents per file with path and hash."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("file_name")).agg(F.count("*").alias("n_chunks"), F.max("lang").alias("path"), F.max(F.md5(F.col("text").cast("binary"))).alias("file_hash"))


@query("SELECT source, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    """A2: documents per source, most first."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@query("SELECT count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS n_users FROM events")
def archive_status(spark, sf_dir):
    """Global count, first, last and distinct owners."""
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT conv_id, count(*) AS n_messages, substr(arg_max(text, turn), 1, 100) AS last_message, CAST(round(sum(length(text)) / 3.0::DOUBLE) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def conversation_summary(spark, sf_dir):
    """Messages, start of the last one, estimated tokens."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.substring(F.max_by("text", "turn"), 1, 100).alias("last_message"), F.round(F.sum(F.length("text")) / F.lit(3.0)).cast("long").alias("tokens"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS INTEGER) AS from_end FROM conversations QUALIFY from_end <= 3")
def history_tail(spark, sf_dir):
    """The last messages of every conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("from_end")).where("from_end <= 3")


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE length(trim(text)) > 0 GROUP BY conv_id HAVING count(*) > 0 ORDER BY conv_id DESC LIMIT 5")
def newest_conversations(spark, sf_dir):
    """The newest conversations that are not empty."""
    c = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    return c.groupBy("conv_id").agg(F.count("*").alias("n")).orderBy(F.desc("conv_id")).limit(5)


@query("SELECT conv_id, turn, role FROM conversations WHERE turn >= 2")
def message_delta(spark, sf_dir):
    """Messages past the count already seen."""
    return table(spark, sf_dir, "conversations").where("turn >= 2").select("conv_id", "turn", "role")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND n_chars >= 200 AND contains(lower(source), '1') ORDER BY doc_id LIMIT 120")
def facet_filter(spark, sf_dir):
    """Flags and a substring, capped at 120 for display."""
    d = table(spark, sf_dir, "documents")
    return d.where((F.col("lang") == "en") & (F.col("n_chars") >= 200) & F.lower("source").contains("1")).select("doc_id", "lang", "source").orderBy("doc_id").limit(120)


@query("SELECT user_id, count(*) AS n, max(ts) AS newest, (max(ts) >= TIMESTAMP '2024-01-25') AS active FROM events GROUP BY user_id")
def recent_activity(spark, sf_dir):
    """Who was active since a given day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest")).withColumn("active", F.col("newest") >= F.lit("2024-01-25").cast("timestamp_ntz"))
