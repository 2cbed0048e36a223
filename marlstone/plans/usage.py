"""Usage ledgers, sessions, edges and running limits over the event stream's table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.running import in_order, running
from ..scratch import Tables
from ..session import table
from .registry import query


@query("""WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, day, CAST(cents AS BIGINT) AS cents, n, CAST(sum(cents) OVER w AS BIGINT) AS total_cents, CAST(sum(n) OVER w AS BIGINT) AS total_n, round(cents / 100.0::DOUBLE / 60.0::DOUBLE * 0.006::DOUBLE, 6) AS cost FROM m WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def monthly_usage_ledger(spark, sf_dir):
    """Per period and so far; the tables span one month, so the period is the day."""
    m = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    return m.select("user_id", "day", "cents", "n", F.sum("cents").over(w).alias("total_cents"), F.sum("n").over(w).alias("total_n"), F.round(F.col("cents") / F.lit(100.0) / F.lit(60.0) * F.lit(0.006), 6).alias("cost"))


@query("SELECT strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def pacific_day_counter(spark, sf_dir):
    """Requests per day that ends at midnight of UTC-8."""
    return table(spark, sf_dir, "events").groupBy((F.col("ts") - F.expr("INTERVAL 8 HOURS")).cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_gaps(spark, sf_dir):
    """Sessions end after 30 minutes without data."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return g.select("user_id", "started", "ended", "n")


@query("""WITH l AS (SELECT user_id, event_id, ts, value > 50 AS high, lag(value > 50, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, ts FROM l WHERE high AND NOT before""")
def rising_edges(spark, sf_dir):
    """Rows where a signal turns on."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") > 50).alias("high"))
    return e.withColumn("before", F.lag("high", 1, False).over(order)).where("high and not before").select("user_id", "event_id", "ts")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'login' OR value > 90 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS marker FROM events""")
def forward_fill_marker(spark, sf_dir):
    """The last heading seen is carried down."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when((F.col("event_type") == "login") | (F.col("value") > 90), F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(mark, True).over(w).alias("marker"))


@query("""WITH r AS (SELECT user_id, event_id, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS used FROM events)
SELECT user_id, min(event_id) FILTER (used >= 60000) AS first_over, count(CASE WHEN used < 60000 THEN 1 END) AS within FROM r GROUP BY user_id""")
def running_cap(spark, sf_dir):
    """Where a running sum reaches its limit; sums run over ranges of a user's events, so a user may be any size."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    placed = Tables(spark, "cap").save(in_order(e, ["user_id", "ts", "event_id"], keep=["user_id", "event_id", "cents"]), "placed")
    r = running(placed, ["user_id"], "bucket", ["place"], {"used": ("sum", F.col("cents"))})
    return r.groupBy("user_id").agg(F.min(F.when(F.col("used") >= 60000, F.col("event_id"))).alias("first_over"), F.count_if(F.col("used") < 60000).alias("within"))


@query("SELECT event_id, array_agg(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)[-1] AS ahead, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM events")
def look_ahead(spark, sf_dir):
    """A line with the four after it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 4)
    return table(spark, sf_dir, "events").select("event_id", F.last("event_type").over(w).alias("ahead"), F.count("*").over(w).alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def hourly_usage(spark, sf_dir):
    """Usage in windows of an hour."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select("user_id", F.col("window.start").alias("hour"), "n", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(spark, sf_dir):
    """A value out of JSON metadata."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null")
