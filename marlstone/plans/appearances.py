"""Appearances of artists: ranges, orders, ordered unions, edits and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import merging as M
from ..operators.running import places
from ..scratch import Tables
from ..session import table
from .registry import query


@query("SELECT o_custkey AS artist, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY o_custkey HAVING NOT (max(o_orderdate) < TIMESTAMP '1997-01-01' OR min(o_orderdate) > TIMESTAMP '1998-01-01')")
def overlapping_ranges(spark, sf_dir):
    """Artists whose span of dates meets a range."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("artist")).agg(F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"), F.count("*").alias("n"))
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return g.where(~((F.col("latest") < day("1997-01-01")) | (F.col("earliest") > day("1998-01-01"))))


@query("""SELECT o_custkey AS artist, list_sort(list_distinct(array_agg(strftime(o_orderdate, '%Y-%m-%d')))) AS days, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS festivals FROM orders GROUP BY o_custkey""")
def distinct_days(spark, sf_dir):
    """Sorted distinct days of an artist."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("artist")).agg(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("days"), F.count_if(F.col("o_orderstatus") == "P").alias("festivals"))


@query("""SELECT event_id, (CASE WHEN hour(ts) < 12 THEN hour(ts) + 24 ELSE hour(ts) END) * 60 + minute(ts) AS slot,
CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY (CASE WHEN hour(ts) < 12 THEN hour(ts) + 24 ELSE hour(ts) END) * 60 + minute(ts), event_id) AS INTEGER) AS place FROM events""")
def timetable_slots(spark, sf_dir):
    """Slots after midnight come last in their day's order."""
    h = F.hour("ts")
    slot = (F.when(h < 12, h + 24).otherwise(h) * 60 + F.minute("ts")).cast("long")
    e = table(spark, sf_dir, "events").withColumn("slot", slot)
    return e.select("event_id", "slot", F.row_number().over(Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("slot", "event_id")).alias("place"))


_A = "SELECT o_custkey AS artist, l_partkey AS song, 0 AS side, min(l_orderkey * 100 + l_linenumber) AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' GROUP BY ALL"
_B = "SELECT o_custkey AS artist, l_partkey AS song, 1 AS side, min(l_orderkey * 100 + l_linenumber) AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' GROUP BY ALL"


@query(f"""WITH u AS ({_A} UNION ALL {_B}), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY artist, song ORDER BY side) = 1)
SELECT artist, song, side, CAST(row_number() OVER (PARTITION BY artist ORDER BY side, seq, song) AS INTEGER) AS place FROM o WHERE song % 10 <> 0""")
def ordered_union(spark, sf_dir):
    """A list, then what a second adds, without what was deleted; order is kept."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"]).where("l_returnflag in ('N', 'A')")
    u = j.groupBy(F.col("o_custkey").alias("artist"), F.col("l_partkey").alias("song"), (F.col("l_returnflag") == "A").cast("int").alias("side")).agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    once = M.first_of(u, ["artist", "song"], ["side"]).where("song % 10 <> 0")
    return once.select("artist", "song", "side", F.row_number().over(Window.partitionBy("artist").orderBy("side", "seq", "song")).alias("place"))


@query("""WITH m AS (SELECT c_nationkey AS grp, c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey // 7 END AS manual FROM customer)
SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY manual ASC NULLS LAST, id) AS INTEGER) AS place FROM m""")
def manual_order(spark, sf_dir):
    """What was ordered by hand first, the rest after it; places by ranges of a group."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, F.floor(F.col("c_custkey") / 7)).alias("manual"))
    return places(c, ["grp"], [F.asc_nulls_last("manual"), "id"], "place", Tables(spark, "manual")).select("grp", "id", "place")


@query("""SELECT artist FROM (SELECT s_nationkey AS artist FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def key_union(spark, sf_dir):
    """Artists known to any of three tables."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("artist"))
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("artist"))
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("artist"))
    return s.union(c).union(n).distinct()


@query("""SELECT n_nationkey AS artist, n_name AS name, r_name AS region, coalesce(s.n, 0) AS city, coalesce(c.n, 0) AS festival, s.first_name AS first_city FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n, min(s_name) AS first_name FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey""")
def artist_state(spark, sf_dir):
    """An artist with what three tables know of it."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("artist")).agg(F.count("*").alias("city"), F.min("s_name").alias("first_city"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("artist")).agg(F.count("*").alias("festival"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("artist"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return n.join(s, "artist", "left").join(c, "artist", "left").select("artist", "name", "region", F.coalesce("city", F.lit(0)).alias("city"), F.coalesce("festival", F.lit(0)).alias("festival"), "first_city")


@query("""SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END, ''), 'Unknown venue') AS venue, CASE WHEN c_acctbal > 0 THEN 'kept' ELSE 'filled' END AS how FROM customer""")
def fill_unknown(spark, sf_dir):
    """Empty fields get their default."""
    v = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(F.nullif(v, F.lit("")), F.lit("Unknown venue")).alias("venue"), F.when(F.col("c_acctbal") > 0, "kept").otherwise("filled").alias("how"))


@query("""WITH t AS (SELECT l_suppkey AS artist, l_partkey AS track, min(l_shipdate) AS released FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY released DESC, track) AS n FROM t)
SELECT artist, track, CAST(floor((n - 1) / 100) AS BIGINT) AS batch, CAST(n AS INTEGER) AS place FROM r""")
def sync_batches(spark, sf_dir):
    """All tracks per artist, newest first, in batches of a hundred."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("artist"), F.col("l_partkey").alias("track")).agg(F.min("l_shipdate").alias("released"))
    r = t.withColumn("place", F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("released"), "track")))
    return r.select("artist", "track", F.floor((F.col("place") - 1) / 100).cast("long").alias("batch"), "place")


@query("""SELECT l_suppkey AS artist, count(DISTINCT l_partkey) AS tracks, arg_max(l_partkey, l_shipdate * 1) AS last_track FROM (SELECT l_suppkey, l_partkey, epoch_us(l_shipdate)::HUGEINT * 1000000 + l_partkey AS l_shipdate FROM lineitem) GROUP BY l_suppkey""")
def tracks_by_artist(spark, sf_dir):
    """Tracks of an artist, the last one wins."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("artist")).agg(F.count_distinct("l_partkey").alias("tracks"), F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("last_track"))


@query("""SELECT c_custkey AS id, count(l_partkey) AS songs, least(greatest(count(DISTINCT l_partkey), 5), 20) AS quota FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def song_quota(spark, sf_dir):
    """Songs wanted of an artist, between two bounds."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    j = c.join(o, c["c_custkey"] == o["o_custkey"], "left").join(li, li["l_orderkey"] == o["o_orderkey"], "left")
    return j.groupBy(F.col("c_custkey").alias("id")).agg(F.count("l_partkey").alias("songs"), F.least(F.greatest(F.count_distinct("l_partkey"), F.lit(5)), F.lit(20)).cast("long").alias("quota"))


@query("""SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def followed_only(spark, sf_dir):
    """In one list and not in another."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.join(o.where("o_orderstatus = 'O'"), "id", "left_semi").join(o.where("o_orderstatus = 'P'"), "id", "left_anti")
