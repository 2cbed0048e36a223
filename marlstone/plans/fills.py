"""Lists that are filled until they have enough, places within a radius, and ledgers of months."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fills, geo
from ..scratch import Tables
from ..session import table
from .registry import query

NEEDED, SETLIST, NEW, MOST = 5, 4, 3, 12
_TRACKS = """SELECT o_custkey AS owner, o_orderkey AS "group", o_orderdate AS day, l_linenumber * 100000 + l_suppkey AS nth, l_partkey AS id, p_name AS title, l_returnflag, l_quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""


def _tracks(spark, sf_dir):
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    nth = (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("nth")
    return rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("group"), F.col("o_orderdate").cast("date").alias("day"), nth, F.col("l_partkey").alias("id"), F.col("p_name").alias("title"), "l_returnflag", "l_quantity")


@query(f"""WITH t AS ({_TRACKS}), known AS (SELECT DISTINCT owner, lower(title) AS k FROM t WHERE l_quantity < 5),
n AS (SELECT * FROM t WHERE l_returnflag <> 'R' AND (owner, lower(title)) NOT IN (SELECT (owner, k) FROM known)),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY owner, lower(title) ORDER BY day DESC, "group", nth, title) = 1)
SELECT owner, title, "group", row_number() OVER (PARTITION BY owner ORDER BY day DESC, "group", nth, title) AS rank FROM f QUALIFY rank <= {NEEDED}""")
def new_releases(spark, sf_dir):
    """An owner's newest titles that are no returns (live ones) and not known, until there are enough."""
    t = _tracks(spark, sf_dir)
    known = t.where("l_quantity < 5").select("owner", F.lower("title").alias("_k")).distinct()
    new = t.where("l_returnflag <> 'R'").join(known, (t["owner"] == known["owner"]) & (F.lower(t["title"]) == known["_k"]), "left_anti")
    return fills.until_enough(new.select("owner", "group", "day", "nth", "title"), NEEDED, Tables(spark, "releases"))


@query(f"""WITH t AS ({_TRACKS}),
a AS (SELECT owner, id, min(nth + "group" * 1000000000) AS nth FROM t WHERE l_quantity > 40 GROUP BY ALL),
c0 AS (SELECT owner, id, 0 AS tier, row_number() OVER (PARTITION BY owner ORDER BY nth, id) AS rank FROM a QUALIFY rank <= {SETLIST}),
h0 AS (SELECT owner, count(*) AS have FROM c0 GROUP BY owner),
b AS (SELECT owner, id, min(nth + "group" * 1000000000) AS nth FROM t WHERE l_returnflag = 'A' AND (owner, id) NOT IN (SELECT (owner, id) FROM c0) GROUP BY ALL),
c1 AS (SELECT b.owner, id, 1 AS tier, row_number() OVER (PARTITION BY b.owner ORDER BY nth, id) + coalesce(have, 0) AS rank FROM b LEFT JOIN h0 USING (owner) QUALIFY rank <= {SETLIST + NEW}),
u AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1), h1 AS (SELECT owner, count(*) AS have FROM u GROUP BY owner),
d AS (SELECT owner, id, min(nth + "group" * 1000000000) AS nth FROM t WHERE (owner, id) NOT IN (SELECT (owner, id) FROM u) GROUP BY ALL),
c2 AS (SELECT d.owner, id, 2 AS tier, row_number() OVER (PARTITION BY d.owner ORDER BY nth, id) + coalesce(have, 0) AS rank FROM d LEFT JOIN h1 USING (owner) QUALIFY rank <= {MOST})
SELECT owner, id, CAST(tier AS INTEGER) AS tier, rank FROM (SELECT * FROM u UNION ALL SELECT * FROM c2)""")
def track_fill(spark, sf_dir):
    """An owner's tracks: set list, then new ones, then all in order, each tier taking what room is left."""
    t = _tracks(spark, sf_dir).withColumn("nth", F.col("nth") + F.col("group") * 1000000000)
    return fills.tiers_of(t, [(F.expr("l_quantity > 40"), SETLIST), (F.expr("l_returnflag = 'A'"), SETLIST + NEW), (F.lit(True), MOST)], Tables(spark, "fill"))


_LAT, _LON = "47 + ({k} * 7919 % 8000) / 1000.0::DOUBLE", "6 + ({k} * 104729 % 9000) / 1000.0::DOUBLE"
_H = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"
KM = 50.0


@query(f"""WITH a AS (SELECT c_custkey AS a, {_LAT.format(k="c_custkey")} AS lat, {_LON.format(k="c_custkey")} AS lon, lower(n_name) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
b AS (SELECT s_suppkey AS b, CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE {_LAT.format(k="s_suppkey")} END AS lat, CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE {_LON.format(k="s_suppkey")} END AS lon,
  lower('near ' || n_name || ' city') AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT a, b, round(2 * 6371.0::DOUBLE * atan2(sqrt({_H}), sqrt(1.0::DOUBLE - ({_H}))), 6) AS km FROM a JOIN b ON b.lat <> 0 AND abs(a.lat - b.lat) < 0.6 AND 2 * 6371.0::DOUBLE * atan2(sqrt({_H}), sqrt(1.0::DOUBLE - ({_H}))) <= {KM}
UNION ALL SELECT a, b, NULL FROM a JOIN b ON b.lat = 0 AND contains(city, name)""")
def suppliers_near(spark, sf_dir):
    """Suppliers within 50 km of each customer, by the name of the nation where coordinates are missing."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lat = lambda k: F.lit(47) + F.col(k) * 7919 % 8000 / F.lit(1000.0)
    lon = lambda k: F.lit(6) + F.col(k) * 104729 % 9000 / F.lit(1000.0)
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("a"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), F.col("n_name").alias("name"))
    lost = F.col("s_suppkey") % 11 == 0
    b = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("b"), F.when(lost, 0.0).otherwise(lat("s_suppkey")).alias("lat"), F.when(lost, 0.0).otherwise(lon("s_suppkey")).alias("lon"), F.concat(F.lit("near "), "n_name", F.lit(" city")).alias("city"))
    return geo.near_or_named(a.select("a", "lat", "lon"), a.select("a", "name"), b, KM, 6)


@query("""WITH e AS (SELECT user_id, date_trunc('month', ts + to_months(CAST(event_id % 5 AS INTEGER)))::DATE AS month, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
m AS (SELECT user_id, month, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, month, cents, n, CAST(sum(cents) OVER w AS BIGINT) AS total_cents, CAST(sum(n) OVER w AS BIGINT) AS total_n FROM m WINDOW w AS (PARTITION BY user_id ORDER BY month)""")
def ledger_of_months(spark, sf_dir):
    """Counters that begin anew each month, beside those of all time; events are dealt over five months."""
    month = F.trunc(F.col("ts") + F.make_interval(F.lit(0), (F.col("event_id") % 5).cast("int")), "month")
    e = table(spark, sf_dir, "events").select("user_id", month.alias("month"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    m = e.groupBy("user_id", "month").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("month")  # a row per month of a user
    return m.select("user_id", "month", "cents", "n", F.sum("cents").over(w).alias("total_cents"), F.sum("n").over(w).alias("total_n"))
