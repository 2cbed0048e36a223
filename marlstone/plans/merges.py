"""Merging sources, differencing lists, de-duplication by key, matching names and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fact_key, name_key
from ..operators import merging as M
from ..session import table
from .registry import query

_FACT = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"
_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[-_/&+.]', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(k) AS key_hash, n FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT doc_id, {_FACT} AS k FROM documents)) WHERE r = 1")
def normalised_text_dedup(spark, sf_dir):
    """Of texts with equal keys the oldest stays. Only a hash of the key is shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(fact_key(F.col("text")).cast("binary")).alias("key_hash"))
    return d.groupBy("key_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "key_hash", "n")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY substr(text, 1, 120)")
def prefix_dedup(spark, sf_dir):
    """Hits with the same first 120 characters count once."""
    return table(spark, sf_dir, "documents").groupBy(F.substring("text", 1, 120).alias("_k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("_k")


_LISTS = """SELECT o_custkey AS artist, l_partkey AS title, l_orderkey AS seq, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


@query(f"""WITH a AS ({_LISTS}), o AS (SELECT DISTINCT artist, title FROM a WHERE old), n AS (SELECT DISTINCT artist, title FROM a WHERE NOT old)
SELECT a.artist, a.title, a.seq, CASE WHEN a.old THEN 'removed' WHEN o.title IS NULL THEN 'added' ELSE 'unchanged' END AS change
FROM a LEFT JOIN o ON o.artist = a.artist AND o.title = a.title LEFT JOIN n ON n.artist = a.artist AND n.title = a.title WHERE NOT a.old OR n.title IS NULL""")
def playlist_diff(spark, sf_dir):
    """What changed between two lists per artist; repeats stay."""
    rows = _whole_lists(spark, sf_dir)
    return M.list_diff(rows.where("old").drop("old"), rows.where("not old").drop("old"), ["artist"], "title").select("artist", "title", "seq", "change")


@query(f"""WITH a AS ({_LISTS}), t AS (SELECT artist, old, array_agg(title ORDER BY seq, title) AS titles FROM a GROUP BY artist, old)
SELECT x.artist, x.titles = y.titles AS same_list, list_sort(x.titles) = list_sort(y.titles) AS same_songs FROM t x JOIN t y ON x.artist = y.artist AND x.old AND NOT y.old""")
def exact_list_match(spark, sf_dir):
    """Equal lists, and lists that are permutations of each other."""
    return M.same_lists(_whole_lists(spark, sf_dir), "artist", "title", "seq", "old")


_WHOLE = """SELECT o_custkey AS artist, l_partkey AS title, l_orderkey AS seq, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def _whole_lists(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("artist"), F.col("l_partkey").alias("title"), F.col("l_orderkey").alias("seq"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("old"))


@query(f"""WITH a AS ({_WHOLE}), o AS (SELECT DISTINCT artist, title FROM a WHERE old), n AS (SELECT DISTINCT artist, title FROM a WHERE NOT old)
SELECT a.artist, a.title, a.seq, CASE WHEN a.old THEN 'removed' WHEN o.title IS NULL THEN 'added' ELSE 'unchanged' END AS change
FROM a LEFT JOIN o ON o.artist = a.artist AND o.title = a.title LEFT JOIN n ON n.artist = a.artist AND n.title = a.title WHERE NOT a.old OR n.title IS NULL""")
def playlist_diff_whole(spark, sf_dir):
    """playlist_diff over all lines of the lists."""
    rows = _whole_lists(spark, sf_dir)
    return M.list_diff(rows.where("old").drop("old"), rows.where("not old").drop("old"), ["artist"], "title").select("artist", "title", "seq", "change")


@query(f"""WITH a AS ({_WHOLE}), t AS (SELECT artist, old, array_agg(title ORDER BY seq, title) AS titles FROM a GROUP BY artist, old)
SELECT x.artist, x.titles = y.titles AS same_list, list_sort(x.titles) = list_sort(y.titles) AS same_songs FROM t x JOIN t y ON x.artist = y.artist AND x.old AND NOT y.old""")
def exact_list_match_whole(spark, sf_dir):
    """exact_list_match over all lines of the lists."""
    return M.same_lists(_whole_lists(spark, sf_dir), "artist", "title", "seq", "old")


@query("""WITH e AS (SELECT s_nationkey AS artist, s_suppkey % 40 AS slot, 1 AS source_rank, s_name AS venue, s_suppkey AS seq FROM supplier
  UNION ALL SELECT c_nationkey, c_custkey % 40, 2, c_name, c_custkey FROM customer)
SELECT artist, slot, arg_min(venue, source_rank * 1000000000 + seq) AS first_venue, arg_max(venue, length(venue) * 10000000000 - source_rank * 1000000000 - seq) AS longest_venue, count(*) AS n FROM e GROUP BY artist, slot""")
def multi_source_merge(spark, sf_dir):
    """Per artist and slot the first source wins, and the longest venue name, first on ties."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("artist"), (F.col("s_suppkey") % 40).alias("slot"), F.lit(1).alias("source_rank"), F.col("s_name").alias("venue"), F.col("s_suppkey").alias("seq"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("artist"), (F.col("c_custkey") % 40).alias("slot"), F.lit(2).alias("source_rank"), F.col("c_name").alias("venue"), F.col("c_custkey").alias("seq"))
    return s.unionByName(c).groupBy("artist", "slot").agg(
        F.min_by("venue", F.struct("source_rank", "seq")).alias("first_venue"),
        F.max_by("venue", F.struct(F.length("venue"), -F.col("source_rank"), -F.col("seq"))).alias("longest_venue"), F.count("*").alias("n"),
    )


@query("SELECT min(c_custkey) AS custkey, day, venue FROM (SELECT c_custkey, c_nationkey AS day, substr(lower(trim(coalesce(c_mktsegment, ''))), 1, 40) AS venue FROM customer) GROUP BY day, venue")
def venue_prefix_dedup(spark, sf_dir):
    """One event per day and start of the venue's name."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("day"), F.substring(F.lower(F.trim(F.coalesce("c_mktsegment", F.lit("")))), 1, 40).alias("venue")).agg(F.min("c_custkey").alias("custkey")).select("custkey", "day", "venue")


@query("""SELECT s_nationkey AS artist, s_name AS name, 'city' AS kind FROM supplier
UNION ALL SELECT c_nationkey, c_name, 'festival' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def precedence_union(spark, sf_dir):
    """City rows win; festival rows only for artists without any."""
    city = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("artist"), F.col("s_name").alias("name"), F.lit("city").alias("kind"))
    fest = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("artist"), F.col("c_name").alias("name"), F.lit("festival").alias("kind"))
    return M.precedence_union(city, fest, "artist")


_PART = _NAME.replace("{c}", "p_name")


@query(f"""WITH n AS (SELECT DISTINCT {_PART} AS name FROM part),
k AS (SELECT DISTINCT split_part({_PART}, ' ', 1) AS key FROM part),
e AS (SELECT name, name AS matched, 'exact' AS kind FROM n WHERE name IN (SELECT key FROM k)),
c AS (SELECT name, min(key) AS matched, 'contains' AS kind FROM n JOIN k ON contains(name, key) WHERE name NOT IN (SELECT key FROM k) GROUP BY name)
SELECT * FROM e UNION ALL SELECT * FROM c""")
def name_match_exact_then_contains(spark, sf_dir):
    """Names against the first words of all names, exact first."""
    p = table(spark, sf_dir, "part").select(name_key(F.col("p_name")).alias("name"))
    watch = p.select(F.substring_index("name", " ", 1).alias("key")).distinct()
    return M.exact_then_contained(p.select("name").distinct(), watch, "name", "key")


@query(f"""WITH n AS (SELECT {_PART} AS name FROM part UNION SELECT {_NAME.replace("{c}", "s_name")} FROM supplier),
k AS (SELECT DISTINCT split_part({_PART}, ' ', 1) AS key FROM part UNION SELECT {_NAME.replace("{c}", "s_name")} FROM supplier),
e AS (SELECT name, name AS matched, 'exact' AS kind FROM n WHERE name IN (SELECT key FROM k)),
c AS (SELECT name, min(key) AS matched, 'contains' AS kind FROM n JOIN k ON contains(name, key) WHERE name NOT IN (SELECT key FROM k) GROUP BY name)
SELECT * FROM e UNION ALL SELECT * FROM c""")
def name_match_whole(spark, sf_dir):
    """The names of all parts and suppliers against all suppliers and all first words of parts, exact first."""
    p = table(spark, sf_dir, "part").select(name_key(F.col("p_name")).alias("name"))
    s = table(spark, sf_dir, "supplier").select(name_key(F.col("s_name")).alias("name"))
    keys = p.select(F.substring_index("name", " ", 1).alias("key")).union(s)
    return M.exact_then_contained(p.union(s).distinct(), keys, "name", "key")


_LAT, _LON = "(n_nationkey * 7 % 120 - 60)::DOUBLE", "(n_nationkey * 13 % 300 - 150)::DOUBLE"
_KM = "2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"


@query(f"""WITH g AS (SELECT n_nationkey AS id, n_name AS name, {_LAT} AS lat, {_LON} AS lon FROM nation),
d AS (SELECT a.id AS a, b.id AS b, a.name, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM g a JOIN g b ON a.id < b.id)
SELECT a, b, round({_KM}, 3) AS km FROM d WHERE {_KM} <= 3000""")
def haversine_radius(spark, sf_dir):
    """Pairs of places within a radius, over the 25 nations with coordinates made from their keys."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 300 - 150).cast("double").alias("lon"))
    a, b = n.toDF("a", "lat1", "lon1"), n.toDF("b", "lat2", "lon2")
    km = M.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).withColumn("km", km).where("km <= 3000").select("a", "b", F.round("km", 3).alias("km"))


@query("""WITH log AS (SELECT user_id AS id, event_type AS name, ts, event_id, event_type = 'logout' OR value < 5 AS deleted FROM events)
SELECT id, name, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1 AND NOT deleted""")
def latest_wins(spark, sf_dir):
    """The table left by a log of upserts and deletes."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "ts", "event_id", ((F.col("event_type") == "logout") | (F.col("value") < 5)).alias("deleted"))
    return M.latest(log, ["id", "name"], [F.desc("ts"), F.desc("event_id")])


@query("""SELECT o_custkey AS artist, count(DISTINCT o_orderkey) AS lists, count(DISTINCT l_partkey) AS songs, count(DISTINCT l_partkey) FILTER (p_size > 25) AS missing,
CASE WHEN o_custkey % 5 = 0 THEN 'new' WHEN count(DISTINCT l_partkey) FILTER (p_size <= 25) = 0 THEN 'adds lists' WHEN count(DISTINCT l_partkey) FILTER (p_size > 25) > 0 THEN 'adds songs' ELSE 'complete' END AS action
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey""")
def import_preview(spark, sf_dir):
    """What an import would do, by four labels: a new artist, first lists, missing songs, or nothing."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"]).join(p, p["p_partkey"] == li["l_partkey"])
    g = j.groupBy(F.col("o_custkey").alias("artist")).agg(
        F.count_distinct("o_orderkey").alias("lists"), F.count_distinct("l_partkey").alias("songs"),
        F.count_distinct(F.when(F.col("p_size") > 25, F.col("l_partkey"))).alias("missing"), F.count_distinct(F.when(F.col("p_size") <= 25, F.col("l_partkey"))).alias("_have"),
    )
    return g.withColumn("action", F.when(F.col("artist") % 5 == 0, "new").when(F.col("_have") == 0, "adds lists").when(F.col("missing") > 0, "adds songs").otherwise("complete")).drop("_have")
