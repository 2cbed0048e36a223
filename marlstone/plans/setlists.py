"""Set-list statistics over orders (concerts) and their lines (songs)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import setlists as S
from ..session import table, tasks_for
from .registry import query

AS_OF = "2001-08-01"
_P = """SELECT o_custkey AS artist, o_orderkey AS concert, o_orderdate AS day, l_partkey AS song, l_linenumber AS place, l_suppkey AS seq,
        l_linestatus = 'O' AS encore, l_returnflag = 'R' AS cover FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
_RUN = f"SELECT *, row_number() OVER (PARTITION BY concert ORDER BY place, song, seq) AS pos FROM ({_P}) WHERE NOT cover"
_PLAYS = f"""SELECT artist, song, count(*) AS plays, any_value(total) AS total, round(count(*)::DOUBLE / greatest(any_value(total), 1), 2) AS frequency
FROM ({_P}) JOIN (SELECT artist AS a, count(DISTINCT concert) AS total FROM ({_P}) WHERE NOT cover GROUP BY artist) ON a = artist WHERE NOT cover GROUP BY artist, song"""


def _p(spark, sf_dir):
    return S.performances(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _tasks(spark, sf_dir):
    return tasks_for(table(spark, sf_dir, "lineitem"))


@query(_PLAYS)
def play_counts(spark, sf_dir):
    """A4, A5, A6, R15."""
    return S.plays(_p(spark, sf_dir), _tasks(spark, sf_dir)).select("artist", "song", "plays", "total", "frequency")


@query(f"SELECT artist, song, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM ({_RUN}) GROUP BY ALL")
def position_histogram_running(spark, sf_dir):
    """A8, W3."""
    return S.histogram(S.running_positions(_p(spark, sf_dir)), _tasks(spark, sf_dir))


@query(f"SELECT artist, song, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY concert, encore ORDER BY place, song, seq) AS pos FROM ({_P})) GROUP BY ALL")
def position_histogram_per_set(spark, sf_dir):
    """Positions start again in every set of a concert."""
    order = Window.partitionBy("concert", "encore").orderBy(*map(F.asc_nulls_last, ("place", "song", "seq")))
    return S.histogram(_p(spark, sf_dir).withColumn("pos", F.row_number().over(order)), _tasks(spark, sf_dir))


@query(f"""SELECT artist, song, count(CASE WHEN encore THEN 1 END) > count(CASE WHEN NOT encore THEN 1 END) AS is_encore,
round(CASE WHEN count(CASE WHEN encore THEN 1 END) > count(CASE WHEN NOT encore THEN 1 END) THEN avg(place) FILTER (encore) + 1000.0 ELSE avg(place) FILTER (NOT encore) END, 6) AS avg_pos FROM ({_P}) GROUP BY artist, song""")
def encore_majority_position(spark, sf_dir):
    """A9, F47."""
    return S.encore_positions(_p(spark, sf_dir))


@query(f"""WITH h AS (SELECT artist, song, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM ({_RUN}) GROUP BY ALL)
SELECT artist, song, round(sum(pos * n)::DOUBLE / sum(n)::DOUBLE, 6) AS mean_pos, min(pos) AS low, max(pos) AS high, arg_max(pos, n * 1000 - pos) AS modal FROM h GROUP BY artist, song""")
def modal_position_order(spark, sf_dir):
    """A10, A11, A13."""
    return S.mean_position(S.histogram(S.running_positions(_p(spark, sf_dir)), _tasks(spark, sf_dir)))


@query(f"""SELECT o_custkey AS artist, o_orderpriority AS tour, count(*) AS shows, min(o_orderdate) AS first, max(o_orderdate) AS last,
date_diff('day', max(o_orderdate)::DATE, DATE '{AS_OF}') < 210 AS active FROM orders WHERE o_orderpriority <> '' GROUP BY ALL""")
def tour_options(spark, sf_dir):
    """A12, R21."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> ''")
    g = o.groupBy(F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("tour")).agg(F.count("*").alias("shows"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return g.withColumn("active", F.datediff(F.lit(AS_OF).cast("date"), F.col("last").cast("date")) < 210)


@query(f"""WITH p AS ({_P}), s AS (SELECT DISTINCT artist, concert, day FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY day DESC, concert DESC) AS nth FROM s QUALIFY nth <= 10),
e AS (SELECT artist FROM r GROUP BY artist HAVING count(*) >= 3),
x AS (SELECT p.*, r.nth FROM p JOIN r USING (concert) WHERE r.artist IN (SELECT artist FROM e))
SELECT DISTINCT artist, song FROM x WHERE nth <= 2 AND NOT cover EXCEPT SELECT artist, song FROM x WHERE nth > 2""")
def new_songs_recent(spark, sf_dir):
    """R22, W6."""
    return S.new_songs(_p(spark, sf_dir))


@query(f"""SELECT artist, song, plays, CAST(row_number() OVER (PARTITION BY artist ORDER BY CASE WHEN plays > 1 THEN 0 ELSE 1 END, plays DESC, frequency DESC, song) AS INTEGER) AS place
FROM ({_PLAYS}) QUALIFY place <= 5""")
def display_order_two_tier(spark, sf_dir):
    """Often played first, then by score, limited per artist."""
    order = Window.partitionBy("artist").orderBy(F.when(F.col("plays") > 1, 0).otherwise(1), F.desc("plays"), F.desc("frequency"), F.asc_nulls_last("song"))
    return S.plays(_p(spark, sf_dir), _tasks(spark, sf_dir)).withColumn("place", F.row_number().over(order)).where("place <= 5").select("artist", "song", "plays", "place")


@query(f"""WITH f AS ({_PLAYS}), s AS (SELECT artist, song, count(DISTINCT concert) AS sources, max(place) >= 5 AS streamed FROM ({_P}) GROUP BY artist, song),
b AS (SELECT s.artist, s.song, coalesce(frequency, 0) AS freq, sources, CASE WHEN streamed AND coalesce(frequency, 0) = 0 THEN 'spotify' WHEN coalesce(frequency, 0) > 0 THEN 'setlist'
  WHEN sources >= 2 THEN 'prediction_hoch' WHEN sources = 1 THEN 'prediction_mittel' ELSE 'prediction_niedrig' END AS badge FROM s LEFT JOIN f ON f.artist = s.artist AND f.song = s.song)
SELECT artist, song, badge, CASE badge WHEN 'spotify' THEN 0.1::DOUBLE WHEN 'setlist' THEN freq WHEN 'prediction_hoch' THEN 0.55::DOUBLE WHEN 'prediction_mittel' THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END AS score,
  CAST(row_number() OVER (PARTITION BY artist ORDER BY CASE badge WHEN 'setlist' THEN 0 WHEN 'prediction_hoch' THEN 1 WHEN 'prediction_mittel' THEN 2 WHEN 'prediction_niedrig' THEN 3 ELSE 4 END, freq DESC, song) AS INTEGER) AS place FROM b""")
def confidence_badges(spark, sf_dir):
    """Badge and score by frequency, streams and the number of sources, in the order of badges."""
    s = S.sources(_p(spark, sf_dir), _tasks(spark, sf_dir))
    badge, score = S.badge(F.col("freq"), F.col("streamed"), F.col("sources"))
    rank = F.array_position(F.array(*map(F.lit, S.BADGES)), F.col("badge"))
    order = Window.partitionBy("artist").orderBy(rank, F.desc("freq"), F.asc_nulls_last("song"))
    return s.withColumns({"badge": badge, "score": score}).select("artist", "song", "badge", "score", F.row_number().over(order).alias("place"))


@query(f"SELECT artist, song, frequency, frequency >= 0.75 AS core, frequency >= 0.25 AS best_of, frequency >= 0.5 AS likely FROM ({_PLAYS})")
def core_and_best_of(spark, sf_dir):
    """P13, P14, P15."""
    f = F.col("frequency")
    return S.plays(_p(spark, sf_dir), _tasks(spark, sf_dir)).select("artist", "song", "frequency", (f >= 0.75).alias("core"), (f >= 0.25).alias("best_of"), (f >= 0.5).alias("likely"))


_SHOWS = """SELECT o_custkey * 10 + year(o_orderdate) // 3 % 10 AS concert, o_custkey AS artist, l_returnflag = 'R' AS cover FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
_VENUE = "CASE artist % 9 WHEN 0 THEN 'Wacken Open Air' WHEN 1 THEN 'The Festival Hall' ELSE 'Docks' END"
_TOUR = "CASE artist % 7 WHEN 0 THEN '' WHEN 1 THEN 'Download 2026' WHEN 2 THEN '' ELSE 'World Tour' END"
_ANY = lambda text, words: "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@query(f"""WITH c AS (SELECT concert, artist, count(*) AS songs, count(CASE WHEN NOT cover THEN 1 END) AS own, {_VENUE} AS venue, {_TOUR} AS tour FROM ({_SHOWS}) GROUP BY concert, artist)
SELECT concert, artist, {_ANY("venue", S.FESTIVAL_VENUES)} OR songs <= 12 AS festival_short, {_ANY("tour", S.FESTIVALS)} OR {_ANY("venue", S.FESTIVALS)} OR (tour = '' AND own <= 20) AS festival_tourless FROM c""")
def festival_classifiers(spark, sf_dir):
    """Both classifiers, named apart, with their words and bounds; a concert is an artist's three years here."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select((F.col("o_custkey") * 10 + F.floor(F.year("o_orderdate") / 3) % 10).alias("concert"), F.col("o_custkey").alias("artist"), (F.col("l_returnflag") == "R").alias("cover"))
    c = shows.groupBy("concert", "artist").agg(F.count("*").alias("songs"), F.count_if(~F.col("cover")).alias("own")).withColumns({"venue": F.expr(_VENUE), "tour": F.expr(_TOUR)})
    return c.select("concert", "artist", S.festival_short(F.col("venue"), F.col("songs")).alias("festival_short"), S.festival_tourless(F.col("tour"), F.col("venue"), F.col("own")).alias("festival_tourless"))


@query(f"""SELECT artist, count(*) AS songs, count(CASE WHEN plays > 1 THEN 1 END) AS played, max(total) AS concerts, bool_or(frequency >= 0.75) AS has_core FROM ({_PLAYS}) GROUP BY artist""")
def setlist_summary(spark, sf_dir):
    """A19."""
    return S.plays(_p(spark, sf_dir), _tasks(spark, sf_dir)).groupBy("artist").agg(F.count("*").alias("songs"), F.count_if(F.col("plays") > 1).alias("played"), F.max("total").alias("concerts"), F.bool_or(F.col("frequency") >= 0.75).alias("has_core"))


@query("""WITH r AS (SELECT o_custkey AS artist, o_orderpriority AS tour, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT artist, arg_min(tour, n) AS tour FROM r WHERE n <= 5 AND tour <> '4-NOT SPECIFIED' GROUP BY artist""")
def latest_tour_name(spark, sf_dir):
    """The first named tour among the newest five concerts."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("tour"), n.alias("n"))
    return r.where("n <= 5 and tour <> '4-NOT SPECIFIED'").groupBy("artist").agg(F.min_by("tour", "n").alias("tour"))
