"""Set lists: plays, positions, tours and scores over one row per song of a concert.

A performance table has artist, concert, day, song, place (within the concert), encore, cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..session import tasks_for

ENCORE_OFFSET = 1000.0


def performances(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as concerts of a customer, their lines as songs; returned lines are covers, open ones encores."""
    o = orders.select(F.col("o_orderkey").alias("concert"), F.col("o_custkey").alias("artist"), F.col("o_orderdate").alias("day"))
    s = lineitem.select(
        F.col("l_orderkey").alias("concert"), F.col("l_partkey").alias("song"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("seq"),
        (F.col("l_linestatus") == "O").alias("encore"), (F.col("l_returnflag") == "R").alias("cover"),
    )
    tasks = tasks_for(lineitem)
    return o.repartition(tasks, "concert").join(s.repartition(tasks, "concert"), "concert")


def dealt(p: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows by ``keys`` in a number of tasks; as they are where none is given."""
    return p.repartition(tasks, *keys) if tasks else p


def plays(p: DataFrame, tasks: int = 0) -> DataFrame:
    """(artist, song, plays, total, frequency): own songs over concerts with any of them (one at least)."""
    own = dealt(p.where(~F.col("cover")), tasks, "artist")
    totals = own.groupBy("artist").agg(F.count_distinct("concert").alias("total"))
    n = own.groupBy("artist", "song").agg(F.count("*").alias("plays")).join(totals, "artist")
    return n.withColumn("frequency", F.round(F.col("plays").cast("double") / F.greatest("total", F.lit(1)), 2))


def running_positions(p: DataFrame) -> DataFrame:
    """Own songs numbered through a whole concert."""
    order = Window.partitionBy("concert").orderBy(*map(F.asc_nulls_last, ("place", "song", "seq")))
    return p.where(~F.col("cover")).withColumn("pos", F.row_number().over(order))


def histogram(positions: DataFrame, tasks: int = 0) -> DataFrame:
    return dealt(positions.select("artist", "song", "pos"), tasks, "artist", "song").groupBy("artist", "song", "pos").agg(F.count("*").alias("n"))


def mean_position(h: DataFrame) -> DataFrame:
    """(artist, song, mean_pos, low, high, modal): of a histogram; the smallest of equally frequent positions is modal."""
    return h.groupBy("artist", "song").agg(
        F.round(F.sum(F.col("pos") * F.col("n")).cast("double") / F.sum("n"), 6).alias("mean_pos"),
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.max_by("pos", F.struct("n", -F.col("pos"))).alias("modal"),
    )


def encore_positions(p: DataFrame) -> DataFrame:
    """Mean place among main or encore plays, whichever are more; encores come after, ties are main."""
    main = F.avg(F.when(~F.col("encore"), F.col("place")))
    enc = F.avg(F.when(F.col("encore"), F.col("place")))
    g = p.groupBy("artist", "song").agg(F.count_if("encore").alias("_e"), F.count_if(~F.col("encore")).alias("_m"), main.alias("_main"), enc.alias("_enc"))
    return g.select("artist", "song", (F.col("_e") > F.col("_m")).alias("is_encore"), F.round(F.when(F.col("_e") > F.col("_m"), F.col("_enc") + ENCORE_OFFSET).otherwise(F.col("_main")), 6).alias("avg_pos"))


def new_songs(p: DataFrame, newest: int = 2, before: int = 8, least: int = 3) -> DataFrame:
    """(artist, song): own songs of the newest concerts that the concerts before them lack."""
    shows = p.select("artist", "concert", "day").distinct()
    nth = F.row_number().over(Window.partitionBy("artist").orderBy(F.desc("day"), F.desc("concert")))
    shows = shows.withColumn("nth", nth).where(F.col("nth") <= newest + before)
    enough = shows.groupBy("artist").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("artist")
    songs = p.join(shows.join(enough, "artist", "left_semi").select("concert", "nth"), "concert")
    recent = songs.where((F.col("nth") <= newest) & ~F.col("cover")).select("artist", "song").distinct()
    return recent.join(songs.where(F.col("nth") > newest).select("artist", "song").distinct(), ["artist", "song"], "left_anti")


def sources(p: DataFrame, tasks: int = 0) -> DataFrame:
    """(artist, song, sources, streamed, freq): concerts that name a song, and its share of own plays as in ``plays``, 0 without."""
    by_artist = dealt(p, tasks, "artist")
    totals = by_artist.groupBy(F.col("artist").alias("_artist")).agg(F.count_distinct(F.when(~F.col("cover"), F.col("concert"))).alias("_total"))
    s = by_artist.groupBy("artist", "song").agg(F.count_distinct("concert").alias("sources"), (F.max("place") >= 5).alias("streamed"), F.count_if(~F.col("cover")).alias("_plays"))
    named = F.col("artist").isNotNull() & F.col("song").isNotNull()  # without a key there is no frequency
    freq = F.round(F.col("_plays").cast("double") / F.greatest("_total", F.lit(1)), 2)
    return s.join(totals, F.col("artist") == F.col("_artist"), "left").select("artist", "song", "sources", "streamed", F.when(named, F.coalesce(freq, F.lit(0.0))).otherwise(0.0).alias("freq"))


# Badges in the order in which songs are shown.
BADGES = ("setlist", "prediction_hoch", "prediction_mittel", "prediction_niedrig", "spotify")


def badge(frequency: Column, streamed: Column, sources: Column) -> tuple[Column, Column]:
    """Badge and score: played songs by frequency, songs that are only streamed, others by how many sources name them."""
    name = F.when(frequency > 0, "setlist").when(streamed, "spotify").when(sources >= 2, "prediction_hoch").when(sources == 1, "prediction_mittel").otherwise("prediction_niedrig")
    score = F.when(frequency > 0, F.round(frequency, 2)).when(streamed, 0.1).when(sources >= 2, 0.55).when(sources == 1, 0.35).otherwise(0.15)
    return name, score


# Words of festivals in names of venues, and in names of tours and venues; songs up to which a set is short.
FESTIVAL_VENUES = (
    "festival", "open air", "open-air", "rock im park", "rock am ring", "wacken", "hurricane", "southside", "download", "hellfest",
    "lollapalooza", "coachella", "reading", "leeds festival", "elbriot", "impericon", "copenhell",
)
FESTIVALS = (
    "festival", "open air", "open-air", "rock im park", "rock am ring", "wacken", "hurricane", "southside", "download", "hellfest",
    "lollapalooza", "coachella", "reading", "leeds", "elbriot", "impericon", "copenhell", "sonic temple", "knotfest",
)
SHORT, SHORT_WITHOUT_TOUR = 12, 20


def festival_short(venue: Column, songs: Column, most: int = SHORT, words=FESTIVAL_VENUES) -> Column:
    """A festival's set by its venue, or because it is short."""
    return contains_any(F.lower(F.coalesce(venue, F.lit(""))), words) | (F.coalesce(songs, F.lit(0)) <= most)


def festival_tourless(tour: Column, venue: Column, own: Column, most: int = SHORT_WITHOUT_TOUR, words=FESTIVALS) -> Column:
    """A festival's set by tour or venue, or because it has no tour and few songs of the artist's own."""
    tour, venue = (F.lower(F.coalesce(c, F.lit(""))) for c in (tour, venue))
    return contains_any(tour, words) | contains_any(venue, words) | ((tour == "") & (F.coalesce(own, F.lit(0)) <= most))
