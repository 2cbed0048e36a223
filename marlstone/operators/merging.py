"""Merging, differencing and latest-wins views; order is carried as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key. Keys may be expressions."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def precedence_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table that an append-only log of upserts and deletes (``deleted``) leaves."""
    return first_of(log, keys, order).where(~F.col("deleted")).drop("deleted")


def list_diff(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rows of both lists as added, removed or unchanged; repeats stay, order columns are kept."""
    on = [*keys, item]
    added = new.join(old.select(*on).distinct(), on, "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new.select(*on).distinct(), on, "left_anti").withColumn("change", F.lit("removed"))
    same = new.join(old.select(*on).distinct(), on, "left_semi").withColumn("change", F.lit("unchanged"))
    return added.unionByName(removed).unionByName(same)


def same_lists(rows: DataFrame, key: str, item: str, seq: str, old: str, width: int = 4096) -> DataFrame:
    """Per key with both lists (``old`` true and false): same_list, in the order of seq and item, and same_songs in any order.

    No list is gathered: places come from counts per block of ``width`` seqs, their running sums and a count
    inside the block, and both lists meet by place and by item.
    """
    r = rows.select(F.col(key), F.col(item).alias("_i"), F.col(seq).alias("_s"), F.col(old).alias("_o"), F.floor(F.col(seq) / width).alias("_b"))
    running = Window.partitionBy(key, "_o").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = r.groupBy(key, "_o", "_b").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_o", "_b").orderBy("_s", "_i"))
    placed = r.withColumn("_r", inside).join(starts, [key, "_o", "_b"]).select(key, "_i", "_o", (F.col("_from") + F.col("_r")).alias("_place"))
    n_old, n_new = F.count_if("_o"), F.count_if(~F.col("_o"))
    at = lambda o: F.min(F.when(F.col("_o") == o, F.col("_i")))
    ordered = placed.groupBy(key, "_place").agg((at(True).eqNullSafe(at(False)) & (n_old == n_new)).alias("_same"), n_old.alias("_x"), n_new.alias("_y"))
    ordered = ordered.groupBy(key).agg(F.bool_and("_same").alias("same_list"), F.sum("_x").alias("_x"), F.sum("_y").alias("_y")).where("_x > 0 and _y > 0")
    songs = r.groupBy(key, "_i").agg((n_old == n_new).alias("_same")).groupBy(key).agg(F.bool_and("_same").alias("same_songs"))
    return ordered.join(songs, key).select(key, "same_list", "same_songs")


def _pieces(text: Column, lengths: Column) -> Column:
    """The distinct substrings of the given lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), of)))


def exact_then_contained(names: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """Each name with the known key equal to it, else the first by text that it contains.

    Both are equi-joins: a contained key is a substring of the name with the length of a key. Only the distinct
    lengths of keys are broadcast, in one row.
    """
    watch = known.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    exact = names.join(watch, names[name] == watch["_k"], "left_semi").withColumn("matched", F.col(name)).withColumn("kind", F.lit("exact"))
    rest = names.join(watch, names[name] == watch["_k"], "left_anti")
    lengths = F.broadcast(watch.agg(F.collect_set(F.length("_k")).alias("_l")))
    # an empty name has no substring of length 1 or more, and only an empty key of length 0 is in it
    pieces = rest.select(F.col(name).alias("_name")).where("_name <> ''").distinct().crossJoin(lengths).select("_name", F.explode(_pieces(F.col("_name"), F.col("_l"))).alias("_k"))
    near = pieces.join(watch, "_k").groupBy("_name").agg(F.min("_k").alias("matched"))
    near = rest.join(near, rest[name] == near["_name"]).select(*names.columns, "matched", F.lit("contains").alias("kind"))
    return exact.unionByName(near)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
