"""Filling a list per owner until it has enough, in order and without repeats.

Ranks run over ranges of the order (``operators.running``), or owners with many rows are dealt into shares of which only the
first rows go on, so no owner is one task's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Tables
from ..session import tasks_for
from .running import in_order, running

#: Rows of an owner that are held at once, about.
SHARE = 4096


def _ranked(rows: DataFrame, by: list, tables: Tables, name: str) -> DataFrame:
    placed = tables.save(in_order(rows, by), name)
    return running(placed, ["owner"], "bucket", ["place"], {"rank": ("count", F.lit(1))})


def until_enough(tracks: DataFrame, needed: int, tables: Tables, whole: bool = False) -> DataFrame:
    """(owner, title, group, rank): different titles of each owner, newest group first, until ``needed`` are there.

    ``tracks``: owner, group, day (of the group), nth (in the group), title. A title counts where it comes first, case
    aside. With ``whole`` a group that is begun is given as a whole, as reading stops only at the border of a group.
    """
    at = F.struct(F.datediff(F.lit("9999-12-31").cast("date"), F.col("day")).alias("age"), "group", "nth", "title")
    first = tracks.groupBy("owner", F.lower("title").alias("_key")).agg(F.min(at).alias("_at")).select("owner", "_at.*")
    ranked = tables.save(_ranked(first, ["owner", "age", "group", "nth", "title"], tables, "tracks"), "ranked")
    if not whole:
        return ranked.where(F.col("rank") <= needed).select("owner", "title", "group", "rank")
    sizes = ranked.groupBy("owner", "group").agg(F.min("rank").alias("_first"))
    begun = sizes.where(F.col("_first") <= needed).select("owner", "group")
    return ranked.join(begun, ["owner", "group"], "left_semi").select("owner", "title", "group", "rank")


def in_tiers(tiers: list[tuple[DataFrame, int]], tables: Tables) -> DataFrame:
    """``tiers_of``, where each tier is (rows of owner, id, nth; how many the list has at most when the tier is done)."""
    rows = [t.select("owner", "id", "nth", F.lit(n).alias("_tier")) for n, (t, _) in enumerate(tiers)]
    return tiers_of(reduce(DataFrame.unionByName, rows), [(F.col("_tier") == n, most) for n, (_, most) in enumerate(tiers)], tables)


def tiers_of(rows: DataFrame, tiers: list[tuple[Column, int]], tables: Tables) -> DataFrame:
    """(owner, id, tier, rank): ids of each owner from several ordered lists, the first ones first.

    ``rows``: owner, id, nth, and what the tiers ask for. Each tier is (which rows; how many the list has at most when the
    tier is done). A tier gives what those before left room for, without ids that they gave; an id that repeats in a tier
    counts where it comes first, a missing nth is last. For the missing owner nothing counts as given but its ids.

    Of a tier no more than its bound and those of the tiers before can be asked for. So each share of an owner's rows
    gives that many of each tier, and they are put together for the owner.
    """
    wanted = [F.coalesce(c, F.lit(False)).alias(f"_in{n}") for n, (c, _) in enumerate(tiers)]
    rows = tables.save(rows.select("owner", "id", "nth", *wanted), "rows")
    many = rows.groupBy(F.col("owner").alias("_owner")).agg(F.count("*").alias("_n")).where(F.col("_n") > SHARE)
    many = tables.save(many.select("_owner", F.ceil(F.col("_n") / SHARE).alias("_shares")), "many")
    key = ["owner"]
    if not many.isEmpty():
        key = ["owner", "_share"]
        rows = rows.join(many, F.col("owner").eqNullSafe(F.col("_owner")), "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_shares")), F.lit(0)))
    dealt = rows.repartition(tasks_for(rows), *key)
    first = dealt.groupBy(*key, "id").agg(*(f for n in range(len(tiers)) for f in (F.max(f"_in{n}").alias(f"_in{n}"), F.min(F.when(F.col(f"_in{n}"), F.col("nth"))).alias(f"_at{n}"))))
    place = lambda n: F.struct(F.col(f"_at{n}").isNull().alias("late"), F.col(f"_at{n}").alias("nth"), F.col("id").isNull().alias("none"), "id")
    room = [sum(most for _, most in tiers[: n + 1]) for n in range(len(tiers))]
    top = lambda n, lists: F.slice(F.sort_array(lists), 1, room[n]).alias(f"_t{n}")
    out = first.groupBy(*key).agg(*(top(n, F.collect_list(F.when(F.col(f"_in{n}"), place(n)))) for n in range(len(tiers))))
    if len(key) > 1:
        out = out.groupBy("owner").agg(*(top(n, F.flatten(F.collect_list(f"_t{n}"))) for n in range(len(tiers))))
    for n, (_, most) in enumerate(tiers):
        ids = F.col(f"_t{n}")["id"]
        out = out.withColumn(f"_have{n}", F.when(F.col("owner").isNull(), 0).otherwise(F.size("_given")) if n else F.lit(0))
        out = out.withColumn(f"_new{n}", F.slice(F.array_except(ids, "_given") if n else ids, F.lit(1), F.greatest(most - F.col(f"_have{n}"), F.lit(0))))
        out = out.withColumn("_given", F.concat("_given", f"_new{n}") if n else F.col("_new0"))
    every = lambda c: F.array(*(f"{c}{n}" for n in range(len(tiers))))
    out = out.select("owner", every("_have").alias("_have"), F.posexplode(every("_new")).alias("tier", "_ids"))
    out = out.select("owner", "tier", F.col("_have")[F.col("tier")].alias("_have"), F.posexplode("_ids").alias("_at", "id"))
    return out.select("owner", "id", "tier", (F.col("_have") + F.col("_at") + 1).cast("long").alias("rank"))
