"""Radius join of two growing tables of places.

Latitudes are cut into bands as high as the radius, and each band into cells of longitude that are at least as wide
as the radius reaches from any of its places. A place of one side is in one cell; a place of the other asks the cells that its
circle touches, in its band and the two beside it, across the date line too and all around near the poles. So the join is
by equal cells, and a pair meets once. Distances are checked exactly then.

Rows of a side at the same place are one block (several, where they are many), so a distance is reckoned once for two
blocks, and the pairs of rows are made where it was, without a shuffle. A cell with many rows is many keys: its
rows are dealt into shares, and each share of one side meets each of the other.

Places of the second side without coordinates (null, or 0 and 0) are matched by name instead: those whose city holds one
of the first side's names, found by an equi-join on parts of the city that are as long as a name. Rows of the same names
or cities are blocks there too, and only different names and cities are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Tables
from .merging import haversine_km

RADIUS_OF_EARTH = 6371.0
#: Room for rounding, in degrees.
EASE = 1e-6
#: Rows of a block at a place, of a block of the same names, and of one side under one key of the join, about.
BLOCK, NAMED, SHARE = 64, 256, 4096
#: Pairs of rows that one task tries, and tasks at most; a task's memory is that of a few blocks.
PAIRS, TASKS = 1 << 24, 4096


def _blocks(rows: DataFrame, member: str, by: list[str], size: int) -> DataFrame:
    """(*by, _block, rows): values of ``member`` that agree in ``by``, nulls too, about ``size`` in a list."""
    many = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    block = F.coalesce(F.pmod(F.xxhash64(member), F.ceil(F.col("_n") / size)), F.lit(0))  # copies of a value stay together
    listed = rows.join(many, by, "left").withColumn("_block", block).groupBy(*by, "_block").agg(F.collect_list(F.struct(member)).alias("rows"))
    return listed.withColumn("rows", F.transform("rows", lambda r: r[member]))


def _tasks(pairs) -> int:
    return min(TASKS, max(1, -(-int(pairs or 0) // PAIRS)))


def _cells_in(band: Column, high: float, reach: float) -> Column:
    """How many cells of longitude a band has."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90)) + high)  # the latitude of least width near it
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(reach)) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (wide + EASE))).cast("long")


def within_radius(a: DataFrame, b: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """Pairs of ``a`` (a, lat, lon) and ``b`` (b, lat, lon) at most ``km`` apart, with the distance, rounded to ``digits``
    where given; nulls meet nothing."""
    reach = km / RADIUS_OF_EARTH
    high = math.degrees(reach) + EASE
    bands = math.ceil(180 / high)
    band = lambda lat: F.least(F.floor((lat + 90) / high), F.lit(bands - 1)).cast("long")
    east = F.pmod(F.col("lon") + 180, F.lit(360.0))
    tables = Tables(a.sparkSession, "near")
    here = "lat is not null and lon is not null"

    placed = tables.save(_blocks(b.where(here).select("b", "lat", "lon"), "b", ["lat", "lon"], BLOCK), "b")
    placed = placed.select(F.col("rows").alias("_bs"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "_block", band(F.col("lat")).alias("band"), east.alias("_e"))
    placed = placed.withColumn("_n", _cells_in(F.col("band"), high, reach)).withColumn("cell", F.least(F.floor(F.col("_e") / 360 * F.col("_n")), F.col("_n") - 1).cast("long")).drop("_e", "_n")

    rows = tables.save(_blocks(a.where(here).select("a", "lat", "lon"), "a", ["lat", "lon"], BLOCK), "a")
    rows = rows.select(F.col("rows").alias("_as"), "lat", "lon", "_block", east.alias("_e"), band(F.col("lat")).alias("_at"))
    over_pole = F.abs("lat") + high >= 90
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(reach)) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9))))) + EASE
    asked = rows.withColumn("_d", F.when(over_pole, F.lit(180.0)).otherwise(F.least(side, F.lit(180.0))))
    asked = asked.withColumn("band", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).where(F.col("band").between(0, bands - 1))
    asked = asked.withColumn("_n", _cells_in(F.col("band"), high, reach))
    first, last = (F.floor((F.col("_e") + s * F.col("_d")) / 360 * F.col("_n")).cast("long") for s in (-1, 1))
    cells = F.when(last - first + 1 >= F.col("_n"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_n"))))
    asked = asked.select("_as", "lat", "lon", "_block", "band", F.explode(cells).alias("cell"))

    cell = ["band", "cell"]
    sizes = asked.groupBy(*cell).agg(F.sum(F.size("_as")).alias("_na")).join(placed.groupBy(*cell).agg(F.sum(F.size("_bs")).alias("_nb")), cell)
    sizes = tables.save(sizes, "sizes")
    n = _tasks(sizes.agg(F.sum(F.col("_na").cast("decimal(38,0)") * F.col("_nb"))).first()[0])
    shares = sizes.select(*cell, *(F.ceil(F.col(f"_n{s}") / SHARE).cast("int").alias(f"_of_{s}") for s in "ab"))
    dealt = lambda side, lat, lon: F.pmod(F.hash(lat, lon, "_block"), F.col(f"_of_{side}")).alias(f"_{side}")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"_of_{side}") - 1)).alias(f"_{side}")
    key = [*cell, "_a", "_b"]
    asked = asked.join(shares, cell).select("_as", "lat", "lon", *cell, dealt("a", "lat", "lon"), every("b")).repartition(n, *key)
    placed = placed.join(shares, cell).select("_bs", "lat_b", "lon_b", *cell, dealt("b", "lat_b", "lon_b"), every("a")).repartition(n, *key)
    met = asked.join(placed, key).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).where(F.col("km") <= km)
    away = F.col("km") if digits is None else F.round("km", digits).alias("km")
    return met.select("_as", "_bs", away).select(F.explode("_as").alias("a"), "_bs", "km").select("a", F.explode("_bs").alias("b"), "km")


def _parts(text: Column, n: int) -> Column:
    """All parts of ``n`` characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def by_name(names: DataFrame, b: DataFrame, most: int = 64) -> DataFrame:
    """Pairs of ``names`` (a, name) and ``b`` (b, city) whose city holds the name, both in lower case; names of at most
    ``most`` characters. One row per pair."""
    wanted = names.select("a", F.lower(F.trim("name")).alias("_name")).where((F.col("_name") != "") & (F.length("_name") <= most))
    lengths = sorted(r[0] for r in wanted.select(F.length("_name").alias("n")).distinct().collect())  # at most ``most`` numbers
    if not lengths:
        return wanted.join(b.select("b"), F.lit(False)).select("a", "b")
    tables = Tables(names.sparkSession, "named")
    every = lambda c: F.array_sort(F.collect_set(c))
    rows_a = tables.save(_blocks(wanted.groupBy("a").agg(every("_name").alias("names")), "a", ["names"], NAMED), "a")
    rows_b = tables.save(_blocks(b.where("city is not null").groupBy("b").agg(every(F.lower("city")).alias("cities")), "b", ["cities"], NAMED), "b")
    sizes_a, sizes_b = (t.groupBy(c).agg(F.sum(F.size("rows")).cast("decimal(38,0)").alias(n)) for t, c, n in ((rows_a, "names", "_na"), (rows_b, "cities", "_nb")))
    parts = F.flatten(F.array(*(_parts(F.col("_city"), n) for n in lengths)))
    cut = sizes_b.select("cities", F.explode("cities").alias("_city")).select("cities", F.explode(F.array_distinct(parts)).alias("_name"))
    met = tables.save(cut.join(sizes_a.select("names", F.explode("names").alias("_name")), "_name").select("names", "cities").distinct(), "met")
    n = _tasks(met.join(sizes_a, "names").join(sizes_b, "cities").agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0])
    blocks = met.join(rows_b.select("cities", F.col("rows").alias("_bs")), "cities").join(rows_a.select("names", F.col("rows").alias("_as")), "names")
    return blocks.select("_as", "_bs").repartition(n).select(F.explode("_as").alias("a"), "_bs").select("a", F.explode("_bs").alias("b"))


def near_or_named(a: DataFrame, names: DataFrame, b: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """(a, b, km): ``within_radius``, and ``by_name`` for rows of ``b`` (b, lat, lon, city) without coordinates (km null)."""
    lost = F.coalesce((F.col("lat") == 0) & (F.col("lon") == 0), F.lit(True)) | F.col("lat").isNull() | F.col("lon").isNull()
    found = within_radius(a, b.where(~lost), km, digits)
    return found.unionByName(by_name(names, b.where(lost)).withColumn("km", F.lit(None).cast("double")))
