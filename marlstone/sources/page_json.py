"""Events in JSON of no fixed shape: embedded in pages, or answered by a service.

A text becomes a VARIANT, lists are looked for at several paths, and each entry, whatever its own shape, is read by
several names for each field. Nothing is inferred from other rows, so a table may mix all shapes. What cannot be read
is a row with a ``problem``, never an error.

``problem``: null for an event, 'no script', 'malformed', 'no list', or 'not found' (a service's 404). Entries that are no
objects, or have no name, are left out; a page whose entries are all left out gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key

# Where lists and fields may be.
SCRIPT = r"""(?is)<script\b[^>]*\bid\s*=\s*["']?__NEXT_DATA__["'\s>][^>]*>?(.*?)</script>"""
PROPS = "$.props.pageProps"
PAGE_LISTS = ("searchResult.productGroups", "initialData.productGroups", "data.productGroups", "productGroups", "searchResult.products", "products", "events")
ANSWER_LISTS = ("productGroups", "products", "events", "items")
NAMES = ("name", "headline", "title", "artistName", "displayName")
DAYS = ("startDate", "date", "eventDate", "startTime", "minStartDate")
PLACES = ("place", "venue", "location")
LINKS = ("url", "ticketUrl", "link")

DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"


def _text(v: Column, path: str) -> Column:
    """A text at a path, null where there is none or an empty one."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _list(v: Column, paths) -> Column:
    """The first list with entries; ``$`` is the value itself."""
    found = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in found))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _place(e: Column) -> Column:
    """The first place that says something; each is read once."""
    some = lambda p: ~F.coalesce(F.schema_of_variant(p).isin("VOID", "OBJECT<>"), F.lit(True)) & F.coalesce(F.try_variant_get(p, "$", "string") != "", F.lit(True))
    return F.get(F.filter(F.array(*(F.try_variant_get(e, f"$.{k}", "variant") for k in PLACES)), some), 0)


def _fields(e: Column, place: Column, default_venue: str) -> list[Column]:
    """``place`` is a column that holds ``_place``."""
    day = F.coalesce(*(F.nullif(F.regexp_extract(_text(e, f"$.{k}"), DAY, 1), F.lit("")) for k in DAYS))
    inside = _is_object(place)
    city = F.when(inside, F.coalesce(_text(place, "$.city"), _text(place, "$.address.city")))
    venue = F.when(inside, F.coalesce(_text(place, "$.name"), _text(place, "$.venueName"), city)).otherwise(F.try_variant_get(place, "$", "string"))
    return [
        F.coalesce(*(_text(e, f"$.{k}") for k in NAMES)).alias("artist"), day.alias("day"), F.coalesce(venue, F.lit(default_venue)).alias("venue"), city.alias("city"),
        F.coalesce(*(_text(e, f"$.{k}") for k in LINKS)).alias("url"),
    ]


def _events(df: DataFrame, key: str, problem: Column, entries: Column, default_venue: str) -> DataFrame:
    rows = df.select(key, problem.alias("problem"), entries.alias("_entries")).select(key, F.when(F.col("problem").isNull() & F.col("_entries").isNull(), "no list").otherwise(F.col("problem")).alias("problem"), F.posexplode_outer("_entries").alias("n", "_e")).withColumn("_p", _place(F.col("_e")))
    read = rows.select(key, "problem", F.when(F.col("problem").isNull(), F.col("n")).alias("n"), _is_object(F.col("_e")).alias("_o"), *_fields(F.col("_e"), F.col("_p"), default_venue))
    named = F.col("_o") & F.col("artist").isNotNull()
    shown = [F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("artist", "day", "venue", "city", "url")]
    return read.where(F.col("problem").isNotNull() | named).select(key, "problem", "n", *shown)


def embedded_events(pages: DataFrame, key: str = "page_id", html: str = "html", default_venue: str = "") -> DataFrame:
    """Key, problem, n (place in its list), artist, day, venue, city, url of the events in a page's data script."""
    script = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), SCRIPT, 1)
    df = pages.select(key, script.alias("_s")).withColumn("_v", F.try_parse_json("_s"))
    problem = F.when(F.trim("_s") == "", "no script").when(F.col("_v").isNull(), "malformed")
    return _events(df, key, problem, _list(F.col("_v"), [f"{PROPS}.{p}" for p in PAGE_LISTS]), default_venue)


def answered_events(answers: DataFrame, key: str = "id", status: str = "status", body: str = "body", now: Column | None = None, default_venue: str = "") -> DataFrame:
    """The same for a service's answers (status, body): a list, or an object that holds one.

    With ``now`` events are kept if their ``datetime`` is after it, missing or none.
    """
    df = answers.select(key, F.col(status).alias("_status"), F.try_parse_json(F.coalesce(F.col(body), F.lit(""))).alias("_v"))
    problem = F.when(F.col("_status") == 404, "not found").when((F.col("_status") != 200) | F.col("_v").isNull(), "malformed")
    entries = _list(F.col("_v"), ["$", *(f"$.{p}" for p in ANSWER_LISTS)])
    if now is not None:
        late = lambda e: F.coalesce(F.try_to_timestamp(F.replace(_text(e, "$.datetime"), F.lit("Z"), F.lit("+00:00"))) > now, F.lit(True))
        entries = F.filter(entries, late)
    return _events(df, key, problem, entries, default_venue)


def first_seen(events: DataFrame, order: list[str]) -> DataFrame:
    """One event per act and day, the first in order."""
    w = Window.partitionBy(name_key(F.col("artist")), "day").orderBy(*order)
    return events.where("problem is null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
