"""Names, places, dates and answers out of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Patterns and word lists that the results depend on.
ACT_NAME = r"[A-Z][A-Za-z0-9&'’]*(?:\s+[A-Z][A-Za-z0-9&'’]+){0,2}"
ACT_LEADS = ("support acts?", "special guests?", "supported by")
NO_ACTS = (
    "information", "info", "details", "reviews", "tickets", "ticket", "lineup", "news", "tour", "show", "shows", "tba", "announcement", "announced", "line", "package", "vip", "and", "the",
)
STAGES = (
    "Utopia Stage", "Mandora Stage", "Orbit Stage", "Mainstage", "Alternastage", "Parkstage", "Park Stage", "Rock Stage", "Metal Stage",
    "Infield Stage", "Festival Stage", "Zeltbuehne", "Zeltbühne", "Hang Stage", "Main Stage", "Haupt.?b.hne", "Neben.?b.hne",
)
DAYS = {"freitag": "Freitag", "friday": "Freitag", "samstag": "Samstag", "saturday": "Samstag", "sonntag": "Sonntag", "sunday": "Sonntag"}
VENUES = {
    "barclays": "Barclays Arena", "volksparkstadion": "Volksparkstadion", "sporthalle": "Sporthalle Hamburg", "inselpark": "Inselpark Arena", "mehr! theater": "Mehr! Theater",
    "fabrik": "Fabrik Hamburg", "docks": "Docks Hamburg", "markthalle": "Markthalle Hamburg", "grünspan": "Grünspan", "gruenspan": "Grünspan",
    "große freiheit": "Große Freiheit 36", "grosse freiheit": "Große Freiheit 36", "logo": "Logo Hamburg", "uebel & gefährlich": "Uebel & Gefährlich",
    "trabrennbahn": "Trabrennbahn Hamburg", "stadtpark": "Stadtpark Hamburg", "alsterdorfer": "Alsterdorfer Sporthalle", "hamburg": "Hamburg",
}

TIME_RANGE = r"(\d{1,2}:\d{2})\s*[-–]\s*(\d{1,2}:\d{2})"
DATE = r"\d{1,2}[./]\d{1,2}[./]20\d{2}\b|20\d{2}-\d{2}-\d{2}\b"
STAGE = r"(?i)\b(" + "|".join(STAGES) + r")\b"


def longest_first(words) -> list[str]:
    return sorted(words, key=lambda w: (-len(w), w))


def support_acts(text: Column, exclude: Column) -> Column:
    """Names after words that announce a support act, each spelling once; the artist itself and filler words are left out."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i:{lead})[\s:\-–]+({ACT_NAME})"), F.lit(1)) for lead in ACT_LEADS))
    low = F.transform(found, lambda x: F.lower(x))
    first = F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.filter(first, lambda x: (F.lower(x) != F.lower(F.coalesce(exclude, F.lit("")))) & ~F.substring_index(F.lower(F.regexp_replace(x, r"\s", " ")), " ", 1).isin(*NO_ACTS))


def names_in(text: Column, plausible) -> Column:
    """Plausible names of a text whose names are parted by headings, commas, bars, bullets, slashes or lines."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"#{1,4}\s+", "\n"), r"[,|\n•·/]")
    bare = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(collapse(x), r"[.!?]+\z", "")), r"\A(?i:and|und|feat\.?|ft\.?)\s+", ""))
    return F.filter(F.transform(parts, bare), plausible)


def day_in(text: Column) -> Column:
    """The weekday that a text names, asked in the order of ``DAYS``; null without one."""
    t, out = F.lower(text), None
    for marker, day in DAYS.items():
        out = F.when(t.contains(marker), day) if out is None else out.when(t.contains(marker), day)
    return out


def venue_in(text: Column, default: Column) -> Column:
    """The venue of the longest keyword that a text holds."""
    t, out = F.lower(text), None
    for word in longest_first(VENUES):
        out = F.when(t.contains(word), VENUES[word]) if out is None else out.when(t.contains(word), VENUES[word])
    return out.otherwise(default)


def date_snippets(text: Column, reach: int = 140) -> Column:
    """For each date of a text the text itself and up to ``reach`` characters on both sides, in one linear search."""
    far, near = rf"(?<=(.{{{reach}}}))", rf"(?<=(\A.{{0,{reach - 1}}}))"  # of one length where there is room, so that it is tried once
    p = rf"(?s)\b(?={DATE})(?:{far}|{near})({DATE})(?=(.{{0,{reach}}}))"
    group = lambda i: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(i))
    before = F.zip_with(group(1), group(2), lambda x, y: F.concat(x, y))
    return F.arrays_zip(group(3).alias("date"), before.alias("before"), group(4).alias("after"))


def iso_date(raw: Column) -> Column:
    """Day, month and year in either order as an ISO date."""
    turned = F.split(raw, r"[./]")
    padded = F.concat_ws("-", turned[2], F.lpad(turned[1], 2, "0"), F.lpad(turned[0], 2, "0"))
    return F.when(raw.rlike(r"^20\d{2}-"), raw).otherwise(padded)


def fenced_list(answer: Column) -> Column:
    """The non-empty entries of a JSON list that may stand in a code fence; empty where it cannot be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"\A```(?:json)?", ""), r"```\z", "")
    return F.filter(F.coalesce(F.from_json(F.trim(F.translate(bare, "\n", " ")), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
