"""Parts of pages by selectors, all in one pass over a page.

A selector is alternatives by commas; each is a chain of parts that must be nested; a part names a tag, classes and
attributes (present, equal, or holding a text). It is compiled once into sets of part numbers. While a page is read, the
stack of open tags carries for each alternative how far ancestors have got, as bits, so a tag costs a step per bit however
deep it is, and no tree is built. Matches keep their text, their attributes and the matches of scopes that they are in.

Pages are parsed leniently: tags that never close end with what holds them. Null pages have no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import PARK, Rule
from ..functions.text import name_key
from ..scratch import ship

# Tags without end, selectors and attributes of a line-up, and those of a calendar.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINEUP = (
    "[class*='artist'] [class*='name']", "[class*='artist'] h1", "[class*='artist'] h2", "[class*='artist'] h3", "[class*='artist'] h4",
    "[class*='lineup'] [class*='name']", "[class*='lineup'] h2", "[class*='lineup'] h3", ".act-name", ".band-name", "h2.name", "h3.name",
)
NAME_ATTRIBUTES = ("data-artist", "data-name", "data-title", "aria-label")
CALENDAR = "li.event-listings-element, li[class*='event'], article[class*='event']"
VENUE = (".venue-name", "[class*='venue']", ".location", "em.secondary-detail")

_PART = re.compile(r"""\s*([\w-]+|\*)?((?:\.[\w-]+|\[[^\]]*\])*)(\s*,|\s+|$)""")
_PIECE = re.compile(r"""\.([\w-]+)|\[\s*([\w-]+)\s*(?:(\*?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]*)))?\s*\]""")


@dataclass(frozen=True)
class Part:
    tag: str | None
    classes: frozenset[str]
    attributes: tuple[tuple[str, str, str], ...]

    def fits(self, tag: str, classes: set[str], attributes: dict[str, str]) -> bool:
        if self.tag not in (None, tag) or not self.classes <= classes:
            return False
        for name, op, value in self.attributes:
            have = attributes.get(name)
            if have is None or op == "=" and have != value or op == "*=" and (not value or value not in have):
                return False
        return True


def compiled(selector: str) -> list[list[Part]]:
    """Alternatives of nested parts; ValueError for what this reads not."""
    out: list[list[Part]] = [[]]
    at, text = 0, selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at or not (m[1] or m[2]):
            raise ValueError(f"selector {selector!r}")
        pieces = list(_PIECE.finditer(m[2]))
        if "".join(p[0] for p in pieces) != m[2]:
            raise ValueError(f"selector {selector!r}")
        attributes = tuple((p[2], p[3] or "", next((v for v in (p[4], p[5], p[6]) if v is not None), "")) for p in pieces if p[2])
        out[-1].append(Part(None if m[1] in (None, "*") else m[1].lower(), frozenset(p[1] for p in pieces if p[1]), attributes))
        if m[3].strip() == ",":
            out.append([])
        at = m.end()
    if not all(out):
        raise ValueError(f"selector {selector!r}")
    return out


class Matches(HTMLParser):
    """Feed a page; ``found`` has (selector, ord, tag, pieces of text, attributes, scopes) in order of their begin."""

    def __init__(self, selectors: dict[str, list[list[Part]]], scope: str | None = None):
        super().__init__(convert_charrefs=True)
        self.chains = [(name, chain) for name, chains in selectors.items() for chain in chains]
        self.scope, self.found, self.open = scope, [], []
        self.stack: list[tuple[str, tuple[int, ...], int]] = [("", (1,) * len(self.chains), 0)]

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in reversed(attrs)}
        classes, above = set(attributes.get("class", "").split()), self.stack[-1][1]
        bits, names = list(above), []
        for c, (name, chain) in enumerate(self.chains):
            reached = above[c]
            for i, part in enumerate(chain):
                if reached >> i & 1 and part.fits(tag, classes, attributes):
                    if i + 1 < len(chain):
                        bits[c] |= 2 << i
                    elif name not in names:
                        names.append(name)
        scopes = [m[1] for m in self.open if m[0] == self.scope]
        for name in names:
            match = (name, len(self.found), tag, [], attributes, scopes)
            self.found.append(match)
            if tag not in VOID:
                self.open.append(match)
        if tag not in VOID:
            self.stack.append((tag, tuple(bits), len(names)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack[1:]):
            while True:
                name, _, n = self.stack.pop()
                if n:
                    del self.open[-n:]
                if name == tag:
                    break

    def handle_data(self, data):
        piece = data.strip()
        if piece:
            for match in self.open:
                match[3].append(piece)


MATCHES = "selector string, ord int, tag string, spaced string, text string, attributes map<string,string>, scopes array<int>"


def select(pages: DataFrame, selectors: dict[str, str], key: str = "page_id", html: str = "html", scope: str | None = None) -> DataFrame:
    """key and a row per match: selector (its name), ord (order of begin in the page), tag, spaced and text (pieces of
    text joined by spaces or by nothing), attributes, scopes (ords of the matches of ``scope`` that it is in)."""
    plan = {name: compiled(s) for name, s in selectors.items()}
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32())]
    names = [key, *(c.split()[0] for c in MATCHES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.column(key).type, []
            for k, page in zip(batch.column(key).to_pylist(), batch.column("_html")):
                m = Matches(plan, scope)
                m.feed(page.as_py() or "")
                m.close()
                rows += [(k, name, n, tag, " ".join(t), "".join(t), list(a.items()), scopes) for name, n, tag, t, a, scopes in m.found]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [kind, *types])], names)

    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(html).alias("_html")).mapInArrow(run, f"{key} {kind}, {MATCHES}")


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lineup(pages: DataFrame, key: str = "page_id", html: str = "html", rule: Rule = PARK) -> DataFrame:
    """(key, name, place): plausible names at the line-up's selectors, in their order; of pages without any, those in
    attributes of any tag. Each name once, where it comes first."""
    wanted = {f"{i:02d}": s for i, s in enumerate(LINEUP)} | {f"attribute{i}": f"[{a}]" for i, a in enumerate(NAME_ATTRIBUTES)}
    m = select(pages, wanted, key, html)
    attribute = F.coalesce(*(F.when(F.col("selector") == f"attribute{i}", F.col("attributes")[a]) for i, a in enumerate(NAME_ATTRIBUTES)))
    late = F.col("selector").startswith("attribute")
    named = m.select(key, late.alias("_late"), F.when(late, F.lit("")).otherwise(F.col("selector")).alias("_s"), "ord", "selector", _clean(F.when(late, attribute).otherwise(F.col("spaced"))).alias("name"))
    named = named.where(rule.holds(F.col("name")))
    first = named.groupBy(key, "_late", "name").agg(F.min(F.struct("_s", "ord", "selector")).alias("_at"))
    used = first.withColumn("_by", F.min("_late").over(Window.partitionBy(key))).where(F.col("_late") == F.col("_by"))
    return used.select(key, "name", F.row_number().over(Window.partitionBy(key).orderBy("_at")).alias("place"))


def linked_ids(pages: DataFrame, name: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, id, slug) of the first link to an artist whose text and ``name`` (a column of pages) are alike: one
    key holds the other. Pages without such a link are left out."""
    links = select(pages, {"link": "a[href*='/artists/']"}, key, html).join(pages.select(key, F.col(name).alias("_name")), key)
    pattern, href = r"/artists/(\d+)-([^/?#]+)", F.col("attributes")["href"]
    links = links.select(key, "ord", F.regexp_extract(href, pattern, 1).alias("id"), F.regexp_extract(href, pattern, 2).alias("slug"), name_key(F.col("text")).alias("a"), name_key(F.col("_name")).alias("b"))
    alike = (F.col("a") != "") & (F.col("b") != "") & (F.contains("a", "b") | F.contains("b", "a"))
    found = links.where(alike & (F.col("id") != "")).groupBy(key).agg(F.min_by(F.struct("id", "slug"), "ord").alias("_l"))
    return found.select(key, "_l.id", "_l.slug")


def calendar(pages: DataFrame, today: str, city: str = "", key: str = "page_id", html: str = "html", site: str = "") -> DataFrame:
    """Key, ord, day, venue, city, url of a calendar's events from ``today`` on, in ``city`` if given.

    The day is that of a time tag, else the first in the text; venue and city are parts by comma of the first venue tag.
    """
    wanted = {"event": CALENDAR, "time": "time[datetime]", "place": ".location, [class*='location']", "link": "a[href*='/concerts/']"} | {f"venue{i}": s for i, s in enumerate(VENUE)}
    m = select(pages, wanted, key, html, "event")
    events = m.where("selector = 'event'").select(key, "ord", "spaced")
    inner = m.where("selector <> 'event'").select(key, F.explode("scopes").alias("_e"), "selector", "ord", "text", "attributes")
    of = lambda s, value: F.min_by(F.when(F.col("selector") == s, value), F.when(F.col("selector") == s, F.col("ord")))
    parts = inner.groupBy(key, F.col("_e").alias("ord")).agg(
        of("time", F.col("attributes")["datetime"]).alias("_time"), of("place", F.col("text")).alias("_place"), of("link", F.col("attributes")["href"]).alias("_link"),
        *(of(f"venue{i}", F.col("text")).alias(f"_venue{i}") for i in range(len(VENUE))),
    )
    day = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), day, 1), F.lit(""))
    at = F.split(F.coalesce(*(f"_venue{i}" for i in range(len(VENUE)))), ",")
    cut = lambda c, i: F.coalesce(F.trim(F.get(c, F.lit(i))), F.lit(""))
    rows = events.join(parts, [key, "ord"], "left").select(key, "ord", F.coalesce(found(F.col("_time")), found(F.col("spaced"))).alias("day"), cut(at, 0).alias("venue"),
        F.coalesce(F.nullif(cut(at, 1), F.lit("")), cut(F.split("_place", ","), 0)).alias("city"), F.coalesce(F.concat(F.lit(site), F.col("_link")), F.lit("")).alias("url"))
    rows = rows.where(F.col("day") >= today)
    if city:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "venue", "city")), F.lit(city.lower())))
    return rows.select(key, "ord", "day", F.coalesce(F.nullif("venue", F.lit("")), F.nullif("city", F.lit("")), F.lit(city)).alias("venue"), "city", "url")
