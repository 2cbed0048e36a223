"""Events in JSON of any shape, and parts of pages by selectors."""

import datetime as dt
import json

import pytest

from marlstone.functions import names
from marlstone.sources import page_json, selectors
from pyspark.sql import functions as F


def page(props):
    return f'<html><script>var a = 1</script><script id="__NEXT_DATA__" type="application/json">{props if isinstance(props, str) else json.dumps({"props": {"pageProps": props}})}</script></html>'


ENTRIES = [
    {"name": "Band A", "startDate": "2026-05-01T20:00", "place": {"name": "Docks", "city": "Hamburg"}, "url": "/a"}, {"headline": "Band B", "date": "am 2026-06-02", "venue": "Knust"},
    {"name": "", "title": "Band C", "minStartDate": "2026-07-03", "location": {"address": {"city": "Kiel"}}, "ticketUrl": "/c"}, {"artistName": "Band D", "startDate": "bald", "eventDate": "2026-08-04", "place": {}, "venue": None},
    "a text", 7, None, ["x"], {"startDate": "2026-01-01"}, {"displayName": "Band E", "place": {"venueName": "Logo"}},
]
WANT = [
    (0, "Band A", "2026-05-01", "Docks", "Hamburg", "/a"), (1, "Band B", "2026-06-02", "Knust", None, None), (2, "Band C", "2026-07-03", "Kiel", "Kiel", "/c"), (3, "Band D", "2026-08-04", "Hall", None, None),
    (9, "Band E", None, "Logo", None, None),
]


def test_lists_at_any_path_and_entries_of_any_shape(spark):
    shapes = [{"searchResult": {"productGroups": ENTRIES}}, {"initialData": {"productGroups": ENTRIES}}, {"data": {"productGroups": ENTRIES}, "productGroups": [{"name": "no"}]}, {"searchResult": {"productGroups": []}, "productGroups": ENTRIES}, {"products": ENTRIES}, {"events": ENTRIES, "productGroups": {"name": "no list"}}]
    bad = [(90, page("{'a': 1}")), (91, "<p>none</p>"), (92, None), (93, page({"events": []})), (94, page("[1]")), (95, page({"events": ["x"]}))]
    df = spark.createDataFrame([(i, page(s)) for i, s in enumerate(shapes)] + bad, "page_id long, html string")
    rows = page_json.embedded_events(df, default_venue="Hall").collect()
    for i in range(len(shapes)):
        assert sorted(tuple(r)[2:] for r in rows if r["page_id"] == i) == WANT, i
    assert {r["page_id"]: r["problem"] for r in rows if r["page_id"] >= 90} == {90: "malformed", 91: "no script", 92: "no script", 93: "no list", 94: "no list"}


def test_answers(spark):
    answers = [(1, 200, json.dumps({"items": ENTRIES})), (2, 404, "[]"), (3, 200, '{"warn": "none"}'), (4, 200, "<html>"), (5, 500, "[]"), (6, 200, json.dumps([{"title": "Later", "datetime": "2026-05-01T20:00:00Z"}, {"title": "Past", "datetime": "2025-01-01T20:00:00"}, {"title": "Unknown"}, {"title": "Odd", "datetime": "soon"}])), (7, 200, None)]
    df = spark.createDataFrame(answers, "id long, status int, body string")
    rows = page_json.answered_events(df, now=F.lit(dt.datetime(2026, 1, 1)), default_venue="Hall").collect()
    assert sorted(tuple(r)[2:] for r in rows if r["id"] == 1) == WANT
    assert {r["id"]: r["problem"] for r in rows if r["problem"]} == {2: "not found", 3: "no list", 4: "malformed", 5: "malformed", 7: "malformed"}
    assert sorted(r["artist"] for r in rows if r["id"] == 6) == ["Later", "Odd", "Unknown"]
    twice = page_json.first_seen(page_json.answered_events(df.unionByName(df.withColumn("id", F.col("id") + 10))), ["id", "n"])
    assert {(r["id"], r["artist"]) for r in twice.collect() if r["id"] in (1, 11)} == {(1, f"Band {x}") for x in "ABCDE"}


def matched(selector, html):
    m = selectors.Matches({"s": selectors.compiled(selector)})
    m.feed(html)
    m.close()
    return ["".join(x[3]) for x in m.found]


HTML = """<div class="artist-list"><p class="big name x">A<br>1</p><div><h2 class=name>B</h2></div></div><h2 class="name">C</h2><ul><li class="event"><a href="/concerts/1">D</a></li><li>E</ul><h3 data-name="x">F<b>G</b></h3><img class="name">"""


@pytest.mark.parametrize("selector, want", [
    ("h2", ["B", "C"]), ("h2.name", ["B", "C"]), ("[class*='artist'] h2", ["B"]), ("[class*='artist'] [class*='name']", ["A1", "B"]), (".name", ["A1", "B", "C", ""]), (".big.name", ["A1"]), ("div div h2", ["B"]),
    ("div p div", []), ("ul li a[href*='/concerts/'], h3[data-name='x']", ["D", "FG"]), ("li", ["D", "E"]), ("[data-name]", ["FG"]), ("[data-name=\"y\"]", []), ("*.x", ["A1"]), ("img.name", [""]), ("h2, h2.name", ["B", "C"]),
])
def test_selectors(selector, want):
    assert matched(selector, HTML) == want


@pytest.mark.parametrize("bad", ["", "h2 >", "h2,", "a:hover", "[x", ".a > .b"])
def test_selectors_that_are_none(bad):
    with pytest.raises(ValueError):
        selectors.compiled(bad)


def test_lineup_with_attributes_as_last_resort(spark):
    pages = [
        (1, '<div class="my-artist-card"><span class="the-name"> Iron  Band </span><h3>Rock im Park</h3></div><p class="band-name">Zwei</p><p class="act-name">Eins</p><p class="band-name">Eins</p><i data-artist="Nobody"></i>'),
        (2, '<p data-artist="Sum 41">x</p><p aria-label="Menu"></p><p data-name="Sum 41"></p><p data-title="Kraft, Germany"></p><p aria-label="Blink-182"></p>'), (3, None), (4, "<div class=lineup><h2>Tickets 2026</h2></div>"),
    ]
    got = {}
    for r in selectors.lineup(spark.createDataFrame(pages, "page_id long, html string")).collect():
        got.setdefault(r["page_id"], {})[r["place"]] = r["name"]
    assert got == {1: {1: "Iron Band", 2: "Eins", 3: "Zwei"}, 2: {1: "Sum 41", 2: "Blink-182"}}


def test_linked_id_is_the_first_alike(spark):
    html = '<a href="/artists/7-other">Other</a><a href="/artists/x">The Band</a><a href="/artists/12-the-band?x">The <b>Band!</b></a><a href="/artists/13-band">Band</a>'
    df = spark.createDataFrame([(1, html, "the band"), (2, html, "nobody"), (3, html, ""), (4, None, "x"), (5, html, "Band")], "page_id long, html string, name string")
    assert sorted(tuple(r) for r in selectors.linked_ids(df, "name").collect()) == [(1, "13", "band"), (5, "12", "the-band")]  # texts of a link are joined without spaces


def test_calendar(spark):
    html = """<ul><li class="event-listings-element"><time datetime="2026-05-01T20:00">1 May</time><p class="venue-name">Docks, Hamburg, Germany</p><a href="/concerts/5">more</a></li>
    <li class="an-event">on 2026-06-02 at <span class="location">Kiel, Germany</span></li><li class="event">2020-01-01</li><li>2026-09-09</li></ul><article class="event-x"><em class="secondary-detail">Knust</em><time datetime="2026-07-03"></time></article>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = sorted(tuple(r)[2:] for r in selectors.calendar(df, "2026-01-01", site="https://x").collect())
    assert got == [("2026-05-01", "Docks", "Hamburg", "https://x/concerts/5"), ("2026-06-02", "Kiel", "Germany", ""), ("2026-07-03", "Knust", "", "")]
    assert [r["day"] for r in selectors.calendar(df, "2026-01-01", "hamburg").collect()] == ["2026-05-01"]


def test_plausible_names(spark):
    good = ["Sum 41", "TX2", "Blink-182", "30 Seconds to Mars", "Ä", "Die Ärzte"]
    cases = {n: (len(n) >= 2, len(n) >= 2) for n in good} | {"Tickets kaufen": (False, False), "Lineup": (False, False), "Tour 1999": (False, False), "a b c d e f": (False, False), "12 34": (False, False), "": (False, False), "Zeppelinfeld": (True, False), "Halle, Nürnberg": (True, False), "x" * 51: (False, False)}
    df = spark.createDataFrame([(n,) for n in cases] + [(None,)], "n string")
    got = {r["n"]: (r["a"], r["b"]) for r in df.select("n", names.GENERAL.holds(F.col("n")).alias("a"), names.PARK.holds(F.col("n")).alias("b")).collect()}
    assert got == cases | {None: (False, False)}


def test_places_of_events_are_read_once(spark):
    df = spark.createDataFrame([(1, "<html></html>")], "page_id long, html string")
    plan = page_json.embedded_events(df, default_venue="Hall")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.location") == 1
