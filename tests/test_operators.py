"""Operators without SQL against plain versions, and small cases of the others."""

import datetime as dt

import pytest

from marlstone.functions import dates, rules, text
from marlstone.operators import chunking, lift, merging
from marlstone.sources import html
from pyspark.sql import functions as F


def chunks_of(spark, text):
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    return [(r["content"], r["page_number"]) for r in rows]


def test_chunks_gather_paragraphs_and_cut_long_ones(spark):
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, "a\n\nb") == [("a\n\nb", None)]
    assert chunks_of(spark, "x" * 600 + "\n\n" + "y" * 500) == [("x" * 600, None), ("y" * 500, None)]
    # the first paragraph after a full chunk counts without the gap, later ones with it
    parts = ["a" * 600, "b" * 500, "c" * 500, "d"]
    assert [c for c, _ in chunks_of(spark, "\n\n".join(parts))] == ["a" * 600, "b" * 500 + "\n\n" + "c" * 500, "d"]
    long = " ".join(["w" * 98 + "."] * 15)
    assert [len(c) for c, _ in chunks_of(spark, long)] == [999, 499]


def test_chunk_page_is_the_one_at_its_end(spark):
    got = chunks_of(spark, "[PAGE_NUM: 3]\n\nstart\n\n[PAGE_NUM: 4] more")
    assert got == [("start\n\nmore", 4)]


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.chunk_documents(df).collect()] == [(1, 0, None, "a\n\nb")]


def test_lift_replay_is_the_plain_fold(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(7, start + dt.timedelta(milliseconds=50 * i), i, i % 90 < 60, i % 90 >= 60, i % 7 == 0, i % 5 == 0) for i in range(300)]
    rows += [(8, start, 0, True, False, True, True)]
    df = spark.createDataFrame(rows, "lift long, ts timestamp_ntz, seq long, up boolean, down boolean, open boolean, close boolean")
    got = {(r["lift"], r["seq"]): (r["height"], r["door"], r["at_2"]) for r in lift.replay(df).collect()}
    h = d = 0.0
    last = start
    for key, ts, seq, up, down, o, c in rows[:300]:
        step = (ts - last).total_seconds()
        last = ts
        h = min(100.0, h + 25 * step) if up else h
        h = max(0.0, h - 25 * step) if down else h
        d = min(100.0, d + 100 * step) if o else max(0.0, d - 100 * step) if c else d
        assert got[key, seq] == pytest.approx((h, d, 44 <= h <= 56))
    assert got[8, 0][:2] == (0.0, 0.0) and lift.STATE_NAMES[90] == "FireAlarm"


def test_dates():
    assert dates.numeric_date(12, ".", 5, 2026) == "2026-05-12"
    assert dates.numeric_date(1, "/", 13, 2026) == "2026-01-13"
    assert dates.numeric_date(5, "/", 6, 2026) is None
    assert [d for _, d in dates.dates_in("am 12. März 2026 oder December 3, 2027")] == ["2026-03-12", "2027-12-03"]
    assert dates.nearest_date("01.02.2026 " + "x" * 500 + " Hamburg 03.04.2026", ["hamburg"]) == "2026-04-03"
    assert dates.nearest_date("01.02.2026", ["hamburg"]) is None


def test_rules(spark):
    df = spark.createDataFrame([("Bitte Fehler beheben", "ok"), ("Umbau der API", "passt so, danke"), ("kurz", "ja"), (None, None)], "t string, c string")
    got = [tuple(r) for r in df.select(rules.category(F.col("t")), rules.complexity(F.col("t")), rules.worth_keeping(F.col("c"))).collect()]
    assert got == [("bug", "mittel", False), ("refactor", "komplex", True), ("feature", "einfach", False), ("feature", "mittel", False)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Use sk-proj-abcdefgh12 or gsk_12345678 now", "x" * 100, "y" * 60), ("none", "short", ""), ("sk-short", "a" * 80, "b" * 47)], "t string, raw string, new string")
    got = [tuple(r) for r in df.select(text.redact_keys(F.col("t")), text.plausible_rewrite(F.col("raw"), F.col("new"))).collect()]
    assert got == [("Use [KEY REMOVED] or [KEY REMOVED] now", True), ("none", False), ("sk-short", False)]
    names = spark.createDataFrame([("AC/DC & Friends!",), ("Song (Live) - Title's",)], "n string").select(text.name_key(F.col("n")), text.title_key(F.col("n")), text.shorten(F.col("n"), 8)).collect()
    assert names[0][0] == "ac dc friends" and names[1][1] == "song titles" and names[1][2] == "Song (L…"
    assert spark.range(1).select(text.german_number(F.lit(1234.5))).first()[0] == "1.234,50"


def test_list_diff_keeps_repeats(spark):
    old = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b"), ("l", 3, "b")], "list string, seq long, title string")
    new = spark.createDataFrame([("l", 1, "a"), ("l", 2, "a"), ("l", 3, "c")], "list string, seq long, title string")
    got = sorted((r["change"], r["title"], r["seq"]) for r in merging.list_diff(old, new, ["list"], "title").collect())
    assert got == [("added", "c", 3), ("removed", "b", 2), ("removed", "b", 3), ("unchanged", "a", 1), ("unchanged", "a", 2)]


def test_html_links():
    assert html.parse('<title>T &amp; x</title><a href="/a">A <b>b</b></a><a>n</a>') == ("T & x", [("/a", "A b"), ("", "n")])
    assert html.parse("") == ("", [])
