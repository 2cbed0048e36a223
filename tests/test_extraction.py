"""Extraction and recall rules on odd texts, and cover density against a plain version."""

from pyspark.sql import functions as F

from marlstone.functions import extraction as X
from marlstone.functions import rules
from marlstone.operators import retrieval as R


def _one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_empty_texts(spark):
    t = F.col("t")
    for text in (None, ""):
        r = _one(spark, text, X.support_acts(t, F.lit(None)), X.date_snippets(t), R.any_terms_query(t), rules.is_task(t), X.fenced_list(t))
        assert list(r) == [[], [], None, False, []]


def test_task_rules(spark):
    t = F.col("t")
    assert tuple(_one(spark, "der Server steht", rules.is_task(t), rules.is_task(t, True))) == (False, True)
    assert tuple(_one(spark, "Baue! den Server", rules.is_task(t), rules.is_task(t, True))) == (True, True)
    assert tuple(_one(spark, "  TODO: Brot", rules.is_task(t), rules.is_task(t, True))) == (True, True)


def test_support_acts(spark):
    text = "Support act: The Kin. support acts – tickets; Special Guest: Tickets Now, supported by THE KIN and Support act Main"
    assert _one(spark, text, X.support_acts(F.col("t"), F.lit("main")))[0] == []
    text = "Special guest: R&B Sons, support act: Low Fi. supported by LOW FI"
    assert _one(spark, text, X.support_acts(F.col("t"), F.lit("x")))[0] == ["Low Fi", "R&B Sons"]


def test_date_snippets(spark):
    for before in (0, 3, 139, 140, 141, 500):
        text = "ä" * (before - 1) + " " * (before > 0) + "5.6.2026 " + "b" * 200
        d = _one(spark, text, X.date_snippets(F.col("t")))[0]
        at = text.index("5.6")
        assert [(x["before"], x["date"], x["after"]) for x in d] == [(text[max(0, at - 140) : at], "5.6.2026", text[at + 8 : at + 148])]
    assert _one(spark, "5.6.2026", X.iso_date(F.col("t")))[0] == "2026-06-05"


def _plain(words, terms):
    at = [(i, w) for i, w in enumerate(words, 1) if w in terms]
    total, n = 0.0, 0
    for a, (p, _) in enumerate(at):
        for b in range(a, len(at)):
            part = [w for _, w in at[a : b + 1]]
            if set(part) == set(terms):
                if set(part[1:]) != set(terms):  # no shorter passage ends here
                    total, n = total + 0.1 / (1 + (at[b][0] - p) - (b - a)), n + 1
                break
    return round(total, 6), n


def test_cover_density(spark):
    texts = ["a x b y y a b", "a a a b", "b", "", None, "c a b c a z z b b", "a b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: (r["density"], r["covers"]) for r in R.cover_density(df, "id", "t", ["a", "b"]).collect()}
    want = {i: _plain((t or "").split(), ["a", "b"]) for i, t in enumerate(texts) if {"a", "b"} <= set((t or "").split())}
    assert got == want


def test_recall(spark):
    rows = [("few", i, [1.0, 0.0]) for i in range(3)] + [("many", i, [1.0, float(i)] if i else None) for i in range(9)] + [("blind", i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "o string, id long, v array<double>")
    got = sorted((r["o"], r["how"], r["place"] or 0, r["id"]) for r in R.recall(df, "o", "id", "v", [1.0, 0.0], 2, 3).collect())
    assert got == [("blind", "newest", 1, 8), ("blind", "newest", 2, 7), ("few", "all", 0, 0), ("few", "all", 0, 1), ("few", "all", 0, 2), ("many", "near", 1, 1), ("many", "near", 2, 2)]
    assert R.recall(df.limit(0), "o", "id", "v", [1.0, 0.0], 2).count() == 0


def test_date_snippets_look_back_once(spark):
    import time

    text = ("word " * 40 + "5.6.2026 " + "y " * 90 + "2026-07-08 end ") * 3
    df = spark.range(1, numPartitions=1).select(F.lit(text).alias("t")).crossJoin(spark.range(0, 4000, 1, 1)).select(F.concat("t", F.col("id").cast("string")).alias("t"))
    one = df.limit(1).select(F.inline(X.date_snippets(F.col("t")))).collect()
    at = [i for i in range(len(text)) if text.startswith(("5.6.2026", "2026-07-08"), i)]
    assert [x["before"] for x in one] == [text[max(0, i - 140) : i] for i in at]
    start = time.perf_counter()
    df.select(F.sum(F.size(X.date_snippets(F.col("t"))))).collect()
    assert time.perf_counter() - start < 4


def test_dates_hold_three_tokens_at_a_time():
    import tracemalloc

    from marlstone.functions import dates

    text = "word 12 " * 50_000 + "am 12. März 2026 oder 5/13/2027"
    tracemalloc.start()
    found = dates.dates_in(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [d for _, d in found] == ["2026-03-12", "2027-05-13"] and peak < 1 << 20
