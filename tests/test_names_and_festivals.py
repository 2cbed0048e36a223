"""Composed letters, and festivals by words and bounds."""

import unicodedata

from marlstone.functions import text
from marlstone.operators import setlists
from pyspark.sql import functions as F


def test_decomposed_letters_match(spark):
    words = ["Motörhead", "Die Ärzte", "Sigur Rós", "Ǖber ế", "Łódź", "plain", "", "Ñandú Ångström"]
    rows = [(w, unicodedata.normalize("NFD", w)) for w in words]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.composed(F.col("b")).alias("c"), text.name_key(F.col("a")).alias("x"), text.name_key(F.col("b")).alias("y"))
    for r in df.collect():
        assert r["c"] == unicodedata.normalize("NFC", r["a"]) and r["x"] == r["y"]
    assert spark.createDataFrame([(None,), ("\u0308x",)], "a string").select(text.composed(F.col("a"))).collect()[0][0] is None


def test_festivals_by_words_and_bounds(spark):
    rows = [("Docks", "Tour", 12, 30), ("Docks", "Tour", 13, 20), ("Wacken Open Air", "Tour", 30, 30), ("Leeds Arena", "Tour", 30, 30), ("Docks", "", 30, 20), ("Docks", "", 30, 21), ("Docks", "Knotfest", 30, 30), (None, None, None, None)]
    df = spark.createDataFrame(rows, "venue string, tour string, songs int, own int")
    got = [(r["a"], r["b"]) for r in df.select(setlists.festival_short(F.col("venue"), F.col("songs")).alias("a"), setlists.festival_tourless(F.col("tour"), F.col("venue"), F.col("own")).alias("b")).collect()]
    assert got == [(True, False), (False, False), (True, True), (False, True), (False, True), (False, False), (False, True), (True, True)]
