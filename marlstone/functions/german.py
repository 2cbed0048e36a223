"""German stems as columns: the published Snowball algorithm, and the words that a search leaves out.

Words are lower case. Regions R1 and R2 begin behind the first and second change from a vowel to another letter, R1 not
before the fourth letter. Three steps cut endings inside R1 or R2; umlauts lose their dots last.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The algorithm's letters and endings.
VOWELS = "aeiouyäöü"
S_ENDINGS = "bdfghklmnrt"
ST_ENDINGS = "bdfghklmnt"
REGION_1 = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"
REGION_2 = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}]"

#: Stop words: forms of articles and pronouns by rule, and words that do not change.
_STEMS = {
    ("ein", "kein", "mein", "dein", "sein", "ihr", "euer", "unser"): ("", "e", "em", "en", "er", "es"),
    ("dies", "jed", "jen", "manch", "solch", "welch", "all", "ander"): ("e", "em", "en", "er", "es"),
}
_PLAIN = """aber als also am an auch auf aus bei bin bis bist da damit dann das dass dazu dein dem den denn der des dich die dir doch dort du durch
er es etwas für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen im in indem ins ist jetzt kann können könnte machen man
mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sich sie sind so soll sollte sondern sonst über um und uns unter viel vom von vor
während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen""".split()
STOP_WORDS = tuple(sorted({s + e for stems, ends in _STEMS.items() for s in stems for e in ends} | set(_PLAIN)))


def _ends(w: Column, *endings: str) -> Column:
    n = len(endings[0])
    return (F.length(w) >= n) & F.substring(w, -n, n).isin(*endings)


def _cut(w: Column, n: Column | int) -> Column:
    return F.left(w, F.length(w) - n)


def with_stem(df: DataFrame, word: str, name: str) -> DataFrame:
    """``df`` with the stem of a column of lower-case words."""
    last = lambda n, k: F.substring(F.col("_w"), -n, k)
    w = F.col("_w")
    marked = F.regexp_replace(F.replace(F.col(word), F.lit("ß"), F.lit("ss")), f"([{VOWELS}])([uy])([{VOWELS}])", "$1<$2>$3")
    df = df.withColumn("_w", F.replace(F.replace(marked, F.lit("<u>"), F.lit("U")), F.lit("<y>"), F.lit("Y")))
    region = lambda r: F.length(F.regexp_extract(w, r, 0))
    df = df.withColumns({"_p1": region(REGION_1), "_p2": region(REGION_2)})
    whole = lambda p: F.when((F.length(w) < 3) | (F.col(p) == 0), F.length(w))
    df = df.withColumns({"_p1": whole("_p1").otherwise(F.greatest("_p1", F.lit(3))), "_p2": whole("_p2").otherwise(F.col("_p2"))})
    in_1, in_2 = (lambda n: F.length(w) - n >= F.col("_p1")), (lambda n: F.length(w) - n >= F.col("_p2"))

    one = F.when(_ends(w, "ern"), 3).when(_ends(w, "em", "er", "en", "es"), 2).when(_ends(w, "e"), 1).when(_ends(w, "s") & F.instr(F.lit(S_ENDINGS), last(2, 1)).cast("boolean") & (F.length(w) > 1), 1).otherwise(0)
    df = df.withColumn("_n", one).withColumn("_n", F.when(in_1(F.col("_n")), F.col("_n")).otherwise(0))
    soft = (F.col("_n") > 0) & (_ends(w, "en", "es") | _ends(w, "e"))
    short = _cut(w, F.col("_n"))
    df = df.withColumns({"_s": soft, "_w": short}).withColumn("_w", F.when(F.col("_s") & _ends(w, "niss"), _cut(w, 1)).otherwise(w))

    st = _ends(w, "st") & (F.length(w) >= 6) & F.instr(F.lit(ST_ENDINGS), last(3, 1)).cast("boolean")
    two = F.when(_ends(w, "est"), 3).when(_ends(w, "en", "er"), 2).when(st, 2).otherwise(0)
    df = df.withColumn("_n", two).withColumn("_w", F.when(in_1(F.col("_n")), _cut(w, F.col("_n"))).otherwise(w))

    kind = (
        F.when(_ends(w, "isch"), F.struct(F.lit("i").alias("k"), F.lit(4).alias("n"))).when(_ends(w, "lich", "heit"), F.struct(F.lit("l").alias("k"), F.lit(4).alias("n")))
        .when(_ends(w, "keit"), F.struct(F.lit("k").alias("k"), F.lit(4).alias("n"))).when(_ends(w, "end", "ung"), F.struct(F.lit("u").alias("k"), F.lit(3).alias("n")))
        .when(_ends(w, "ig", "ik"), F.struct(F.lit("i").alias("k"), F.lit(2).alias("n"))).otherwise(F.struct(F.lit("").alias("k"), F.lit(0).alias("n")))
    )
    df = df.withColumn("_t", kind)
    n, k = F.col("_t.n"), F.col("_t.k")
    goes = (n > 0) & in_2(n) & ~((k == "i") & (F.length(w) > n) & (F.substring(_cut(w, n), -1, 1) == "e"))
    df = df.withColumns({"_k": F.when(goes, k).otherwise(""), "_w": F.when(goes, _cut(w, n)).otherwise(w)})
    k = F.col("_k")
    ig = _ends(w, "ig") & in_2(2)
    more = (
        F.when((k == "u") & ig & (last(3, 1) != "e"), 2).when((k == "l") & _ends(w, "er", "en") & in_1(2), 2)
        .when((k == "k") & _ends(w, "lich") & in_2(4), 4).when((k == "k") & ig, 2).otherwise(0)
    )
    df = df.withColumn("_n", more).withColumn("_w", _cut(w, F.col("_n")))
    # as a generator: else a filter of stems would be moved below, with every step written out in it
    done = df.withColumn(name, F.explode(F.array(F.translate(w, "UYäöü", "uyaou"))))
    return done.drop("_w", "_p1", "_p2", "_n", "_s", "_t", "_k")


_BETWEEN = re.compile(f"([{VOWELS}])([uy])([{VOWELS}])")
_R1, _R2 = re.compile(REGION_1), re.compile(REGION_2)


def stem(word: str) -> str:
    """The same for one word, for tasks that hold words in Python; ``with_stem`` and this are tested against each other."""
    w = _BETWEEN.sub(lambda m: m[1] + m[2].upper() + m[3], word.replace("ß", "ss"))
    regions = [m.end() if (m := r.match(w)) and len(w) > 2 else len(w) for r in (_R1, _R2)]
    r1, r2 = max(regions[0], min(3, len(w))), regions[1]

    def last(*ends: str) -> int:
        return next((len(e) for e in ends if w.endswith(e)), 0)

    n = last("ern", "em", "er", "en", "es", "e") or (w[-1:] == "s" and w[-2:-1] in tuple(S_ENDINGS))
    if n and len(w) - n >= r1:
        soft, w = w.endswith(("e", "en", "es")), w[:-n]
        if soft and w.endswith("niss"):
            w = w[:-1]
    n = last("est", "en", "er") or 2 * (len(w) > 5 and w.endswith("st") and w[-3] in ST_ENDINGS)
    if n and len(w) - n >= r1:
        w = w[:-n]
    n = last("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik")
    if n and len(w) - n >= r2:
        ending, rest = w[-n:], w[:-n]
        if ending not in ("isch", "ig", "ik") or not rest.endswith("e"):
            w = rest
            more = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(ending, ())
            n = last(*more) if more else 0
            inside = r1 if ending in ("lich", "heit") else r2
            if n and len(w) - n >= inside and not (ending in ("end", "ung") and w.endswith("eig")):
                w = w[:-n]
    return w.translate(_LAST)


_LAST = str.maketrans("UYäöü", "uyaou")


def stem_sql(word: str, source: str, name: str = "stem") -> str:
    """CTEs in DuckDB's SQL that give ``source`` (distinct words in ``word``) its stems; the last is ``stems``."""
    v = VOWELS
    case = lambda n: f"CASE WHEN length(w) - {n} >= p1 THEN"
    return f"""g0 AS (SELECT DISTINCT {word} AS word FROM {source}),
g1 AS (SELECT word, replace(replace(regexp_replace(replace(word, 'ß', 'ss'), '([{v}])([uy])([{v}])', '\\1<\\2>\\3', 'g'), '<u>', 'U'), '<y>', 'Y') AS w FROM g0),
g2 AS (SELECT *, length(regexp_extract(w, '{REGION_1}')) AS r1, length(regexp_extract(w, '{REGION_2}')) AS r2 FROM g1),
g3 AS (SELECT word, w, CASE WHEN length(w) < 3 OR r1 = 0 THEN length(w) ELSE greatest(r1, 3) END AS p1, CASE WHEN length(w) < 3 OR r2 = 0 THEN length(w) ELSE r2 END AS p2 FROM g2),
g4 AS (SELECT *, CASE WHEN ends_with(w, 'ern') THEN 3 WHEN right(w, 2) IN ('em', 'er', 'en', 'es') THEN 2 WHEN ends_with(w, 'e') THEN 1 WHEN regexp_matches(w, '[{S_ENDINGS}]s$') THEN 1 ELSE 0 END AS n FROM g3),
g5 AS (SELECT word, p1, p2, {case("n")} left(w, length(w) - n) ELSE w END AS w, n > 0 AND length(w) - n >= p1 AND (right(w, 2) IN ('en', 'es') OR right(w, 1) = 'e') AS s FROM g4),
g6 AS (SELECT word, p1, p2, CASE WHEN s AND ends_with(w, 'niss') THEN left(w, length(w) - 1) ELSE w END AS w FROM g5),
g7 AS (SELECT *, CASE WHEN ends_with(w, 'est') THEN 3 WHEN right(w, 2) IN ('en', 'er') THEN 2 WHEN length(w) >= 6 AND regexp_matches(w, '[{ST_ENDINGS}]st$') THEN 2 ELSE 0 END AS n FROM g6),
g8 AS (SELECT word, p1, p2, {case("n")} left(w, length(w) - n) ELSE w END AS w FROM g7),
g9 AS (SELECT *, CASE WHEN ends_with(w, 'isch') THEN 'i' WHEN right(w, 4) IN ('lich', 'heit') THEN 'l' WHEN right(w, 4) = 'keit' THEN 'k' WHEN right(w, 3) IN ('end', 'ung') THEN 'u' WHEN right(w, 2) IN ('ig', 'ik') THEN 'i' ELSE '' END AS k,
  CASE WHEN right(w, 4) IN ('isch', 'lich', 'heit', 'keit') THEN 4 WHEN right(w, 3) IN ('end', 'ung') THEN 3 WHEN right(w, 2) IN ('ig', 'ik') THEN 2 ELSE 0 END AS n FROM g8),
g10 AS (SELECT *, n > 0 AND length(w) - n >= p2 AND NOT (k = 'i' AND right(left(w, length(w) - n), 1) = 'e') AS goes FROM g9),
g11 AS (SELECT word, p1, p2, CASE WHEN goes THEN k ELSE '' END AS k, CASE WHEN goes THEN left(w, length(w) - n) ELSE w END AS w FROM g10),
g12 AS (SELECT *, right(w, 2) = 'ig' AND length(w) - 2 >= p2 AS ig FROM g11),
g13 AS (SELECT word, left(w, length(w) - CASE WHEN k = 'u' AND ig AND left(right(w, 3), 1) <> 'e' THEN 2 WHEN k = 'l' AND right(w, 2) IN ('er', 'en') AND length(w) - 2 >= p1 THEN 2
  WHEN k = 'k' AND right(w, 4) = 'lich' AND length(w) - 4 >= p2 THEN 4 WHEN k = 'k' AND ig THEN 2 ELSE 0 END) AS w FROM g12),
stems AS MATERIALIZED (SELECT word, translate(w, 'UYäöü', 'uyaou') AS {name} FROM g13)"""
