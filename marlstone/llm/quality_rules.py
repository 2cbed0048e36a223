"""Quality rules: a threshold table compiled into one projection, without user functions.

Nulls: a null text counts as empty (no words, ``base_failed``). Very long texts are measured whole.
Repeated rows are judged each for itself. An empty table gives an empty result. Columns of the input
are kept; those named like a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = tuple(
    """a an and are as at be by for from in is it of on that the this to was with
    au avec ce dans de des du en est et la le les ne par pas pour que qui sur un une
    al con del el en es la las los lo no para por que se su un una y o
    als auch auf aus bei das dem den der des die ein eine für ich ist im in mit nicht sich sie und von war zu""".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high``; an open end is None."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The method's thresholds, over the metrics of ``metrics()``.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("bangs_per_word", None, 0.20),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_word_ratio", 0.02, None),
)


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` words at the ascending ``starts``."""
    step = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-(10**9)).cast("long").alias("end"))
    return F.aggregate(
        starts,
        step,
        lambda acc, s: F.struct(
            (acc["n"] + F.lit(width) - F.greatest(F.lit(0).cast("long"), acc["end"] - s)).cast("long").alias("n"),
            (s + F.lit(width)).cast("long").alias("end"),
        ),
        lambda acc: acc["n"],
    )


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Equal hashes only say where to look: texts without any go no further, the others compare the
    windows themselves, so the count is exact. ``width`` is 8: the hashes double three times.
    """
    last = F.size(words) - F.lit(width)

    def exact(w: Column) -> Column:
        keyed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - F.lit(width)),
                lambda i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("k"), i.cast("long").alias("i")),
            )
        )
        return let(
            keyed,
            lambda s: _covered(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, j: F.struct(
                                    x["i"].alias("i"),
                                    (
                                        F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                                        | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
                                    ).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                ),
                width,
            ),
        )

    def pairs(h: Column, gap: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))

    # windows of 1, 2, 4 and 8 words; the last 7 of these run over the end
    ones = F.transform(words, lambda x: F.xxhash64(x))
    eights = let(ones, lambda a: let(pairs(a, 1), lambda b: let(pairs(b, 2), lambda c: pairs(c, 4))))
    some = let(F.slice(eights, 1, last + 1), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    zero = F.lit(0).cast("long")
    return F.when(last < 1, zero).when(~some, zero).otherwise(exact(words))


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    measured = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    lines = let(
        F.split(t, "\n"),
        lambda x: F.struct(
            F.size(x).cast("long").alias("_n_lines"),
            let(F.filter(x, lambda y: y.rlike(r"[^\x20\x09-\x0D]")), lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
        ),
    )
    df = df.withColumns({
        "_m": measured,
        "_l": lines,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "_bangs": F.regexp_count(t, F.lit("!")).cast("long"),
    })
    return df.select("*", "_m.*", "_l.*").drop("_m", "_l")


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with base counts, ratios, ``base_failed`` and ``kept``; no shuffle, one pass over the text."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept", "_n_lines", "_bangs", "_m", "_l", *(r.metric for r in rules)}
    df = df.drop(*(c for c in df.columns if c in own and c != text))
    df = base_columns(df, text)
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumns({
        "mean_word_chars": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "bangs_per_word": per_word("_bangs"),
        "stop_word_ratio": per_word("n_stop_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.col("_n_lines"),
    })
    passed = [F.col(r.metric) >= r.low for r in rules if r.low is not None] + [F.col(r.metric) <= r.high for r in rules if r.high is not None]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        df.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, passed, F.lit(True)))
        .drop("_n_lines", "_bangs")
    )
