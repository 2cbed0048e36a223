"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: The edge of a word of ASCII letters, digits and underscores; Java's own also takes letters beyond ASCII for parts of a word.
EDGE = r"(?-iu:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Separators of Unicode (Zs), as SQL's trim takes them.
_BLANKS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: An API key of the prefixes sk-, sk-proj- and gsk_.
API_KEY = EDGE + r"(?:sk-(?:proj-)?|gsk_)[A-Za-z0-9_\-]{8,}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def trimmed(text: Column) -> Column:
    """Without blanks of any kind at the ends; tabs and line ends stay."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))


def collapse(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f\x0B]+", " "))


def fact_key(text: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces: the key for repeated facts."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def _compositions() -> list[tuple[str, str]]:
    """(letter and mark, letter) of all letters that canonical decomposition parts in two."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and 0x300 <= int(parts[1], 16) <= 0x36F:
            pairs.append((chr(int(parts[0], 16)) + chr(int(parts[1], 16)), chr(code)))
    return pairs


def composed(text: Column) -> Column:
    """letters written as a letter and a combining mark as one letter; texts without marks are not touched.

    Marks are taken in the order in which they stand, up to three a letter.
    """
    letters = F.create_map(*(F.lit(x) for pair in _compositions() for x in pair))
    def once(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit("(?s).[\u0300-\u036f]?"), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(letters, p), p)), "")

    return F.when(text.rlike("[\u0300-\u036f]"), once(once(once(text)))).otherwise(text)


def name_key(text: Column) -> Column:
    """Composed letters, lower case, separators to spaces, other punctuation dropped: the key for names of artists."""
    spaced = F.regexp_replace(F.lower(composed(F.coalesce(text, F.lit("")))), r"[-_/&+.]", " ")
    return collapse(F.regexp_replace(spaced, r"[^\p{L}\p{N}\s]", ""))


def title_key(text: Column) -> Column:
    """Lower case, parts in parentheses and punctuation dropped: the key for titles."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\([^)]*\)", "")
    return collapse(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", ""))


def shorten(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis."""
    line = collapse(text)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def redact_keys(text: Column, mark: str = "[KEY REMOVED]") -> Column:
    """API keys (prefixes sk-, sk-proj- and gsk_) replaced by a mark."""
    return F.regexp_replace(text, API_KEY, mark)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def german_number(value: Column, digits: int = 2) -> Column:
    """Thousands by points and decimals by a comma."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def plausible_rewrite(raw: Column, new: Column) -> Column:
    """A rewrite is kept if not empty and, for texts of 80 characters and more, at least 60 % as long."""
    return F.when(F.length(F.trim(F.coalesce(new, F.lit("")))) == 0, False).when(F.length(raw) < 80, True).otherwise(F.length(new) >= F.lit(0.6) * F.length(raw))


def title_if_lower(c: Column) -> Column:
    """Every letter after a character that is none in upper case, for texts that are all lower case only."""
    parts = F.transform(F.split(c, r"(?<=[^\p{L}])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(c == F.lower(c), F.array_join(parts, "")).otherwise(c)
