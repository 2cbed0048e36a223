"""Dates out of free text."""

from __future__ import annotations

import bisect
import re

# Month names, whole and short, German and English.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "feb": 2, "february": 2, "februar": 2, "mar": 3, "mär": 3, "march": 3, "märz": 3, "maerz": 3,
    "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "okt": 10, "october": 10, "oktober": 10, "nov": 11, "november": 11,
    "dec": 12, "dez": 12, "december": 12, "dezember": 12,
}

_TOKEN = re.compile(r"\d+|[^\W\d_]+")


def numeric_date(first: int, mark: str, second: int, year: int) -> str | None:
    """Points are day first; with slashes the part above 12 is the day, and without one the date is unknown."""
    if mark == "/" and first <= 12:
        if second <= 12:
            return None
        first, second = second, first
    return f"{year}-{second:02d}-{first:02d}" if 1 <= second <= 12 and 1 <= first <= 31 else None


def dates_in(text: str) -> list[tuple[int, str]]:
    """(place, ISO date) of all plausible dates in order.

    A date is three tokens in a row, the last a year of four digits: day and month as numbers between points or
    slashes, or a day and a month's name in either order between blanks, points and commas.
    """
    out, last = [], (None, None)
    for c in _TOKEN.finditer(text):
        (a, b), last = last, (last[1], c)
        if a is None:
            continue
        x, y, year = a[0], b[0], c[0]
        if len(year) != 4 or not year.isdecimal():
            continue
        gaps = text[a.end() : b.start()], text[b.end() : c.start()]
        if x.isdecimal() and y.isdecimal():
            if max(len(x), len(y)) <= 2 and all(g in (".", "/") for g in gaps) and (d := numeric_date(int(x), gaps[0], int(y), int(year))):
                out.append((a.start(), d))
        elif x.isdecimal() != y.isdecimal() and all(g and not g.strip(" \t\r\n.,") and (g.strip() != g or "," in g) for g in gaps):
            day, name = (x, y) if x.isdecimal() else (y, x)
            month = MONTHS.get(name.lower())
            if month and len(day) <= 2 and 1 <= int(day) <= 31:
                out.append((a.start(), f"{year}-{month:02d}-{int(day):02d}"))
    return out


def nearest_date(text: str, keywords, reach: int = 400) -> str | None:
    """The date closest to any keyword, within reach; the first in the text on ties."""
    low = text.lower()
    places = sorted({m.start() for k in keywords for m in re.finditer(re.escape(k), low)})
    best = None
    for at, day in dates_in(text) if places else ():
        i = bisect.bisect(places, at)
        away = min(abs(at - p) for p in places[max(0, i - 1) : i + 1])
        if away <= reach and (best is None or away < best[0]):
            best = (away, day)
    return best[1] if best else None
