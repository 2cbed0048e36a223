"""Pages of HTML into rows, with the standard parser inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.found, self._in, self._text = "", [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self._in = "title"
        elif tag == "a":
            self._in, self._text = "a", []
            self.found.append([dict(attrs).get("href") or "", ""])

    def handle_endtag(self, tag):
        if tag == self._in:
            self._in = None

    def handle_data(self, data):
        if self._in == "title":
            self.title += data
        elif self._in == "a":
            self.found[-1][1] += data


def parse(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Title, and (href, text) of every link."""
    p = _Links()
    p.feed(page)
    p.close()
    return p.title.strip(), [(h, t.strip()) for h, t in p.found]


def links(pages: DataFrame) -> DataFrame:
    """page_id, title, ord, href, label; a page without links has one row with a null ord."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, page in zip(part["page_id"], part["html"]):
                title, found = parse(page or "")
                rows += [(key, title, i, h, t) for i, (h, t) in enumerate(found)] or [(key, title, None, None, None)]
            yield pd.DataFrame(rows, columns=["page_id", "title", "ord", "href", "label"]).astype({"ord": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, ord int, href string, label string")
