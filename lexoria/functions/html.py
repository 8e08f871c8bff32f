"""Records from saved pages. Parsing HTML has no native expression: Arrow batches, standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

# Elements without an end tag.
VOID = {"br", "img", "hr", "input", "meta", "link"}


class _Collect(HTMLParser):
    """Texts of the elements with a class, and for each the link with a path's beginning inside it."""

    def __init__(self, cls: str, body: str, href: str) -> None:
        super().__init__(convert_charrefs=True)
        self.cls, self.body, self.href = cls, body, href
        self.depth, self.inside, self.in_body = 0, None, None
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.depth += 1
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if self.inside is None and self.cls in classes:
            self.inside, self.text, self.source = self.depth, [], ""
        elif self.inside is not None:
            if tag == "a" and a.get("href", "").startswith(self.href):
                self.source = a["href"][len(self.href) :]
            if self.in_body is None and self.body in classes:
                self.in_body = self.depth

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if self.in_body == self.depth:
            self.in_body = None
        if self.inside == self.depth:
            text = " ".join("".join(self.text).split())
            if text:
                self.found.append((self.source, text))
            self.inside = None
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.inside is not None and self.in_body is not None:
            self.text.append(data)


# The classes and the link of entries on the pages that are read.
ENTRY, BODY, SOURCE = "defWrapper", "def", "/sursa/"


def html_entries(cls: str = ENTRY, body: str = BODY, href: str = SOURCE):
    """A column function: html -> array<struct<source, text>>, one for each element of class `cls`,
    with the text of its part of class `body` and the end of its link that begins with `href`. Null
    and broken pages give what can be read of them, at worst an empty array."""

    @F.pandas_udf("array<struct<source string, text string>>")
    def parse(pages: pd.Series) -> pd.Series:
        def one(page):
            p = _Collect(cls, body, href)
            p.feed(page or "")
            p.close()
            return [{"source": s, "text": t} for s, t in p.found]

        return pages.map(one)

    return parse


def best_texts(entries, sources: list[str], most: int = 3):
    """The texts of the wanted sources, the first so many, joined by ' | '; null if there are none."""
    kept = F.transform(F.filter(entries, lambda e: e["source"].isin(sources)), lambda e: e["text"])
    return F.nullif(F.array_join(F.slice(kept, 1, most), " | "), F.lit(""))
