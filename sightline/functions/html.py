"""What a page shows and refers to, read with the standard library's parser; as a vectorised function on columns."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and classes that change without the page's subject changing.
NOISE_TAGS = frozenset("script style noscript".split())
NOISE_CLASSES = frozenset("cookie-banner cookie-notice recommended-products recommendations chat-widget support-chat live-chat analytics".split())
NOISE_IDS = frozenset({"cookie-consent"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHAPE = "title string, text string, links array<struct<href: string, text: string>>, images array<struct<src: string, alt: string>>"


class Page(HTMLParser):
    """Collects title, visible text (one line per text node), links and images of the parts that aren't noise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.links, self.images = None, [], [], []
        self._open: list[tuple[str, bool]] = []
        self._noise = self._in_title = 0
        self._link: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        noise = tag in NOISE_TAGS or bool(NOISE_CLASSES & set((a.get("class") or "").split())) or a.get("id") in NOISE_IDS
        if tag == "img" and not self._noise:
            src = a.get("src") or a.get("data-src") or ""
            if src and not src.startswith("data:"):
                self.images.append({"src": src, "alt": a.get("alt")})
        if tag in VOID:
            return
        self._open.append((tag, noise))
        self._noise += noise
        self._in_title += tag == "title"
        if tag == "a" and not self._noise:
            self._link = [a.get("href") or "", ""]

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self._open):
            return
        while self._open:
            t, noise = self._open.pop()
            self._noise -= noise
            self._in_title -= t == "title"
            if t == "a" and self._link is not None:
                self.links.append({"href": self._link[0], "text": self._link[1].strip()})
                self._link = None
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title = (self.title or "") + data
        elif not self._noise and (text := re.sub(r"[ \t]+", " ", data).strip()):
            self.lines.append(text)
            if self._link is not None:
                self._link[1] += text


def read(html: str | None) -> dict:
    if not html:
        return {"title": None, "text": None, "links": [], "images": []}
    p = Page()
    p.feed(html)
    p.close()
    return {"title": p.title.strip() if p.title else None, "text": "\n".join(p.lines) or None, "links": p.links, "images": p.images}


def page_parts(html: Column) -> Column:
    """title, text, links and images of a page; nulls and empty arrays for a null or empty one."""

    @F.pandas_udf(SHAPE)
    def parts(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x) for x in pages], columns=["title", "text", "links", "images"])

    return parts(html)


def dom_signature(html: Column, most: int = 500) -> Column:
    """The sequence of structural elements of a page, joined by |; null if there is none."""
    tags = F.slice(F.regexp_extract_all(F.lower(html), F.lit(r"<(h1|h2|h3|a|img|table|ul|ol|section|article)[\s>/]"), F.lit(1)), 1, most)
    return F.when(F.size(tags) > 0, F.array_join(tags, "|"))
