"""Scans of landed web pages: article text, and the items of changelogs and index pages."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = ("script", "style", "nav", "header", "footer", "form")
HEADINGS = ("h1", "h2", "h3", "h4")
_ITEM = "page_id long, url string, id string, text string, published string, link string, pos int"


class _Blocks(HTMLParser):
    """Headings, list items and paragraphs outside the skipped parts, in order, each with all the text inside it.

    A block is [tag, texts, link, anchor]. A paragraph ends where another block starts, a list item where the next one does;
    a heading's link is the one inside or around it, else the next on the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[list] = []
        self.unlinked: list[list] = []
        self.skip, self.link, self.lists = 0, "", 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        at = dict(attrs)
        if tag == "a" and at.get("href"):
            self.link = at["href"]
            for block in self.unlinked:
                block[2] = self.link
            self.unlinked = []
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag in (*HEADINGS, "li", "p"):
            self._shut(lambda b: b[0] == "p" or b[0] in HEADINGS or tag == "li" and b[0] == "li" and b[4] >= self.lists)
            block = [tag, [], self.link if tag in HEADINGS else "", at.get("id") or "", self.lists]
            self.blocks.append(block)
            self.open.append(block)
            if tag in HEADINGS and not block[2]:
                self.unlinked.append(block)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "a":
            self.link = ""
        elif tag in ("ul", "ol"):
            self._shut(lambda b: b[4] >= self.lists)
            self.lists = max(0, self.lists - 1)
        elif any(b[0] == tag for b in self.open):
            self._shut(lambda b: b[0] == tag or b[0] == "p")

    def handle_data(self, data):
        if not self.skip:
            for block in self.open:
                block[1].append(data)

    def _shut(self, ends):
        self.open = [b for b in self.open if not ends(b)]

    def found(self) -> list[tuple[str, str, str, str]]:
        return [(tag, text, link, anchor) for tag, texts, link, anchor, _ in self.blocks if (text := " ".join(" ".join(x.split()) for x in texts if x.strip()))]


#: Private-use letters, by which documentation sites mark the links of headings.
_GLYPHS = re.compile("[\ue000-\uf8ff]")


def heading_date(text: str) -> str:
    """The date that a heading begins with ("September 22, 2026" or "Sep 22, 2026"), else nothing."""
    m = re.match(r"([A-Z][a-z]{2})[a-z]*\s+(\d{1,2}),\s*(\d{4})", text.strip())
    try:
        return datetime.strptime(" ".join(m.groups()), "%b %d %Y").date().isoformat() if m else ""
    except ValueError:
        return ""


def items_of(url: str, html: str, limit: int | None = None) -> list[tuple[str, str, str, str]]:
    """(id, text, published, link): a page with a dated heading is a changelog, of any other the headings are items; the first ``limit``, or all."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    blocks = [(t, _GLYPHS.sub("", x).strip() if t in HEADINGS else x, link, anchor) for t, x, link, anchor in parser.found()]
    found, seen, date, place = [], set(), "", ""
    dated = any(t in HEADINGS and heading_date(x) for t, x, _, _ in blocks)
    for tag, text, link, anchor in blocks:
        if tag in HEADINGS and text:
            date, place = heading_date(text), anchor
        take = dated and tag in ("li", "p") and date and len(text) >= 30 or not dated and tag in HEADINGS and len(text) >= 12
        if take and text not in seen:
            seen.add(text)
            digest = hashlib.sha256(f"{url}#{text[:160] if dated else text}".encode()).hexdigest()[:16]
            goes = (f"{url}#{place}" if place else url) if dated else urljoin(url, link) if link else url
            found.append((digest, text, date if dated else "", goes))
    return found[:limit]


#: Pages of a slice.
SLICE = 64


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that few pages are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


_GONE = re.compile(r"<(script|style|nav|header|footer|aside|form)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^>]*>", re.S)


def text_of(html: str) -> str:
    """A page's text: skipped parts and tags removed, entities resolved, single spaces."""
    return " ".join(unescape(_TAG.sub(" ", _GONE.sub(" ", html))).split())


def page_items(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, url, id, text, published ("" if undated), link, pos."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = [(p, u, *x, k) for p, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for k, x in enumerate(items_of(u or "", h or "", limit))]
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            names = ["page_id", "url", "id", "text", "published", "link", "pos"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    return pages.select("page_id", "url", "html").mapInArrow(rows, _ITEM)


def page_text(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, the article text (its first ``most`` characters, or all) and whether it is long enough to be used."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = [text_of(h or "")[:most] for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) >= 200 for t in texts])], names=["page_id", "text", "usable"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(rows, "page_id long, text string, usable boolean")
