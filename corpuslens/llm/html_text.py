"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, scan

#: Reach of the smoothing in lines, and share of the content that article and main elements must hold to be the article.
SIGMA, REGION_SHARE = 2.0, 0.6

# Element names of HTML, by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NEVER_TEXT = {
    "head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe", "object",
    "svg", "canvas", "audio", "video", "dialog", "menu", "datalist", "input",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td"}
SAME_CLOSES = {"li", "dt", "dd", "tr", "td", "th", "option"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words in class and id that mark what is not the article.
SIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "sponsor", "sponsored", "promo",
    "promotion", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead",
    "footer", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "widgets", "toolbar", "search", "pagination", "pager", "skip", "copyright",
    "disclaimer", "form",
}
#: Side words that mark prose too, so its density does not speak for it.
OTHER_VOICES = {"comment", "comments", "disqus", "cookie", "cookies", "consent", "gdpr"}
#: Side words that inside an article mark its own head.
HEADS = {"header", "masthead"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Open(NamedTuple):
    """An open element: what a line in it has to know, so that no line walks up the tree."""

    tag: str
    number: int
    side: bool  # outside the article
    doubt: int  # number of the nearest element in doubt, 0: none
    container: int  # number of the nearest container, itself included
    list_: int  # number of the nearest list, itself included
    listed: int  # number of the list of the nearest item, -1: an item without a list, 0: no item


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    container: int
    declared: bool  # inside an article or main element
    side: bool
    listed: int
    doubt: int


class _Lines(HTMLParser):
    """Parser events gathered into lines: the text between two block tags, with its tags, links and place in the tree.

    Elements are numbered as they open, so those inside an element have the numbers from its own to `last`.
    """

    def __init__(self, words: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.words, self.worded = words, False  # whether class and id count, and whether they have
        self.open: list[_Open] = []
        self.many: Counter[str] = Counter()  # open elements by tag
        self.numbers = self.links = self.articles = 0
        self.whole: set[int] = set()  # numbers of article and main elements
        self.above: dict[int, int] = {}  # of containers
        self.last: dict[int, int] = {}
        self.doubts: dict[int, list[int]] = {}  # of elements in doubt: the next one above, first and last line
        self.text: list[str] = []
        self.linked, self.tags = 0, 0
        self.found: list[_Line] = []

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at = self.open[-1] if self.open else _Open("", 0, False, 0, 0, 0, 0)
            self.found.append(_Line(text, self.tags, min(self.linked, len(text)), at.container, self.articles > 0, at.side, at.listed, at.doubt))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.line()
            if tag in CLOSES_P:
                self._close("p", stop={"article", "section", "div", "td", "li", "button"})
            elif tag in SAME_CLOSES:
                self._close(tag, stop={"ul", "ol", "dl", "table", "select"})
        if tag in VOID:
            return
        up = self.open[-1] if self.open else _Open("", 0, False, 0, 0, 0, 0)
        self.numbers += 1
        number, doubt, container = self.numbers, up.doubt, up.container
        mark = None if up.side else self._side(tag, attrs)
        if mark is None and not up.side:
            self.doubts[number] = [doubt, len(self.found), -1]
            doubt = number
        if tag in CONTAINERS:
            self.above[number] = container
            container = number
        list_ = number if tag in ("ul", "ol", "menu") else up.list_
        self.open.append(_Open(tag, number, up.side or mark is True, doubt, container, list_, (up.list_ or -1) if tag == "li" else up.listed))
        self.many[tag] += 1
        self.links += tag == "a"
        if tag in ("article", "main"):
            self.articles += 1
            self.whole.add(number)

    def _side(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """Whether an element is not the article's; None if only a part of a name in class or id says so."""
        if tag in NEVER_TEXT or (tag == "header" and not self.articles):
            return True
        if not attrs or tag in ("html", "body"):
            return False
        doubt = False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value or "")):
                return True
            if name == "role" and (value or "").lower() in SIDE_ROLES:
                return True
            if name in ("class", "id") and tag not in ("article", "main") and self.words:
                for whole in (value or "").split():
                    words = {w.lower() for w in _WORD.findall(whole)}
                    meant = (words & SIDE_WORDS) - (HEADS if self.articles else set())
                    if meant:
                        self.worded = True
                        if meant == words or not meant.isdisjoint(OTHER_VOICES):
                            return True
                        doubt = True
        return None if doubt else False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.line()
        self._close(tag, stop=() if tag not in INLINE else {"article", "section", "div", "p", "li", "td", "body"})

    def _close(self, tag: str, stop) -> None:
        if not self.many[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i].tag
            if name == tag:
                self._end(i)
                return
            if name in stop:
                return

    def _end(self, first: int) -> None:
        """The elements from this place of the stack on are over."""
        for x in self.open[first:]:
            self.many[x.tag] -= 1
            self.links -= x.tag == "a"
            self.articles -= x.tag in ("article", "main")
            if x.number in self.above:
                self.last[x.number] = self.numbers
            if x.number in self.doubts:
                self.doubts[x.number][2] = len(self.found)
        del self.open[first:]

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.line()
        self._end(0)


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = math.ceil(2 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def _content(lines: list[_Line], sides: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside links of each line, none at a side, and whether its smoothed ratio makes it content."""
    plain = np.array([0 if side else len(x.text) - x.linked for x, side in zip(lines, sides, strict=True)], float)
    ratios = _smoothed(plain / np.maximum(1, [x.tags for x in lines]))
    return plain, (ratios >= ratios.std()) & (plain > 0)


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, white space inside each as one space, joined by one space.

    Each line's text outside links is set against its tags; the ratios are smoothed over neighbouring lines, and lines
    above one standard deviation are content. The region is the smallest container that holds all content (for one
    inside an article or main element, that one; if such elements hold most of the content, only they count). It is
    taken whole, short blocks too, but for elements that are by name, role, class or id not the article's. An element
    of which only a part of a name says so goes if most of its text is not content. Outside article and main elements,
    list items that are only links go, but for lists of nothing else below the first content. Where class and id
    would leave nothing, they do not count.
    """
    if not html:
        return ""
    for words in (True, False):
        parser = _Lines(words)
        parser.feed(html)
        parser.finish()
        text = _article(parser)
        if text or not parser.worded:
            break
    return text


def _set_aside(page: _Lines) -> list[bool]:
    """Lines outside the article, by name or because an element in doubt around them has not more content than other text."""
    lines, sides = page.found, [x.side for x in page.found]
    if not page.doubts:
        return sides
    plain, content = _content(lines, sides)
    worth = [0.0 if side else weight - len(x.text) / 2 for x, side, weight in zip(lines, sides, np.where(content, plain, 0.0).tolist(), strict=True)]
    total = np.concatenate([[0.0], np.cumsum(worth)])
    out: dict[int, bool] = {0: False}
    for number, (up, first, last) in page.doubts.items():  # outer ones first
        out[number] = out[up] or bool(total[last] <= total[first])
    return [side or out[x.doubt] for x, side in zip(lines, sides, strict=True)]


def _region(page: _Lines, held: list[int]) -> int | None:
    """The smallest container around all containers held, or the article or main element around that."""
    if not held or min(held) == 0:
        return None
    at, low, high = held[0], min(held), max(held)
    while at and not (at <= low and high <= page.last[at]):
        at = page.above[at]
    up = at
    while up and up not in page.whole:
        up = page.above[up]
    return up or at or None


def _article(page: _Lines) -> str:
    lines = page.found
    if not lines:
        return ""
    sides = _set_aside(page)
    plain, content = _content(lines, sides)
    weights = np.where(content, plain, 0.0) if content.any() else plain
    declared = np.array([x.declared for x in lines])
    only_declared = weights[declared].sum() >= REGION_SHARE * weights.sum() and declared.any()
    holding = np.flatnonzero((weights > 0) & (declared | (not only_declared)))
    region = _region(page, [lines[i].container for i in holding])
    first = int(np.flatnonzero(weights > 0)[0]) if len(holding) else 0
    mixed = {x.listed for x in lines if x.listed and x.linked < len(x.text) - 1}
    kept = []
    for i, x in enumerate(lines):
        inside = region is None or region <= x.container <= page.last[region]
        if sides[i] or not inside or (only_declared and not declared[i]):
            continue
        if x.listed and x.linked >= len(x.text) - 1 and not declared[i] and (x.listed in mixed or i < first):
            continue
        kept.append(x.text)
    return " ".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page, from its whole html.

    Null or empty html, or a page without text, gives the empty text; ids and urls may be null and rows repeat; an
    empty table gives no rows; further columns are not read. There is no exchange.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_map(rows, _extracted, "page_id long, url string, text string")


def op9_html_text(spark, sf_dir):
    rows = extract_pages(scan(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
