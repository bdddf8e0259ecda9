"""Main-text extraction from HTML.

Parser events of the standard library are turned into lines, one for each block
element's run of text.  Every line has a text-to-tag ratio: its characters
outside links over the tags that stood in it, so that menus and lists of links
have next to none.

The page's structure is evidence that weighs a line's ratio: lines of a marked
article count more, lines outside it less, and those of elements that are never
content (headers and footers of the page, asides, forms, and blocks whose class,
id or role names a sidebar, a notice, an advert or reader comments) next to
nothing.  Menus have no such weight: their links tell.  Lines of one weight that
follow each other are a region.  Ratios are smoothed with a Gaussian kernel
inside their region, weighted, and clustered by a threshold, a share of their
standard deviation over the page: regions whose mean by characters is under it
are left out, and so are lines under it, but for lines of an article's region
that aren't mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, ship

SIGMA, WINDOW, SHARE = 1.0, 2, 0.35
#: A line beside content, whose own ratio is less, isn't content for its neighbours' sake.
LEAST = 1.0
#: Weights of a line's ratio: in the article, where nothing is marked or in a menu, outside a marked article, in what is never content.
ARTICLE, PLAIN, OUTSIDE, NEVER = 2.0, 1.0, 0.02, 0.002
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text in these is never part of a page.
_SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea".split())
_ASIDE = frozenset("aside footer form dialog button".split())
_MENU = frozenset("nav menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING_BOX = frozenset(("article", "main", "section"))
#: These close an open p.
_ENDS_P = _BLOCK - {"html", "body", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Of each, a new one ends the one before it up to the container named.
_ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_WORDS = (
    "breadcrumb breadcrumbs header masthead banner footer sidebar aside widget ad ads advert adverts advertisement advertising promo promoted sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments reply replies respond disqus discussion pagination pager toolbar"
)
_NOT_CONTENT = re.compile(r"(?:^|[\s_-])(?:" + "|".join(_WORDS.split()) + r")(?=$|[\s_-])", re.I)
#: An article with one of these is a comment, a teaser or an advert.
_NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|ad|advert|advertisement|promo|sponsored|teaser|related)(?=$|[\s_-])", re.I)
_OWN_HEADER = re.compile(r"(?:article|post|entry|story|content)[_-]header", re.I)
_ROLES = frozenset("banner contentinfo complementary search form dialog alert alertdialog toolbar".split())
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[_-]?(?:body|content|text)(?=$|[\s_-])", re.I)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  #: characters in links
    never: bool  #: in an element that is never content
    article: bool
    menu: bool


class State(NamedTuple):
    silent: bool = False
    never: bool = False
    article: bool = False
    menu: bool = False


class _Lines(HTMLParser):
    """The lines of a page.  Where each tag is open is kept by name, so an event costs the same however deep the page is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, State]] = []  # tag, the state outside it
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.state = State()
        self.words: list[str] = []
        self.tags = self.linked = 0
        self.marked = False
        self.title = -1  # the last page heading before what is marked

    def last(self, tag: str) -> int:
        """The place of the innermost open element of the name, or -1."""
        return (self.places.get(tag) or [-1])[-1]

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            if not self.marked and not self.state.never and not self.state.menu and self.last("h1") >= 0:
                self.title = len(self.lines)
            self.lines.append(Line(text, self.tags, self.linked, *self.state[1:]))
        self.words, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        p = self.last("p")
        if tag in _ENDS_P and p >= 0 and p == self.blocks[-1]:
            self._close(p)
        if tag in _ENDS_SAME:
            for same in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                k = self.last(same)
                if k >= 0 and all(self.last(x) < k for x in _ENDS_SAME[tag]):
                    self._close(k)
        if tag in _BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.words.append(" ")
        if tag in _VOID:
            return
        silent, never, article, menu = self.state
        silent = silent or tag in _SILENT
        if not never:
            never = tag in _ASIDE or tag == "header" and all(self.last(x) < 0 for x in _HEADING_BOX)
        menu = menu or tag in _MENU
        content = tag == "article" or tag == "main"
        for name, value in attrs:
            if value and name in ("class", "id") and tag not in ("html", "body") and not never:
                content = content or bool(_CONTENT.search(value))
                never = bool((_NOT_ARTICLE if content else _NOT_CONTENT).search(_OWN_HEADER.sub("", value)))
            elif name == "role" and value and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                never = True
            elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                never = True
        if content and not never:
            article = self.marked = True
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.state))
        self.state = State(silent, never, article, menu)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCK and tag != "a":
            self.handle_endtag(tag)

    def _close(self, k: int) -> None:
        if self.blocks and self.blocks[-1] >= k:
            self.end_line()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        for tag, _ in self.open[k:]:
            self.places[tag].pop()
        self.state = self.open[k][1]
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        k = self.last(tag)
        if k >= 0 and (tag in _BLOCK or not self.blocks or k > self.blocks[-1]):
            self._close(k)
        elif k < 0 and tag in _BLOCK:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.state.silent:
            self.words.append(data)
            if self.last("a") >= 0:
                self.linked += len(data)


def content_lines(lines: list[Line], marked: bool, ratio: bool = True) -> list[str]:
    """The lines of the content regions; without ``ratio`` every line counts the same before it is weighted."""
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines], np.float64)
    linked = np.minimum([x.linked for x in lines], size)
    weight = np.array([NEVER if x.never else PLAIN if x.menu or not marked else ARTICLE if x.article else OUTSIDE for x in lines])
    dense = (size - linked) / (1 + np.array([x.tags for x in lines])) if ratio else np.ones(len(lines))
    inside = np.array([x.article and not x.never and not x.menu for x in lines])
    kernel = np.exp(-0.5 * (np.arange(-WINDOW, WINDOW + 1) / SIGMA) ** 2)
    menu = np.array([x.menu for x in lines])
    cuts = [0, *(np.flatnonzero((np.diff(weight) != 0) | (np.diff(menu.astype(int)) != 0)) + 1).tolist(), len(lines)]
    regions = list(zip(cuts[:-1], cuts[1:], strict=True))
    score = np.zeros(len(lines))
    for a, b in regions:
        total = np.convolve(np.ones(b - a), kernel)[WINDOW : WINDOW + b - a]
        score[a:b] = weight[a:b] * np.convolve(dense[a:b], kernel)[WINDOW : WINDOW + b - a] / total
    threshold = SHARE * score.std()
    out = []
    for a, b in regions:
        if (score[a:b] * size[a:b]).sum() >= threshold * size[a:b].sum():
            out += [lines[k].text for k in range(a, b) if score[k] >= threshold and dense[k] >= LEAST or inside[k] and 2 * linked[k] <= size[k]]
    return out


def main_text(html: str, ratio: bool = True) -> str:
    """The blocks of the main text, joined by line feeds; empty if there are none.

    A null page counts as empty.  Markup that is cut off or wrongly nested is
    read as far as it goes; nothing is dropped for its length.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines = parser.lines
    if parser.marked and parser.title >= 0:
        lines[parser.title] = lines[parser.title]._replace(article=True)
    return "\n".join(content_lines(lines, parser.marked, ratio))


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row; rows repeat as they come, other columns are not read.

    A null or empty page, and one without content, has an empty text and 0; an
    empty table gives no rows; a page of any length is read in whole.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
