"""Main text of web pages from text-to-tag ratios.

The standard library's streaming parser turns a page into lines: a block element
starts a new line, inline elements and ``br`` stay inside theirs.  Lines below
elements that never hold article text (scripts, styles, menus, headers, footers,
sidebars, forms) or whose class, id or role names such a part (adverts, notices,
reader comments) are not read.  Each line has a text-to-tag ratio, characters over
tags; the ratios, smoothed by a Gaussian over neighbouring lines, fall into two
clusters at ``threshold`` standard deviations of the page, content above.

Clusters select regions: where a page marks articles (``article``, ``main``; nested
ones are part of the outermost), all with content, each whole, so a short paragraph
of an article is not lost; those inside a part of such a name only with half as much
as the largest.  A name does not skip an article, or what holds one, unless it names
comments; elsewhere the run from the first to the
last content line with all lines of the block elements that hold one, without
lines that are mostly links.  Nor does a name, or a form, skip what holds most of the
text of a page without marked articles, unless it names comments or something else
on the page is content and the whole name is that of a side part.

Defined results: null and empty pages have the empty text; unclosed elements end
with their parents (a menu left open ends where an article starts); a page without
content lines gives the empty text; repeated rows are treated alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
THRESHOLD = 0.5
#: Times a page is read again to free parts that hold its article.
REREADS = 6
#: HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea option iframe object "
                    "svg canvas dialog menu".split())
RAW = frozenset(("script", "style"))
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
             "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
SCOPE = frozenset("article main section div body table ul ol blockquote nav aside header footer form".split())
REGION = frozenset(("article", "main"))
#: Words in class, id or role that name parts outside the article.
NAMED = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu "
                  "breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
                  "subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies "
                  "respond pagination pager toolbar widget widgets search contentinfo complementary dialog alert alertdialog form toc "
                  "skip".split())


COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: First words of names that tell about a part elsewhere ("has-sidebar").
ABOUT = frozenset("has no with without not hide show".split())
#: Last words of names that leave the part named before them what it is ("sidebar-left").
PLACES = frozenset("bar block bottom box button buttons icon icons inner item items left link links list posts right slot text title top unit".split())


def named(value: str) -> set[str]:
    """Parts that the words of a class, id or role name: a word's last part, or any before a place."""
    out: set[str] = set()
    for word in value.split():
        parts = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", word).lower())
        if parts and not (len(parts) > 1 and parts[0] in ABOUT):
            out.update(parts if parts[-1] in PLACES else parts[-1:])
    return out & NAMED


def plain(value: str) -> bool:
    """Whether some word of a class, id or role names a part and nothing else ("job-search" does not)."""
    words = [re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", w).lower()) for w in value.split()]
    return any(w and set(w) <= NAMED | PLACES and not NAMED.isdisjoint(w) for w in words)


class Part(NamedTuple):
    """A skipped element that may hold the article after all."""
    number: int  # of the element
    depth: int
    comments: bool
    plain: bool  # named as such a part by a whole word, or a form


class Lines(HTMLParser):
    """Lines of a page: text, tags, characters in links, region.  Every end tag
    finds its element by name, so a page takes time in proportion to its length."""

    def __init__(self, freed: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.freed = freed  # numbers of elements that hold an article: their names skip nothing
        self.holds: set[int] = set()  # such elements found
        self.elements = 0
        self.named: list[Part] = []  # open elements of such a name, forms
        self.comments = 0  # of them
        self.parts_skipped: dict[Part, list[int]] = {}  # characters, and those in links, below the outermost
        self.outer: Part | None = None
        self.beside: set[int] = set()  # regions inside a named element
        self.open: list[tuple[str, int, int, int]] = []  # element, starts a skipped part (1: by a name or a form), region, block
        self.at: dict[str, list[int]] = {}  # depths of the open elements of a name
        self.scopes: list[int] = []  # of those in SCOPE
        self.outline: list[int] = []  # of those not inline
        self.skip = 0
        self.freeable = 0  # of them by a name or a form
        self.links = 0
        self.regions = 0
        self.blocks = 0
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def region(self) -> int:
        return self.open[-1][2] if self.open else 0

    def block(self) -> int:
        return self.open[-1][3] if self.open else 0

    def deepest(self, names) -> int:
        """Depth of the innermost open element of these names, -1 for none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.region(), self.block()))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop(self) -> None:
        tag, skipped, _, _ = self.open.pop()
        depth = len(self.open)
        self.at[tag].pop()
        for stack in (self.scopes, self.outline):
            if stack and stack[-1] == depth:
                stack.pop()
        if self.named and self.named[-1].depth == depth:
            part = self.named.pop()
            self.comments -= part.comments
            if self.outer is part:
                self.outer = None
        self.skip -= skipped > 0
        self.freeable -= skipped == 1
        self.links -= tag == "a"

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE and tag != "br":
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        closes = CLOSED_BY.get(tag)
        if closes:
            # a table cell ends its own kind, an item its own list's
            if (depth := self.deepest(closes)) > (self.scopes[-1] if self.scopes else -1):
                self.close_to(depth)
        if tag in REGION:
            while self.open and self.open[-1][0] in ("nav", "header", "footer", "form", "menu", "ul", "li", "a", "p"):
                self.pop()  # left open
        self.elements += 1
        skipped, names, whole = 2 * (tag in SKIPPED and tag != "form"), set(), tag == "form"
        if attrs and not skipped:
            for name, value in attrs:
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    skipped = 2
                elif name in ("class", "id", "role") and value and tag not in ("html", "body", "main"):
                    found = named(value)
                    names |= found
                    whole = whole or bool(found) and plain(value)
                elif name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
                    skipped = 2
        if tag in REGION:
            names &= COMMENTS  # an article is skipped as a comment only
            if not skipped and not names and not self.comments:
                for part in reversed(self.named):
                    if part.number in self.holds:
                        break
                    self.holds.add(part.number)
        if (names or tag == "form") and not skipped:
            part = Part(self.elements, len(self.open), not names.isdisjoint(COMMENTS), whole)
            self.named.append(part)
            self.comments += part.comments
            skipped = int(self.elements not in self.freed)
            if skipped and not self.skip:
                self.outer = part
        new = tag in REGION and not self.region()  # nested ones belong to the outermost
        self.regions += new
        if new and self.named:
            self.beside.add(self.regions)
        self.blocks += tag in SCOPE
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        if tag not in INLINE:
            self.outline.append(len(self.open))
        self.open.append((tag, skipped, self.regions if new else self.region(), self.blocks if tag in SCOPE else self.block()))
        self.skip += skipped > 0
        self.freeable += skipped == 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        depth = self.deepest((tag,))
        # an inline end does not close blocks
        if depth >= 0 and not (tag in INLINE and self.outline and self.outline[-1] > depth):
            self.close_to(depth)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)
        elif self.outer and self.skip == self.freeable:
            mass = self.parts_skipped.setdefault(self.outer, [0, 0])
            size = len(data) - data.count(" ")
            mass[0] += size
            mass[1] += size if self.links else 0


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean of neighbouring lines; the kernel is cut at the page's ends."""
    r, n = max(1, int(np.ceil(2 * sigma))), len(ratio)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[r:r + n] / np.convolve(np.ones(n), kernel)[r:r + n]


def read(html: str, freed: frozenset[int] = frozenset()) -> Lines:
    page = Lines(freed)
    # what begins after the last end of a tag is no tag: the parser would look for its end from each "<"
    end = html.rfind(">") + 1
    page.feed(html[:end])
    page.close()
    page.handle_data(unescape(html[end:]))
    page.end_line()
    return page


def held(page: Lines) -> set[int]:
    """Skipped elements that are no side part: without marked articles, one that has
    most of the page's text, not in links, if its name is none ("job-search") or nothing
    else on the page is content (a form around the page)."""
    if any(region for *_, region, _ in page.lines):
        return set()
    read_size = sum(len(x[0]) - x[0].count(" ") - min(x[2], len(x[0])) for x in page.lines)
    total = read_size + sum(size for part, (size, _) in page.parts_skipped.items() if not part.comments)
    return {part.number for part, (size, linked) in page.parts_skipped.items()
            if not part.comments and linked * 2 <= size and size * 2 > total and (not part.plain or read_size * 10 <= size)}


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    page = read(html or "")
    freed: set[int] = set()
    # parts inside each other are freed one after another, a few deep
    for _ in range(REREADS):
        found = (page.holds | held(page)) - freed
        if not found:
            break
        freed |= found
        page = read(html or "", frozenset(freed))
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = size / np.maximum(1, [x[1] for x in lines])
    smooth = smoothed(ratio, sigma)
    content = smooth >= threshold * ratio.std()
    region = np.array([x[3] for x in lines])
    mass = np.bincount(region, np.where(content, size, 0))
    mass[0] = 0
    if mass.max() > 0:
        beside = np.isin(np.arange(len(mass)), list(page.beside))
        keep = np.isin(region, np.flatnonzero((mass > 0) & (~beside | (mass * 2 >= mass.max()))))
    else:
        linked = np.array([x[2] for x in lines]) > 0.5 * size
        core = np.flatnonzero(content & ~linked)
        keep = np.zeros(len(lines), bool)
        if len(core):
            keep[core[0]:core[-1] + 1] = True
            block = np.array([x[4] for x in lines])
            keep = (keep | np.isin(block, block[core])) & ~linked
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extracted(html: Column, sigma: float = SIGMA, threshold: float = THRESHOLD) -> Column:
    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, sigma, threshold) for p in pages], dtype=object)

    return udf(html)


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    rows = pages.select("page_id", "url", extracted(F.col(html)).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
