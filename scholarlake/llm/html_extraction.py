"""Operator 7: main text of web pages from tag ratios.

The standard library's parser streams a page's events into lines: blocks of text with
the number of tags met while each was filled. The text-to-tag ratio per line is smoothed
by a Gaussian; lines above a threshold (a part of the smoothed ratios' standard
deviation) form the content cluster. Text in links does not count, so lists of links have
low ratios, and boilerplate elements keep their place with a ratio of 0.

The cluster votes, by its characters, for the content region: the smallest element that
holds nearly all of the cluster, which an article or main element inside may narrow down
if it holds most of it. All blocks of the region are returned in page order, but for those
in boilerplate elements (menus, footers, asides, forms, adverts, comments ...) and for
lines mostly of links that the cluster leaves out (headings stay). A class or id name alone makes no
boilerplate of an element that holds the page's largest article or main, or most of the
cluster; this is decided after parsing.

Lines know their element and elements their parent, so the work is linear in the page.

Defined results: null, empty or tag-less pages without text give an empty text; text
outside any element counts; unclosed and stray tags never fail; repeated rows are
extracted each; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold the article's text.
BOILERPLATE = frozenset(
    "aside button dialog footer form head iframe input label math menu nav noscript object option script select style svg template textarea title".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related "
    "replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
REGIONS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    """By tag, role or being hidden, whatever the element holds."""
    if tag in BOILERPLATE:
        return True
    if tag == "header":
        return not in_region
    if tag in ("html", "body", "article", "main") and not attrs:
        return False
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """By a word of its class or id."""
    names = (value or "" for name, value in attrs if name in ("class", "id") and tag not in ("html", "body"))
    return any(not MARKS.isdisjoint(w.lower() for w in WORD.findall(value)) for value in names)


class Lines(HTMLParser):
    """Events to lines: (text, tags, characters in links, element). Elements are numbered in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.bad: list[bool] = []  # boilerplate whatever the marks
        self.marked: list[bool] = []
        self.edge: list[bool] = []  # ends a block where it starts and ends
        self.open: list[int] = []
        self.blocks: list[int] = []  # places in ``open`` of block elements
        self.count: Counter = Counter()  # open elements by tag
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link = False

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.open[-1] if self.open else -1))
            self.tags = 0
        self.parts, self.linked = [], 0

    def cut(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        if any(self.edge[e] for e in self.open[depth:]):
            self.flush()
        self.count.subtract([self.tag[e] for e in self.open[depth:]])
        del self.open[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self.link = False
            above = self.tag[self.open[self.blocks[-1]]] if self.blocks else ""
            if above == "p" or above == tag and tag in CLOSED_BY_SELF:
                self.cut(self.blocks[-1])
        elif tag == "a":
            self.link = True
        within = bool(self.open) and self.bad[self.open[-1]]
        bad = within or is_boilerplate(tag, attrs, self.count["article"] + self.count["main"] > 0)
        marked = not bad and is_marked(tag, attrs)
        edge = tag in BLOCK or bad != within or marked
        if edge:
            self.flush()
        if tag not in VOID:
            self.parent.append(self.open[-1] if self.open else -1)
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag))
            self.count[tag] += 1
            for column, value in ((self.tag, tag), (self.bad, bad), (self.marked, marked), (self.edge, edge)):
                column.append(value)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.tag[self.open[-1]] == tag:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" or tag in BLOCK:
            self.link = False
        if self.count[tag] > 0:
            at = len(self.open) - 1
            while self.tag[self.open[at]] != tag:
                at -= 1
            self.cut(at)

    def handle_data(self, data):
        self.parts.append(data)
        if self.link:
            self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-np.square(np.arange(-radius, radius + 1)) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), "valid")


def cluster(page: Lines, bad: list[bool], threshold: float) -> list[int]:
    """The content cluster's lines."""
    # boilerplate keeps its place in the sequence, as lines without text
    ratios = smooth(np.array([0.0 if b else (len(text) - linked) / max(tags, 1) for (text, tags, linked, _), b in zip(page.lines, bad, strict=True)]))
    bar = threshold * ratios.std()
    usable = [i for i, b in enumerate(bad) if not b]
    return [i for i in usable if ratios[i] >= bar] or usable


def votes_of(page: Lines, content: list[int]) -> list[int]:
    """The cluster's characters in each element."""
    votes = [0] * len(page.tag)
    for i in content:
        text, _, _, e = page.lines[i]
        if e >= 0:
            votes[e] += len(text)
    for e in range(len(votes) - 1, -1, -1):  # children come after their parents
        if page.parent[e] >= 0:
            votes[page.parent[e]] += votes[e]
    return votes


def inherited(page: Lines, own: list[bool]) -> list[bool]:
    """Whether an element or one around it has the property."""
    out = list(own)
    for e, parent in enumerate(page.parent):
        out[e] = out[e] or parent >= 0 and out[parent]
    return out


def dismissed(page: Lines, threshold: float) -> list[bool]:
    """By element: is it boilerplate by its own mark? Not one that holds the largest article or main, or most of the cluster."""
    if not any(page.marked):
        return page.marked
    fixed = [e >= 0 and page.bad[e] for *_, e in page.lines]
    content = cluster(page, fixed, threshold) if not all(fixed) else []
    votes, n = votes_of(page, content), len(page.tag)
    total = sum(len(page.lines[i][0]) for i in content)
    # votes of the regions without a mark of their own
    region = [votes[e] if page.tag[e] in REGIONS and not page.bad[e] and not page.marked[e] else 0 for e in range(n)]
    inside, last = [0] * n, list(range(n))
    for e in range(n - 1, -1, -1):
        p = page.parent[e]
        if p >= 0:
            inside[p], last[p] = max(inside[p], inside[e], region[e]), max(last[p], last[e])
    after, before = [0] * (n + 1), [0] * (n + 1)  # the largest region that starts at e or later; that ended before e
    for e in range(n - 1, -1, -1):
        after[e] = max(after[e + 1], region[e])
    for e in range(n):
        before[last[e] + 1] = max(before[last[e] + 1], region[e])
    for e in range(n):
        before[e + 1] = max(before[e + 1], before[e])

    def keeps(e: int) -> bool:
        outside = max(after[last[e] + 1], before[e])
        return inside[e] >= max(outside, 1) or not outside and 2 * votes[e] > total

    return [page.marked[e] and not keeps(e) for e in range(n)]


COMMENT_END = re.compile(r"--\s*>")


def parsed(html: str) -> Lines:
    """The page's events as lines. What no ``>`` or end of a comment follows is text, and is not searched for one again and again."""
    page, end, last = Lines(), html.rfind(">") + 1, 0
    if "<!--" in html:
        for last_end in COMMENT_END.finditer(html):
            last = last_end.end()
    page.feed(html[:last])
    page.feed(html[last:end].replace("<!--", "&lt;!--"))
    page.close()
    if end < len(html):
        page.handle_data(html[end:] if page.cdata_elem else unescape(html[end:]))
    page.flush()
    return page


def main_text(html: str | None, threshold: float = 0.5) -> str:
    if not html:
        return ""
    page = parsed(html)
    boilerplate = inherited(page, [b or d for b, d in zip(page.bad, dismissed(page, threshold), strict=True)])
    bad = [e >= 0 and boilerplate[e] for *_, e in page.lines]
    if all(bad):
        return ""
    content = cluster(page, bad, threshold)
    votes, total = votes_of(page, content), sum(len(page.lines[i][0]) for i in content)
    best = max((e for e, v in enumerate(votes) if v >= 0.9 * total and v), default=None)
    regions = [e for e, v in enumerate(votes) if page.tag[e] in REGIONS and 2 * v >= total and v]
    if regions:
        best = max(regions, key=lambda e: (votes[e], e))
    held, headings = inherited(page, [e == best for e in range(len(votes))]), inherited(page, [t in HEADINGS for t in page.tag])
    kept = set(content)
    return "\n".join(
        text for i, (text, _, linked, e) in enumerate(page.lines)
        if not bad[i] and (best is None or e >= 0 and held[e]) and (i in kept or 2 * linked <= len(text) or e >= 0 and headings[e])
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of whole pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))
