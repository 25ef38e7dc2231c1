"""Main text of web pages: parser events, text-to-tag ratios by line, smoothing and threshold clustering.

The standard library's parser streams a page's events. Each block (paragraph, heading, list item,
cell, ...) is a line with its text, its number of tags and the element it belongs to. Ratios of text
to tags are smoothed by a Gaussian along the page and split in two clusters by a threshold; lines of
the upper cluster are content. All ``article`` and ``main`` elements are taken with all their lines,
so that short paragraphs and short articles stay; a page without such elements gives all lines of its
content root, the smallest part of the page that holds all content and is no list, table, quotation or
section of something larger. What a page marks as menu, header, footer, sidebar, notice, advert, form,
comment section, script or style is no line at all.

Defined results: null and empty pages, and pages without text in a block, give an empty text; broken
markup is read the way browsers do (a block start ends an open paragraph, stray end tags are
ignored, missing ones are supplied); repeated rows get equal texts; an empty table gives no rows;
columns other than the page's id, url and html are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketspark.llm.tokens import slices

#: Radius and deviation of the smoothing, in lines.
RADIUS, DEVIATION = 3, 1.5
#: Rounds of the two-cluster threshold.
ROUNDS = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never article text.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form menu button select textarea input iframe svg math canvas object audio video dialog noframes title".split()
)
#: An open element of the second kind ends when one of the first starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Containers that can be a page's content root; the others are parts of a text.
ROOTS = frozenset("body div html".split())
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure form html main nav ol section table tbody td th thead tr ul".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist disqus reply replies respond cookie cookies consent notice alert popup modal newsletter subscribe subscription share sharing "
    "social related recommended widget pagination pager login signup search toolbar masthead complementary contentinfo dialog form toc skip hidden".split()
)
#: These mark page headers; inside an article they are its own heading.
HEADER_MARKS = frozenset("header banner masthead".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Lines(HTMLParser):
    """Collects lines: text, number of tags, region (number of the article, or -1) and container."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # element, and whether it starts a dropped part
        self.counts: Counter[str] = Counter()  # open elements by name
        self.scopes: list[Counter[str]] = [Counter()]  # the same inside each open container
        self.scoped: list[int] = []  # places of the open containers
        self.dropping = 0
        self.inside: list[int] = []  # articles that are open
        self.articles = 0
        self.containers: list[int] = [0]
        self.parents: list[int] = [0]  # of each container; the first is the page
        self.kinds: list[str] = ["html"]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, int]] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.inside[0] if self.inside else -1, self.containers[-1]))
            self.tags = 0
        self.text = []

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or (tag == "header" and not self.inside):
            return True
        named = dict(attrs)
        if "hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style") or ""):
            return True
        if tag in ("html", "body"):
            return False
        words = set(re.split(r"[^a-z0-9]+", " ".join(named.get(k) or "" for k in ("class", "id", "role")).lower())) & (MARKS | HEADER_MARKS)
        return bool(words - HEADER_MARKS if self.inside else words)

    def pop(self) -> str:
        tag, dropped = self.open.pop()
        self.dropping -= dropped
        self.counts[tag] -= 1
        if tag in CONTAINERS:
            self.containers.pop()
            self.scopes.pop()
            self.scoped.pop()
        else:
            self.scopes[-1][tag] -= 1
        if tag in ("article", "main") and self.inside:
            self.inside.pop()
        return tag

    def end_implied(self, ends: set[str]) -> None:
        """Closes what a block start ends, up to the container it is in. Only walks where there is something to close."""
        while True:
            if any(self.scopes[-1][name] for name in ends):
                while self.pop() not in ends:
                    pass
            elif self.scoped and self.open[self.scoped[-1]][0] in ends:
                at = self.scoped[-1]
                while len(self.open) > at:
                    self.pop()
            else:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """An unknown marked section is a comment up to the next ``>``, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" or tag in VOID:
            if tag in BLOCK:
                self.end_line()
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.end_line()
            self.end_implied(CLOSES.get(tag, set()) | {"p"})
        if tag in ("article", "main") and not self.articles and self.dropping and not self.unwanted(tag, attrs):
            # the first article can't be part of a menu or an advert: their end tags are missing
            while self.dropping:
                self.pop()
        dropped = self.unwanted(tag, attrs)
        self.open.append((tag, dropped))
        self.dropping += dropped
        self.counts[tag] += 1
        if tag in CONTAINERS:
            self.scopes.append(Counter())
            self.scoped.append(len(self.open) - 1)
            self.parents.append(self.containers[-1])
            self.kinds.append(tag)
            self.containers.append(len(self.parents) - 1)
        else:
            self.scopes[-1][tag] += 1
        if tag in ("article", "main"):
            self.inside.append(self.articles)
            self.articles += not self.dropping

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if not self.counts[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if tag not in BLOCK and self.open[at][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean along the lines; the kernel's part beyond the page's ends doesn't count."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * DEVIATION**2))
    whole = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / whole


def threshold(values: np.ndarray) -> float:
    """Border between two clusters: half way between the means of what is above and below it."""
    border = float(values.mean())
    for _ in range(ROUNDS):
        above, below = values[values >= border], values[values < border]
        if not len(above) or not len(below):
            break
        new = float(above.mean() + below.mean()) / 2
        if new == border:
            break
        border = new
    return border


def content_root(parser: Lines, containers: set[int]) -> int:
    """Lowest common ancestor of ``containers``, or the one around it that can be a root. A parent's number is below its children's."""
    heap = [-c for c in containers]
    heapq.heapify(heap)
    while len(containers) > 1:
        last = -heapq.heappop(heap)
        containers.remove(last)
        if (parent := parser.parents[last]) not in containers:
            containers.add(parent)
            heapq.heappush(heap, -parent)
    root = next(iter(containers))
    while parser.kinds[root] not in ROOTS:
        root = parser.parents[root]
    return root


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    if any(region >= 0 for _, _, region, _ in lines):
        return "\n".join(text for text, _, region, _ in lines if region >= 0)
    ratios = smoothed(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    content = ratios >= threshold(ratios)
    root = content_root(parser, {c for (_, _, _, c), above in zip(lines, content, strict=True) if above})
    inside = [False] * len(parser.parents)
    inside[root] = True
    for c in range(root + 1, len(inside)):
        inside[c] = inside[parser.parents[c]]
    return "\n".join(text for text, _, _, c in lines if inside[c])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
