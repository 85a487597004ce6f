"""Main text of web pages by text-to-tag ratios over streamed parser events.

The standard library's parser streams events; text between block-level tags is
a line. Each line has a text-to-tag ratio; elements, roles, ids and classes
that mark the article raise it, those of menus, headers, footers, sidebars,
notices, adverts, forms and comments make it nothing. The ratios are smoothed
with a Gaussian, and lines above a share of their spread form content
clusters. The smallest container that holds nearly all text of the clusters is
the content region, whose lines are the text, short ones too; a title next to
it, and lines as dense as its own, belong to it. Clusters that only the
whole page holds grow to the lines between and next to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, records, sole

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("applet audio button canvas datalist dialog embed footer form frame frameset head iframe input label map menu meter nav noembed noframes noscript object option progress script search select style svg template textarea title video".split())
REPEATED = frozenset("li dd dt tr td th option".split())
CLOSES_P = BLOCK - {"html", "body", "title", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
# Words of id, class and role that mark what is no article.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline-share comment comments complementary consent contentinfo cookie cookies copyright disqus dialog disclaimer donate footer footnav gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar tracking widget".split()
)
MAIN_WORDS = frozenset("article-body article-content entry-content main-content post-content story-body articlebody".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: Spread of the Gaussian in lines, and the share of the ratios' spread that content exceeds.
SIGMA = 1.0
THRESHOLD = 0.5
#: Elements that can be a content region, and the share of the clusters' text that it holds.
CONTAINERS = frozenset("article main section div td".split())
SHARE = 0.9
#: What a mark of the article raises a line's ratio by.
PRIOR = 4.0


_NOTHING, _LOOSE, _FIRM = 0, 1, 2


def _marks(tag: str, attrs: dict[str, str | None], in_main: bool) -> tuple[int, bool]:
    """How firmly an element is marked as no content; whether as the main part.

    Loosely: by a part of a longer name, as in `has-sidebar`; a main part inside is content nevertheless.
    """
    if tag in SILENT or tag == "aside":
        return _FIRM, False
    if tag == "header":
        return (_NOTHING if in_main else _FIRM), False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return _FIRM, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
        return _FIRM, False
    role = (attrs.get("role") or "").lower()
    if role in ROLES:
        return _FIRM, False
    if tag in ("article", "main") or role in ("main", "article"):
        return _NOTHING, True
    names = f"{attrs.get('id') or ''} {attrs.get('class') or ''} {attrs.get('itemprop') or ''}".lower()
    if tag not in ("html", "body") and names.strip():
        whole = set(names.split())
        if whole & MAIN_WORDS:
            return _NOTHING, True
        if whole & BOILER_WORDS:
            return _FIRM, False
        if set(re.split(r"[^a-z0-9]+", names)) & BOILER_WORDS:
            return _LOOSE, False
    return _NOTHING, False


class _Line:
    """A line of text: number of tags before it, whether it is boilerplate, in the main part, mostly links, a title; its container."""

    __slots__ = ("text", "tags", "silent", "main", "menu", "title", "container")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values):
            setattr(self, name, value)


class _Lines(HTMLParser):
    """Collects lines and the containers around them. Each event takes constant time but for what it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        # tag, how silent, whether that began inside the main part, whether main, container, place of the nearest block element
        self.stack: list[tuple[str, int, bool, bool, int, int]] = []
        self.open: Counter[str] = Counter()
        self.parents = [0]  # of containers, in the order of their start tags; 0 is the page
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, silent, inner, main, container, block = self.stack[-1] if self.stack else ("", _NOTHING, False, False, 0, -1)
            title = block >= 0 and self.stack[block][0] == "h1"
            # The main part's own boilerplate is never content; what surrounds it may be silent though it is the article.
            how = _NOTHING if not silent else _FIRM if silent == _FIRM and (inner or not main) else _LOOSE
            self.lines.append(_Line(text, self.tags, how, main, self.links > 1 and 2 * self.linked > len(text), title, container))
            self.tags = 0
        self.text = []
        self.linked = self.links = 0

    def _pop(self, at: int) -> None:
        gone = self.stack[at:]
        if any(x[0] in BLOCK or x[1] for x in gone):
            self.flush()
        self.open.subtract(x[0] for x in gone)
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and (tag in CLOSES_P or tag in REPEATED):
            at = self.stack[-1][5]  # what HTML closes by itself is the nearest block element
            name = self.stack[at][0] if at >= 0 else ""
            if name == "p" and tag in CLOSES_P or name == tag and tag in REPEATED:
                self._pop(at)
        _, silent, inner, main, container, block = self.stack[-1] if self.stack else ("", _NOTHING, False, False, 0, -1)
        own, own_main = (_NOTHING, False) if silent == _FIRM and inner else _marks(tag, dict(attrs), main)
        if tag in BLOCK or own:
            self.flush()
        self.tags += 1
        self.links += tag == "a"
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if own_main and not main:
            main = True
            silent = _NOTHING if silent == _LOOSE else silent
        elif own > silent or own and main and not inner:
            silent, inner = max(own, silent), main
        if tag in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        if tag in BLOCK:
            block = len(self.stack)
        self.stack.append((tag, silent, inner, main, container, block))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("path", "circle", "rect", "use", "line", "polygon", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._pop(at)
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.stack and self.stack[-1][0] == "a":
            self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights at the ends sum to one as well."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / total


def clusters(lengths: np.ndarray, tags: np.ndarray, prior: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Which lines' smoothed ratio is above a share of the spread; and the ratios. prior: 0 for boilerplate."""
    ratios = prior * lengths / np.maximum(1, tags)
    level = smooth(ratios, sigma)
    return (level > threshold * level.std()) & (prior > 0), ratios


def region(container: np.ndarray, weight: np.ndarray, parents: list[int], share: float = SHARE) -> tuple[int, int]:
    """First and last number of the smallest container that holds a share of all weight; 0 is the page."""
    sums = np.bincount(container, weight, len(parents)).tolist()
    last = list(range(len(parents)))
    for k in range(len(parents) - 1, 0, -1):  # containers come after what they are in
        sums[parents[k]] += sums[k]
        last[parents[k]] = max(last[parents[k]], last[k])
    own = max((k for k in range(len(parents)) if sums[k] >= share * sums[0]), default=0)
    return own, last[own]


def extract(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text: blocks in page order, one line each; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    column = lambda name, kind=None: np.array([getattr(x, name) for x in lines], kind)
    how, main, menu, container = column("silent"), column("main", bool), column("menu", bool), column("container")
    silent = how > _NOTHING
    if silent.all():  # the article itself stands in what is marked as boilerplate
        silent = how > _LOOSE
    plain = ~silent & (~menu | main)
    if not plain.any():
        plain = ~silent
    if not plain.any():
        return ""
    lengths = np.array([len(x.text) for x in lines], float)
    prior = np.where(plain, np.where(main, PRIOR, 1.0), 0.0)
    content, ratios = clusters(lengths, column("tags", float), prior, sigma, threshold)
    if not content.any():
        content = plain
    first, last = region(container, np.where(content, lengths * prior, 0), parser.parents)
    if first:
        chosen = plain & (container >= first) & (container <= last)
        strong = (ratios >= np.median(ratios[chosen])) | column("title", bool)
    else:
        chosen = content.copy()
        strong = plain
    at = np.flatnonzero(chosen)
    low, high = int(at[0]), int(at[-1])
    if not first:
        chosen[low : high + 1] |= plain[low : high + 1]
    while low and plain[low - 1] and strong[low - 1]:
        low -= 1
        chosen[low] = True
    while high + 1 < len(lines) and plain[high + 1] and strong[high + 1]:
        high += 1
        chosen[high] = True
    return "\n".join(lines[i].text for i in np.flatnonzero(chosen))


def _run(sigma: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("html", int)
        for whole in batches:
            for batch in blocks(whole, "html"):
                texts = [extract(None if h is None else h.decode("utf-8", "replace"), sigma, threshold) for h in batch.column("html").to_pylist()]
                yield records([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty html give an empty text; broken or hostile markup is read
    as far as the parser gets, in linear time, never an error. Null ids and urls stay; equal rows are
    rows. An empty table gives no rows. Other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), as_bytes("html").alias("html"))
    return own.mapInArrow(_run(sigma, threshold), "page_id bigint, url string, text string, n_chars bigint")
