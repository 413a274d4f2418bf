"""HTML extraction: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

Events of the standard library's parser stream into lines: a line is the text between two
block boundaries, with the number of tags it holds and the element it stands in.  The
ratios of text to tags are smoothed with a Gaussian over neighbouring lines, and lines at
or over the boundary of two clusters are content; ratios that do not fall apart into two
clusters (``APART``) are all content.

Content lines choose the region.  From the page's root the choice goes down into an element
as long as no line that is content by its own ratio stays outside of it; into an ``article``
or ``main`` already if it has half of the content there or the page's heading, and of several
articles into all that have content by their own ratio and the first with a heading.  So a page needs no article: the ratios find the element that
has the text.  All lines of the region belong to the text, short ones too, and so does the
first heading beside it.

Left out wherever they stand are menus, page headers and footers, sidebars, notices,
adverts, forms and comments, by element, role or class.  A class that speaks of the page's
layout (``right-sidebar`` around everything) hides nothing if there is no text but in it.

End tags may be missing: a head ends at the first tag or text that cannot be in it, and a
menu, sidebar, form or footer outside of an article hides lines only if its end tag comes.

Defined results: a null or empty page has an empty text; a page cut off anywhere gives the
text up to the cut; white space is what str.split takes as such; entities are decoded;
repeated pages repeat; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import ship

# Names of elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINER = frozenset(
    "article aside body blockquote dd details div dl dt fieldset figure footer form header html main nav ol section table tbody td th thead tr ul".split()
)
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map math menu nav noscript object option script select style svg template textarea title video".split()
)
ROOTS = frozenset(("article", "main"))
SECTIONS = frozenset("article body div html main section table tbody td tr".split())  # what the choice of the region goes into
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
LEFT_OPEN = frozenset("aside footer form menu nav".split())  # outside of an article they hold only what their end tag closes
CELL, ROW = (("table", "tr"), ("td", "th")), (("table",), ("td", "th", "tr"))
ENDS = {"td": CELL, "th": CELL, "tr": ROW, "tbody": (("table",), ("td", "th", "tr", "tbody", "thead")), "dd": (("dl",), ("dd", "dt")), "dt": (("dl",), ("dd", "dt"))}
PAGE = LEFT_OPEN | {"html", "body"}
# Words of class names.  What the first name is never text; the second may be said of a page's layout, too.
FOREIGN = frozenset(
    "ad ads advert advertisement advertising adverts adslot comment comments commentlist consent cookie cookies disqus gdpr replies respond sponsor sponsored subscribe newsletter promo promotion promoted".split()
)
LAYOUT = frozenset(
    "alert banner breadcrumb breadcrumbs footer menu modal nav navbar navigation notice overlay pager pagination popup related share sharing sidebar skip social toolbar topbar widget widgets".split()
)
PAGE_HEADER = frozenset(("header", "masthead"))  # not in an article, which may have its own
DENIED = frozenset("no non not without free has with is enabled disabled hide hidden collapsed open off on".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
CUT = re.compile(r"<(?:[A-Za-z/!?][^<>]*)?\Z")
CLEAN, SOFT, HARD = range(3)
SIGMA = 1.5
APART = 3.0
NEARLY = 0.5
MAJORITY = 0.5
SOFT_SHARE = 0.2


class Line(NamedTuple):
    text: str
    tags: int
    node: int
    level: int
    heading: int
    linked: bool
    inside: bool


def noise_of(attrs, top: bool) -> int:
    """CLEAN, SOFT or HARD by an element's classes, id, role and state; ``top``: it stands in no article."""
    worst = CLEAN
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return HARD
        if name == "role" and value in NOISE_ROLES:
            worst = max(worst, SOFT)
        if name in ("class", "id") and value:
            for token in value.split():
                parts = {p.lower() for p in PARTS.findall(token)}
                if parts & DENIED:
                    continue
                if parts & FOREIGN:
                    return HARD
                if parts & LAYOUT or (top and parts & PAGE_HEADER):
                    worst = SOFT
    return worst


class Lines(HTMLParser):
    """Collects the lines of a page and the tree of the elements they stand in; an element is its number in the order of starts, 0 the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.begin()

    def begin(self):
        self.reset()
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = self.plain = 0  # characters of the line in and out of links
        self.links = 0
        self.heading = 0
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, number, in an article or main, level
        self.open: Counter[str] = Counter()  # tags on the stack
        self.names, self.parents = ["html"], [0]
        self.marks: dict[int, int] = {}  # lines before an element of LEFT_OPEN

    def close_head(self):
        """Ends a head that has no end tag, with all that is open in it."""
        if self.open["head"]:
            self.flush_line()
            self.end_from(next(i for i, (tag, *_) in enumerate(self.stack) if tag == "head"))

    def end_from(self, i: int):
        self.open.subtract(tag for tag, *_ in self.stack[i:])
        del self.stack[i:]

    def end_before(self, tag: str):
        """Ends a cell, row or list entry that the next one ends."""
        within, ended = ENDS[tag]
        i = len(self.stack) - 1
        while any(self.open[t] for t in ended) and self.stack[i][0] not in within:
            if self.stack[i][0] in ended:
                self.flush_line()
                self.end_from(i)
            i -= 1

    def flush_line(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, number, inside, level = self.stack[-1] if self.stack else ("", 0, False, CLEAN)
                if level < HARD:
                    self.lines.append(Line(text, self.tags, number, level, self.heading, self.linked > 0 and not self.plain, inside))
                self.tags = 0
            self.parts = []
            self.linked = self.plain = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self.close_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in ENDS:
            self.end_before(tag)
        known = tag in CONTAINER or tag in NEVER
        _, parent, inside, level = self.stack[-1] if self.stack else ("", 0, False, CLEAN)
        if not known and tag in INLINE:
            self.links += tag == "a"
            if not attrs or not noise_of(attrs, not inside):
                return
            known = tag not in VOID
        self.flush_line()
        if tag in HEADINGS:
            self.heading = int(tag[1])
        if not known or tag in VOID:
            return
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(parent)
        own = noise_of(attrs, not inside)
        if tag in ROOTS:
            # An element left open before it does not swallow the article.
            if level == HARD and not inside and self.stack and self.stack[-1][0] in NEVER:
                level = CLEAN
            level = max(level, HARD if own == HARD else CLEAN)
            inside = True
        elif tag in ("html", "body"):
            pass
        elif tag in LEFT_OPEN and not inside and level < HARD:
            self.marks[number] = len(self.lines)
            level = max(level, own)
        elif tag in NEVER or (tag == "header" and not inside):
            level = HARD
        else:
            level = max(level, own)
        self.stack.append((tag, number, inside, level))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in INLINE and not self.open[tag]:
            self.links = max(0, self.links - (tag == "a"))
            return
        self.flush_line()
        if tag in HEADINGS:
            self.heading = 0
        if self.open[tag]:
            i = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
            mark = self.marks.get(self.stack[i][1])
            if mark is not None:
                within = self.lines[mark:]
                self.lines[mark:] = kept = [x for x in within if x.inside]
                self.tags += sum(x.tags for x in within) - sum(x.tags for x in kept)
            self.end_from(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.close_head()
        if not (self.stack and self.stack[-1][3] == HARD):
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())
            else:
                self.plain += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """``<![...>`` has no meaning in HTML: a comment, whatever is in it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    @staticmethod
    def finished(html: str) -> str:
        """Without a comment or tag that the page's end cuts off."""
        at = html.rfind("<!--")
        if at >= 0 and html.find("-->", at) < 0:
            html = html[:at]
        return CUT.sub("", html)

    def read(self, html: str) -> list[Line]:
        self.begin()
        self.feed(self.finished(html))
        self.close()
        self.flush_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean over neighbouring lines."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def two_means(values: list[float]) -> tuple[float, float]:
    """Means of two clusters, begun at the least and the largest value."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        means = (sum(under) / len(under) if under else low, sum(over) / len(over) if over else high)
        if means == (low, high):
            break
        low, high = means
    return low, high


def content_lines(ratios: list[float]) -> list[int]:
    """Threshold clustering of the smoothed ratios: 0 for other lines, 1 for content by the lines around, 2 for content by its own ratio too."""
    if not ratios:
        return []
    low, high = two_means(ratios)
    if high < APART * low:
        return [2] * len(ratios)
    smooth = smoothed(ratios)
    cut, least = sum(two_means(smooth)) / 2, (low + high) / 2
    return [2 if r >= least and v >= NEARLY * cut else int(v >= cut) for v, r in zip(smooth, ratios)]


def chosen_lines(parser: Lines, lines: list[Line], content: list[int]) -> list[Line]:
    """The lines of the region that the content lines choose, in page order."""
    names, parents = parser.names, parser.parents
    mass, heading, children = [0] * len(names), [0] * len(names), {}
    own, loose = [0] * len(names), [0] * len(names)  # lines of content by their own ratio; lines of content that stand in the element itself
    for line, c in zip(lines, content):
        mass[line.node] += len(line.text) * (c > 0)
        own[line.node] += c == 2
        loose[line.node] += c > 0 and not line.linked
        heading[line.node] += line.heading == 1
    for node in range(len(names) - 1, 0, -1):
        mass[parents[node]] += mass[node]
        own[parents[node]] += own[node]
        heading[parents[node]] += heading[node]
        children.setdefault(parents[node], []).append(node)
    last = list(range(len(names)))  # the last element below each
    for node in range(len(names) - 1, 0, -1):
        last[parents[node]] = max(last[parents[node]], last[node])
    every = []  # articles in no other, in page order
    for node in range(1, len(names)):
        if names[node] == "article" and (not every or node > last[every[-1]]):
            every.append(node)
    regions, title = [0], None
    while len(regions) == 1:
        here = regions[0]
        if names[here] == "article":
            break
        inner = [n for n in children.get(here, ()) if mass[n] and (names[n] in SECTIONS or names[n] in LEFT_OPEN)]
        if not inner:
            break
        articles = every[bisect_left(every, here) : bisect_right(every, last[here])]
        held = [n for n in articles if own[n]]
        first = [n for n in articles if heading[n]][:1]
        if first or (held and sum(mass[n] for n in held) >= MAJORITY * mass[here]):
            down = sorted({*held, *first})
        else:
            best = max(inner, key=mass.__getitem__)
            if mass[best] < MAJORITY * mass[here] or (names[best] != "main" and (own[best] < own[here] or loose[here])):
                break
            down = [best]
        if heading[here] and not any(heading[n] for n in down) and title is None:
            title = next((i for i, x in enumerate(lines) if x.heading == 1 and x.node == here), None)
        regions = down
    inside, chosen = [False] * len(names), set(regions)
    for node in range(len(names)):
        inside[node] = node in chosen or (node > 0 and inside[parents[node]])
    # In the page itself, lines that are nothing but links are a menu.
    page = names[regions[0]] in PAGE
    return [x for i, (x, c) in enumerate(zip(lines, content)) if i == title or (inside[x.node] and (c == 2 or not (page and x.linked)))]


def main_text(parser: Lines, html: str | None) -> str:
    lines = parser.read(html) if html else []
    clean = [x for x in lines if x.level == CLEAN]
    if sum(len(x.text) for x in clean) < SOFT_SHARE * sum(len(x.text) for x in lines) and not any(x.inside for x in clean):
        clean = lines  # what looked like a sidebar or menu is the page's layout
    content = content_lines([len(x.text) / (1 + x.tags) for x in clean])
    return "\n\n".join(x.text for x in chosen_lines(parser, clean, content))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parser = Lines()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(parser, html.as_py()) for html in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
