"""Main text of web pages.

The standard library's parser streams events; text gathers into lines, one for each block
of the page, with the number of tags met on the way.  Each line's text-to-tag ratio is
smoothed along the page by a Gaussian, and a threshold between the two clusters of the
smoothed values marks content lines.

Furniture.  Elements that are furniture by tag, role or visibility are never read.  A class
or id that names furniture is only a prior: the element goes unless it holds most of the
content lines and little content is left without it, as a page's wrapper does; reader
comments always go.  Boxes with little content, most of it link text, go as well.  The region is found by walking down from the root as long as one
child holds all content lines; the first ``article`` or ``main`` on the way is the region.
All other lines of the region count as text, short ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table

SIGMA = 1.5
CONTRAST = 3
LEFT = 0.2  # share of the content lines that counts as little
_REACH = 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
_HOLDERS = frozenset("article blockquote body dd div dl fieldset figure html li main ol section table tbody td th tr ul".split())
_KEPT = frozenset("article body h1 h2 h3 h4 h5 h6 html main".split())
_LIKE = frozenset("li td th tr dd dt option".split())
_LISTS = frozenset("table tbody tr ul ol dl li dd".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pagination popup promo promos promotion rail recommended related share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())
#: Parts that make a name a state or a layout, not a kind; whole names of text itself.
_STATES = frozenset("has with without no not is are enabled disabled open opened closed on off active allowed layout page wrap wrapper".split())
_TEXT = frozenset("article body content entry main post story text".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

NAMED, COMMENTS = 1, 2


def name_kind(value: str, in_article: bool) -> int:
    """What a class or id says of its element: 0 nothing, else ``NAMED`` or ``COMMENTS``."""
    kind = 0
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if not parts or not _STATES.isdisjoint(parts):
            continue
        ends = {parts[0], parts[-1]}
        if not _COMMENTS.isdisjoint(ends):
            kind = COMMENTS
        elif not _WORDS.isdisjoint(ends) and not (in_article and ends & _WORDS == {"header"}):
            kind = max(kind, NAMED)
    return kind


class _Lines(HTMLParser):
    """Gathers lines (pieces, tags, node) of the parts that can be text; a piece is (node,
    characters, whether in a link), a node (tag, parent, kind) a holder or a named element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[int, str, bool]], int, int]] = []
        self.nodes: list[tuple[str, int, int]] = [("", -1, 0)]
        self.open: list[tuple[str, int, bool]] = []  # tag, node around it, whether it is furniture
        self.blocks: list[int] = []  # places of the open elements that are not inline
        self.count: Counter[str] = Counter()  # open elements by tag
        self.node, self.hidden, self.tags = 0, 0, 0
        self.line_node = 0
        self.text: list[tuple[int, str, bool]] = []

    def end_line(self) -> None:
        if any(not x.isspace() for _, x, _ in self.text):
            self.lines.append((self.text, self.tags, self.line_node))
            self.tags = 0
        self.text, self.line_node = [], self.node

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, self.node, furniture = self.open.pop()
            self.hidden -= furniture
            self.count[tag] -= 1
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        inline = tag in _INLINE
        if not inline:
            self.end_line()
            self.close_implied(tag)
        if tag in _VOID:
            return
        in_article = self.count["article"] + self.count["main"] > 0
        furniture, kind = tag in _FURNITURE or (tag == "header" and not in_article), 0
        if not furniture and attrs and tag not in _KEPT:
            for k, v in attrs:
                if k == "hidden" or (v and ((k == "role" and v.lower() in _ROLES) or (k == "aria-hidden" and v == "true") or (k == "style" and _UNSEEN.search(v.lower())))):
                    furniture = True
                elif v and k in ("class", "id"):
                    kind = max(kind, name_kind(v, in_article))
            if kind == NAMED and any(k in ("class", "id") and v and not _TEXT.isdisjoint(v.lower().split()) for k, v in attrs):
                kind = 0
        self.open.append((tag, self.node, furniture))
        self.count[tag] += 1
        self.hidden += furniture
        if tag in _HOLDERS or kind:
            self.nodes.append((tag, self.node, kind))
            self.node = len(self.nodes) - 1
        if not inline:
            self.blocks.append(len(self.open) - 1)
            self.line_node = self.node

    def close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and rows end their like."""
        if not self.count["p"] and not (tag in _LIKE and self.count[tag]):
            return
        for k in reversed(self.blocks):
            seen = self.open[k][0]
            if seen == "p" or (seen == tag and tag in _LIKE):
                self.pop_to(k)
                break
            if seen in _HOLDERS or seen in _FURNITURE:
                break
        self.line_node = self.node

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        inline = tag in _INLINE
        if not inline:
            self.end_line()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            seen = self.open[k][0]
            if seen == tag:
                self.pop_to(k)
                break
            if inline and seen in _HOLDERS:
                break
        if not inline:
            self.line_node = self.node

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append((self.node, data, self.count["a"] > 0))

    def finish(self) -> None:
        """End of page: a comment or tag that is still open there is no text."""
        if self.cdata_elem or (self.rawdata.startswith("<") and re.match(r"<(?:/?[a-zA-Z]|!|\?)", self.rawdata)):
            self.rawdata = ""
        self.close()
        self.end_line()


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the upper of two clusters of the smoothed ratios; all, if the clusters
    differ by less than ``CONTRAST`` times."""
    kernel = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)
    n = len(ratios)
    smooth = np.convolve(ratios, kernel)[_REACH : _REACH + n] / np.convolve(np.ones(n), kernel)[_REACH : _REACH + n]
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        cut = (low + high) / 2
        up = smooth >= cut
        if up.all() or not up.any():
            break
        new = smooth[~up].mean(), smooth[up].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth >= ((low + high) / 2 if high > CONTRAST * low else 0)


def _up(own: list[float], parents: list[int]) -> list[float]:
    """Sums over subtrees; parents come before their children."""
    out = list(own)
    for k in range(len(out) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def furniture_nodes(nodes: list[tuple[str, int, int]], own: list[float]) -> list[bool]:
    """Which nodes lie in an element that its name makes furniture; ``own`` holds the characters
    of content lines in each node itself."""
    parents, weight = [p for _, p, _ in nodes], _up(own, [p for _, p, _ in nodes])
    free = list(own)  # in the subtree, but not below a named node
    for k in range(len(nodes) - 1, 0, -1):
        if not nodes[k][2]:
            free[parents[k]] += free[k]
    left, gone = free[0], [False] * len(nodes)
    for k in range(1, len(nodes)):
        kind = nodes[k][2]
        gone[k] = gone[parents[k]]
        if kind and not gone[k]:
            if kind == NAMED and weight[k] > weight[0] / 2 and left <= LEFT * weight[0]:
                left += free[k]
            else:
                gone[k] = True
    return gone


def main_text(html: str | None) -> str:
    """The article of a page; empty for null or empty html and for pages without text.  Should
    names leave nothing of a page with text, they do not count."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    if not parser.lines:
        return ""
    nodes, lines = parser.nodes, parser.lines
    sizes = np.array([len(" ".join("".join([x for _, x, _ in pieces]).split())) for pieces, _, _ in lines], np.float64)
    picked = content_lines(sizes / np.maximum(1, [tags for _, tags, _ in lines])).tolist()
    own = [0.0] * len(nodes)
    for (pieces, _, _), up in zip(lines, picked, strict=True):
        if up:
            for node, x, _ in pieces:
                own[node] += len(x)
    gone = furniture_nodes(nodes, own)
    return _region_text(nodes, lines, own, gone) or (_region_text(nodes, lines, own, [False] * len(nodes)) if any(gone) else "")


def _region_text(nodes: list[tuple[str, int, int]], lines: list, own: list[float], gone: list[bool]) -> str:
    parents = [p for _, p, _ in nodes]
    weight = _up([0.0 if g else w for w, g in zip(own, gone, strict=True)], parents)
    children: dict[int, list[int]] = {}
    for k in range(len(nodes) - 1, 0, -1):
        if weight[k] and weight[k] == weight[0]:  # whole characters: exact
            children.setdefault(parents[k], []).append(k)
    region = at = 0
    while nodes[region][0] not in ("article", "main") and at in children:
        at = children[at][0]
        region = region if nodes[at][0] in _LISTS else at
    chars, linked = [0.0] * len(nodes), [0.0] * len(nodes)
    for pieces, _, _ in lines:
        for node, x, link in pieces:
            n = len(x.strip())
            chars[node] += n
            linked[node] += n * link
    chars, linked = _up(chars, parents), _up(linked, parents)
    kept = [False] * len(nodes)
    kept[region] = True
    for k in range(region + 1, len(nodes)):
        box = nodes[k][0] in ("div", "section") and 2 * linked[k] > chars[k] and weight[k] <= LEFT * weight[0]
        kept[k] = kept[parents[k]] and not gone[k] and not box
    texts = (" ".join("".join([x for node, x, _ in pieces if kept[node]]).split()) for pieces, _, _ in lines)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty html give an empty text; repeated rows are extracted each; null ids and
    urls are carried; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
