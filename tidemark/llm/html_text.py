"""Main text of HTML pages from streaming parser events.

Parser events give lines, one for each block element. A line's text-to-tag ratio (0 in navigation,
notices and the like, lowered under names that may mean them) is smoothed by a Gaussian over its neighbours;
a two-cluster threshold on the smoothed ratios selects content lines. They select the region: the article
that holds most of them, else the smallest element around the longest that holds nearly all. Of the region
go lines in navigation and the like, and runs of lines that are all links and on average below the threshold; its
other lines stay, so that a short paragraph isn't lost for its low ratio.

Names: a class or id counts as navigation and the like only if all its words say so (`cookie-notice`; not `related-work`).
Words that also name chapters (`discussion`) count only outside an article, and there they lower the ratio.
Time is linear in the page, however deep or broken its markup: places of open tags are kept by tag, and an
element is a range of lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table, trimmed

SIGMA, RADIUS = 1.0, 2
#: The share of the content lines' characters that a region must hold.
REGION_SHARE = 0.8
#: What an element around it may add to a region, as a share of the region's text.
WIDEN = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul head".split()
)
_ENDS_P = _BLOCKS - {"button", "caption", "legend", "optgroup", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
_AWAY = frozenset("aside button dialog footer form head iframe menu nav noscript object option script select style svg template textarea title canvas audio video map".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: Words of a class or id: those that say what is left out, and those that may stand beside them.
_AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adbox banner banners sponsor sponsored sponsors promo promos promotion promotions "
    "breadcrumb breadcrumbs menu menus nav navbar navigation topbar toolbar footer masthead sidebar rail widget widgets recirc share sharing social cookie cookies consent gdpr ccpa "
    "newsletter subscribe subscription signup login paywall popup modal overlay comment comments commentlist disqus pagination pager skiplink noprint".split()
)
#: They are left out as a class of an element that is no section; as an id they name chapters.
_AWAY_CLASSES = frozenset("related recommended recommendations trending popular notice notices notification notifications alert disclaimer copyright follow replies hidden toc tags".split())
_BESIDE_WORDS = frozenset(
    "container wrapper wrap box block area section list item items bar main site page top bottom left right inner outer link links button buttons form panel content group row "
    "header head foot notice notices message thread reader readers user users reply replies respond post posts article articles story stories print only no sr skip to up sign in out "
    "social media network privacy policy text title heading global primary secondary mobile desktop sticky fixed unit slot space google dfp js id the and more by you may also like".split()
)
_MAYBE = re.compile(
    r"(?:^|[\s_-])(?:foot|side|aside|related|recommended|trending|popular|follow|notice|notices|notification|alert|disclaimer|copyright|legal|replies|reply|respond|discussion|responses|"
    r"search|toc|tags|hidden|(?:site|page|top|main)[_-]?header)(?:$|[\s_\d-])",
    re.IGNORECASE,
)
_WORDS = re.compile(r"[a-z]+")
#: What a name that may mean navigation leaves of a line's ratio; a line with more of its text in links is all links; so many in a row are no text.
LOWERED, ALL_LINKS, LINK_RUN = 0.3, 0.8, 3
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))
_PARTS = frozenset("section p ul ol li dl dd dt blockquote table tbody tr td figure".split())


class _Node:
    """An open element: away if left out, main if it may be the article, maybe if its name may mean navigation; block: what its lines belong to."""

    __slots__ = ("tag", "up", "away", "main", "maybe", "within", "block", "first", "last")

    def __init__(self, tag: str, up: _Node | None, away: bool, main: bool, maybe: bool, first: int):
        self.tag, self.up, self.away, self.main, self.maybe, self.first, self.last = tag, up, away, main, maybe, first, first
        self.within = main or up is not None and up.within
        self.block: _Node = self


class _Line:
    __slots__ = ("text", "tags", "links", "node", "away")

    def __init__(self, text: str, tags: int, links: int, node: _Node, away: bool):
        self.text, self.tags, self.links, self.node, self.away = text, tags, links, node, away

    def ratio(self) -> float:
        if self.away:
            return 0.0
        return max(0, len(self.text) - 2 * self.links) / max(1, self.tags) * (LOWERED if self.node.maybe else 1.0)


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = _Node("", None, False, False, False, 0)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of open tags
        self.mains: list[_Node] = []
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                node = self.node
                self.lines.append(_Line(text, self.tags, self.links, node, node.away and not (node.tag in _HEADINGS and self._title())))
            self.parts = []
            self.links = 0
        self.tags = 0

    def _title(self) -> bool:
        """Whether a heading stands in an article's own header and in nothing else that is left out."""
        at = self._last("header")
        header = self.open[at]
        return at > 0 and header.up is not None and not header.up.away and header.within and all(n.tag not in _AWAY for n in self.open[at + 1 : at + 8])

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of the tag; 0, the root's, if none is open."""
        at = self.places.get(tag)
        return at[-1] if at else 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _BLOCKS:
            self.flush()
            if tag in _ENDS_P:
                self._close("p", _AROUND_P)
            if tag == "li":
                self._close("li", ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr"):
                self._close(tag, ("table", "tr") if tag != "tr" else ("table",))
            elif tag in ("dt", "dd"):
                self._close("dt", ("dl",))
                self._close("dd", ("dl",))
            self.tags = 1
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        up = self.open[-1]
        away, main, maybe = up.away or tag in _AWAY or tag == "header", tag in _MAIN, up.maybe
        if attrs and tag not in ("html", "body"):
            found = dict(attrs)
            role = (found.get("role") or "").lower()
            main = main or role in _MAIN or (found.get("itemprop") or "").lower() == "articlebody"
            if not main and not away:
                away = role in _AWAY_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or _unseen(found.get("style"))
                if tag not in _HEADINGS:
                    away = away or _named_away(tag, found.get("class") or "", found.get("id") or "")
                    maybe = maybe or not up.within and bool(_MAYBE.search(f"{found.get('class') or ''} {found.get('id') or ''}"))
        block = tag in _BLOCKS or away != up.away or main or maybe != up.maybe
        if block and tag not in _BLOCKS:
            self.flush()
        node = _Node(tag, up, away, main, maybe and not main, len(self.lines))
        if not block:
            node.block = up.block
        if main:
            self.mains.append(node)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(node)
        self.node = node.block

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, limits: tuple) -> None:
        """Closes the innermost open element of the tag, unless one of the limits is open within it."""
        at = self._last(tag)
        if at and all(self._last(t) < at for t in limits):
            self._cut(at)

    def _cut(self, at: int) -> None:
        for n in self.open[at:]:
            n.last = len(self.lines)
            self.places[n.tag].pop()
        del self.open[at:]
        self.node = self.open[-1].block

    def handle_endtag(self, tag):
        self.tags += 1
        at = self._last(tag)
        if at:
            if any(n.block is n for n in self.open[at:]):
                self.flush()
            self._cut(at)

    def handle_data(self, data):
        if self.open[-1].tag in ("script", "style"):
            return
        self.parts.append(data)
        if self.places.get("a"):
            self.links += len(data)

    def finish(self) -> list[_Line]:
        self.close()
        self.flush()
        for n in self.open:
            n.last = len(self.lines)
        return self.lines


_AROUND_P = ("button", "table", "td", "th", "article", "section", "div", "main", "body", "form", "blockquote")


def _named_away(tag: str, classes: str, name: str) -> bool:
    """Whether a class or the id says, in all its words, that the element is left out."""
    for kind, tokens in (("class", classes.lower().split()), ("id", [name.lower()])):
        for token in tokens:
            words = _WORDS.findall(token)
            also = kind == "class" and tag not in ("section", "article")
            if words and any(w in _AWAY_WORDS or also and w in _AWAY_CLASSES for w in words) and all(w in _AWAY_WORDS or w in _AWAY_CLASSES or w in _BESIDE_WORDS for w in words):
                return True
    return False


def _unseen(style: str | None) -> bool:
    return bool(style) and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.IGNORECASE))


_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-RADIUS, RADIUS + 1):
            if 0 <= i + d < len(values):
                total += _KERNEL[d + RADIUS] * values[i + d]
                weight += _KERNEL[d + RADIUS]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters of the values: Lloyd's iterations from the least and the greatest."""
    lo, hi = min(values), max(values)
    for _ in range(20):
        cut = (lo + hi) / 2
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            break
        new = sum(low) / len(low), sum(high) / len(high)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _closed(html: str) -> str:
    """The page, with starts of markup that never ends as text: the parser looks for the end of each anew, to the end of the page."""
    for start, end in (("<!--", "-->"), ("<![", "]>"), ("<", ">")):
        at = html.rfind(end) + 1
        if html.find(start, at) >= 0:
            html = html[:at] + html[at:].replace(start, "&lt;" + start[1:])
    return html


def _widened(node: _Node, lines: list[_Line]) -> _Node:
    """The outermost element below the body that adds little to the node and no list of links; a section, list or table is always part of what it stands in."""
    text = list(accumulate((0 if line.away else len(line.text) for line in lines), initial=0))
    links = list(accumulate((0 if line.away else line.links for line in lines), initial=0))
    of = lambda sums, n: sums[n.last] - sums[n.first]
    while node.up is not None and node.up.tag not in ("body", "html", "") and not node.up.maybe:
        more = of(text, node.up) - of(text, node)
        if node.tag not in _PARTS and (more > WIDEN * of(text, node) or of(links, node.up) - of(links, node) > more / 2):
            break
        node = node.up
    return node


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_closed(html))
    lines = parser.finish()
    if all(line.away for line in lines):
        return ""
    ratios = smoothed([line.ratio() for line in lines])
    cut = min(threshold(ratios), max(ratios))
    content = [not line.away and r >= cut for line, r in zip(lines, ratios, strict=True)]
    if not any(content):
        content = [not line.away for line in lines]
    upto = list(accumulate((len(line.text) if c else 0 for line, c in zip(lines, content, strict=True)), initial=0))
    chars = lambda n: upto[n.last] - upto[n.first]
    total = upto[-1]
    region: _Node | None = None
    if mains := [n for n in parser.mains if chars(n)]:
        best = max([n for n in mains if n.tag != "main"] or mains, key=chars)
        region = best if chars(best) >= total * 0.5 or best.tag == "main" else max(mains, key=chars)
    if region is None or chars(region) < total * 0.3:
        region = parser.root
        node = max((line for line, c in zip(lines, content, strict=True) if c), key=lambda line: len(line.text)).node.up  # never the block itself: its neighbours belong to it
        while node is not None:
            if chars(node) >= REGION_SHARE * total:
                region = _widened(node, lines)
                break
            node = node.up
    inside = range(region.first, region.last)
    linked = [not lines[i].away and lines[i].links >= ALL_LINKS * len(lines[i].text) for i in inside]
    out = []
    for all_links, run in groupby(inside, key=lambda i: linked[i - region.first]):
        run = list(run)
        if not (all_links and len(run) >= LINK_RUN and sum(ratios[i] for i in run) < cut * len(run)):
            out += [lines[i].text for i in run if not lines[i].away]
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages -> the same rows without the html column, with main_text.

    Null and empty pages, and pages that hold nothing but navigation and the like, have the empty
    text. Character references are decoded; runs of white space inside a block (br counts as
    one) are one space; blocks are joined by two line feeds in page order. Broken markup is read
    as the standard library's parser reads it. Rows are independent; a page is read whole.
    """
    names = [c for c in pages.columns if c not in (html, "main_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h.as_py()) for h in b.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], texts], names=[*names, "main_text"])

    return small_batches(pages).mapInArrow(trimmed(run), pages.select(*names).schema.add("main_text", "string"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
