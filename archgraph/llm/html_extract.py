"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's streaming parser turns a page into *lines*, one for each block of
text. Each line has a text-to-tag ratio (its characters over the tags inside it, with
linked text discounted; none inside menus, footers and their like). The logarithms of the ratios, smoothed by a Gaussian along
the page, are clustered by a threshold, a share of the page's highest value: so a line counts by
what stands around it, and a short one among menus is none of a cluster. Each run of lines above it is
a cluster, and its region is the smallest container that holds it, widened to the ``article`` around it and that one's
sibling articles, else to the ``main`` around it. The main text is what the regions of all clusters hold, short lines
too, with the headings before them; nothing goes because other text is more. Inside, elements and words that mark boilerplate
exclude, and do nothing else.

Defined cases: a page inside one form keeps its text; a null or empty page gives the empty text; a page that is cut off keeps the
text before the cut, without the unfinished tag; a page of one short line keeps it;
repeated pages give repeated rows; very long and very deep pages take time in proportion, as
what elements hold is summed once from the inside out; other columns of the input pass through
no further, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the running block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p"
    " pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never main text.
NOT_CONTENT = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav footer aside"
    " button select textarea datalist dialog menu search fieldset label".split()
)
#: Containers that can be a region.
REGION = frozenset("article main section div td body html".split())
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
#: Words in a class, id or role that mark boilerplate.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos"
    " promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist"
    " disqus replies respond footer footers masthead toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations widget"
    " widgets pagination pager skip copyright disclaimer hidden complementary contentinfo".split()
)
#: The mark of a form, which is boilerplate as its fields are, unless the page stands in it.
FORM = "form"
#: Those whose elements may hold most of a page's text and still be none of its main text.
DISCUSSION_WORDS = frozenset("comment comments commentlist disqus replies respond related recommended recommendations".split())
#: Words that an article or main is marked by.
ARTICLE_NOISE_WORDS = frozenset("comment comments ad ads advert related".split())
#: Words that turn the next one into a statement on the layout, as in "has-sidebar".
LAYOUT_WORDS = frozenset("has no with without".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")
WORD = re.compile("[a-z0-9]+")
NO_MARKS: frozenset[str] = frozenset()
SHORT_COMMENT = re.compile("<!--+>")
COMMENT_END = re.compile(r"--!?\s*>")
UNFINISHED = re.compile(r"<(?=[A-Za-z/!?])")


class _Node:
    """An element. ``order`` counts elements in page order, so that a parent comes before what is inside it."""

    __slots__ = ("tag", "parent", "order", "noise", "marks", "marked", "header", "heading", "link", "article", "main", "in_article")

    def __init__(self, tag: str, parent: "_Node | None", order: int, noise: bool, marks: frozenset[str], header: bool) -> None:
        self.tag, self.parent, self.order, self.noise, self.header = tag, parent, order, noise, header
        #: Its own noise words, and whether it or an element around it has some.
        self.marks, self.marked = marks, bool(marks) or (parent is not None and parent.marked)
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        self.link = tag == "a" or (parent is not None and parent.link)
        #: The outermost article and main around it, and whether one without noise words is.
        self.article = parent.article if parent is not None and parent.article is not None else self if tag == "article" else None
        self.main = parent.main if parent is not None and parent.main is not None else self if tag == "main" else None
        self.in_article = (parent is not None and parent.in_article) or (tag in ("article", "main") and not marks)


class _Lines(HTMLParser):
    """Collects (text, tags, linked characters, node) for each block of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [_Node("#root", None, 0, False, frozenset(), False)]
        self.stack = [self.nodes[0]]
        #: How many elements of each tag are open.
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, _Node]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.at: _Node | None = None

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.at or self.stack[-1]))
        self.parts, self.tags, self.linked, self.at = [], 0, 0, None

    def cut(self, i: int) -> None:
        """Close the open elements from place ``i`` on."""
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]

    def inside(self, tags: frozenset[str] | set[str], stop: set[str] = frozenset()) -> int:
        """The place of the innermost open element of these tags, if none of ``stop`` is inside it; else 0."""
        if not any(self.open[tag] for tag in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def noisy(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in ("html", "body"):
            return False
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
            return True
        if attrs.get("role", "").lower() in NOISE_ROLES:
            return True
        style = attrs.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style:
            return True
        return False

    def marks(self, tag: str, attrs: dict[str, str]) -> frozenset[str]:
        """The noise words of an element's class and id."""
        if tag in ("html", "body") or not ("class" in attrs or "id" in attrs):
            return NO_MARKS
        if tag in ("article", "main"):
            names, noise = attrs.get("class", ""), ARTICLE_NOISE_WORDS
        else:
            names, noise = f"{attrs.get('class', '')} {attrs.get('id', '')}", NOISE_WORDS
        found = set()
        for name in names.lower().split():
            words = WORD.findall(name)
            found.update(w for before, w in zip(["", *words], words) if w in noise and before not in LAYOUT_WORDS)
        return frozenset(found) if found else NO_MARKS

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The end of a CDATA section, or else of a bogus comment, which any other ``<![`` is."""
        if self.rawdata.startswith("CDATA[", i + 3) and (end := self.rawdata.find("]]>", i + 9)) >= 0:
            return end + 3
        return self.parse_bogus_comment(i, 0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment; one without an end takes the rest, as the page is fed whole."""
        if short := SHORT_COMMENT.match(self.rawdata, i):
            return short.end()
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append("\n")
        self.tags += 1
        if tag in CLOSES_P and (i := self.inside({"p"}, {"td", "th", "button", "object"})):
            self.cut(i)
        if tag in SIBLINGS and (i := self.inside(*SIBLINGS[tag])):
            if tag == "tr":
                i = self.inside({"tr"}, SIBLINGS[tag][1]) or i
            self.cut(i)
        if tag in VOID:
            return
        if tag == "body" and (i := self.inside({"head"})):
            self.cut(i)
        top = self.stack[-1]
        known = {k: v or "" for k, v in attrs}
        noise = top.noise or tag in NOT_CONTENT or self.noisy(tag, known)
        marks = self.marks(tag, known)
        node = _Node(tag, top, len(self.nodes), noise, marks | {FORM} if tag == "form" else marks, top.header or tag == "header")
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append("\n")
            return
        if i := self.inside({tag}):
            self.cut(i)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if self.at is None and not data.isspace():
            self.at = top
        elif self.at is not None and (self.at.noise, self.at.marked) != (top.noise, top.marked) and not data.isspace():
            self.flush()  # an inline element such as a label or button is its own line
            self.at = top
        self.parts.append(data)
        if top.link:
            self.linked += len(data)


def complete(html: str) -> str:
    """The page without a tag that its end cuts off."""
    at = html.rfind("<")
    if at >= 0 and html.find(">", at) < 0 and UNFINISHED.match(html, at):
        html = html[:at]
    return html


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """The ratios under a normalised Gaussian window."""
    radius = max(1, math.ceil(2 * sigma))
    window = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), window, mode="full")[radius:-radius]
    return np.convolve(ratios, window, mode="full")[radius:-radius] / weight


def _held(nodes: list[_Node], own: list[float]) -> list[float]:
    """What each element holds with all inside it; ``own`` by its own lines."""
    held = own[:]
    for node in reversed(nodes[1:]):
        held[node.parent.order] += held[node.order]
    return held


def _down(nodes: list[_Node], first, step) -> list:
    """A value for each element from its parent's: ``step(parent's value, element)``."""
    out = [first] * len(nodes)
    out[0] = step(first, nodes[0])
    for node in nodes[1:]:
        out[node.order] = step(out[node.parent.order], node)
    return out


#: A marked element with an article outside wraps the page from this share of the voted text on.
MOST = 0.7
#: The Gaussian's width in lines, and the threshold as a share of the highest smoothed value.
SIGMA, SHARE = 2.0, 0.78


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text of one page: its blocks joined by line feeds."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(complete(html))
    parser.close()
    parser.flush()
    every, nodes = parser.lines, parser.nodes
    kept = [i for i, x in enumerate(every) if not x[3].noise]
    if not kept:
        return ""
    voters = _voters(every, kept, sigma, share)
    if any(every[i][3].marked for i in kept):
        stays = _unmarked(nodes, [every[i] for i in kept], voters[kept])
        kept = [i for i, x in zip(kept, stays) if x]
        if not kept:
            return ""
        voters = _voters(every, kept, sigma, share)
    lines, voters = [every[i] for i in kept], voters[kept]
    regions = _regions(nodes, lines, voters)
    semantic = any(x.tag in ("article", "main") for x in regions)
    header = any(x.header for x in regions)
    chosen = {x.order for x in regions}
    within = _down(nodes, False, lambda above, node: above or node.order in chosen)
    inside = [within[x[3].order] for x in lines]
    for i in range(len(lines) - 2, -1, -1):
        # Headings before a region are its headings, but for those of a header outside.
        inside[i] = inside[i] or (inside[i + 1] and lines[i][3].heading and not lines[i][3].header)
    content = [i for i, x in enumerate(inside) if x and voters[i]]
    out = []
    for i, (text, _, linked, node) in enumerate(lines):
        if not inside[i]:
            continue
        if node.header and not node.heading and not header:
            continue  # a header inside the region keeps its headings only
        if not semantic and linked > 0.6 * len(text) and not node.heading and not content[0] <= i <= content[-1]:
            continue  # a menu before or after the content
        out.append(text)
    return "\n".join(out)


def _voters(every: list[tuple[str, int, int, _Node]], kept: list[int], sigma: float, share: float) -> np.ndarray:
    """Which lines are in a cluster of high smoothed ratios; those that aren't ``kept`` count as tags."""
    ratios = np.zeros(len(every))
    for i in kept:
        text, tags, linked, _ = every[i]
        ratios[i] = max(0, len(text) - 2 * linked) / max(1, tags)
    smoothed = smooth(np.log1p(ratios), sigma)
    voters = np.zeros(len(every), dtype=bool)
    voters[kept] = smoothed[kept] >= share * smoothed[kept].max()
    return voters


def _unmarked(nodes: list[_Node], lines: list[tuple[str, int, int, _Node]], voters: np.ndarray) -> list[bool]:
    """Which lines are not in elements that class or id mark as boilerplate, or in forms.

    A mark counts for nothing on an element that wraps the page: one with at least half of
    the text in articles and mains, or of the voted text. With an article outside, it must
    hold most of the voted text and several blocks: an advertisement may outweigh a short
    article. A comment thread may be as long as any, and wraps the page only if no article
    and nearly nothing else is outside. A word whose elements hold half of the
    text in articles together (or of the voted text, without any), as a page builder's blocks
    do, marks no boilerplate on that page.
    """
    voted, blocks, articles = ([0] * len(nodes) for _ in range(3))
    for (text, _, linked, node), vote in zip(lines, voters):
        voted[node.order] += int(vote) * len(text)
        blocks[node.order] += int(vote)
        articles[node.order] += node.in_article * max(0, len(text) - linked)
    total, in_articles = sum(voted), sum(articles)
    weights = articles if in_articles else voted
    held, held_blocks, held_articles = (_held(nodes, x) for x in (voted, blocks, articles))
    lifted = set()
    for node in nodes:
        k = node.order
        if not node.marks:
            continue
        if in_articles and held_articles[k] >= 0.5 * in_articles:
            lifted.add(k)
        elif node.marks & DISCUSSION_WORDS:
            if not in_articles and held[k] >= 0.9 * total:
                lifted.add(k)
        elif held[k] >= 0.5 * total if not in_articles else held[k] >= MOST * total and held_blocks[k] > 2:
            lifted.add(k)
    words = _down(nodes, NO_MARKS, lambda above, node: above if not node.marks or node.order in lifted else above | node.marks)
    shares: dict[str, int] = {}
    for node in nodes:
        if weight := weights[node.order]:
            for word in words[node.order]:
                shares[word] = shares.get(word, 0) + weight
    layout = {w for w, share in shares.items() if w not in DISCUSSION_WORDS and share >= 0.5 * (in_articles or total)}
    stays = _down(nodes, True, lambda above, node: above and (not node.marks or node.order in lifted or node.marks <= layout))
    return [stays[line[3].order] for line in lines]


def _regions(nodes: list[_Node], lines: list[tuple[str, int, int, _Node]], voters: np.ndarray) -> list[_Node]:
    """The content regions: of each run of voted lines the smallest container around it, or the article or main around that."""
    # What is inside an element comes right after it in page order, up to here.
    ends = list(range(len(nodes)))
    for node in reversed(nodes[1:]):
        ends[node.parent.order] = max(ends[node.parent.order], ends[node.order])
    found: dict[int, _Node] = {}
    scopes: set[int] = set()
    at = 0
    while at < len(lines):
        if not voters[at]:
            at += 1
            continue
        until = at
        while until + 1 < len(lines) and voters[until + 1]:
            until += 1
        orders = [x[3].order for x in lines[at : until + 1]]
        node, last = nodes[min(orders)], max(orders)
        while ends[node.order] < last or (node.order not in found and node.tag not in REGION and node.parent is not None):
            node = node.parent
        if (article := node.article) is not None:
            # Its siblings are parts of the same text: those in its main element, else in its parent.
            scopes.add((article.main or article.parent).order)
            node = article
        elif node.main is not None:
            node = node.main
        found[node.order] = node
        at = until + 1
    if scopes:
        within = _down(nodes, False, lambda above, node: above or node.order in scopes)
        for x in lines:
            if x[3].article is not None and within[x[3].article.order]:
                found[x[3].article.order] = x[3].article
    return list(found.values())


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batch: pa.RecordBatch) -> list[pa.Array]:
    texts = [main_text(x) for x in batch.column(2).to_pylist()]
    return [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (columns page_id, url, html).

    One map over the pages; no shuffle.
    """
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(map_columns(_extract, SCHEMA), "page_id long, url string, text string, n_chars long")
