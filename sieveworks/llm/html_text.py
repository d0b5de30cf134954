"""Main text of web pages by minimum cuts.

A page is cut into text blocks. What the elements above a block say (its marks) and a
logistic classifier over its form give the cost of either label; blocks that follow each
other or stand under one element pull each other to the same label, the more the nearer
they are in the tree. The minimum cut of that network, found by maximum flow, separates content
from boilerplate.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded

#: Pages whose blocks train the classifier, and the most blocks of one of them.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 200

#: Elements whose content is no text of the page; the first two reach to the end where they aren't closed, the others are then ignored.
_RAW = tuple("script style textarea title template noscript iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math meter mfrac mi mn mo mrow ms msqrt msub msup mtext object output q ruby rb rp rt s samp small span strike strong sub sup svg text time tspan tt u var wbr".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset("ul ol dl table td th body html article section div main aside nav".split())
_CHOICES = frozenset("select option optgroup".split())
#: Elements of forms; an article may stand in one that spans the page.
_FORM_TAGS = frozenset("form button fieldset select head".split())
_BOILER_TAGS = _FORM_TAGS | frozenset("nav footer aside dialog menu".split())
_CONTENT_TAGS = frozenset("article main".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
_COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
_BOILER_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
_CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
_HEAD_WORDS = frozenset("header masthead topbar".split())
#: Parts of a class name that say where or how, and leave the meaning to the other parts.
_NEUTRAL_WORDS = _CONTENT_WORDS | _HEAD_WORDS | frozenset(
    "area articles aside bar blog body bottom box block center col column container div entries fixed global group holder inline inner item items js layout left level link links list media mobile module outer page panel posts primary right row secondary section side site slot small sticky stories text thread title top unit wrap wrapper".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|</[^a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/]|$)", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'»”’)]*$")


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    #: 1: the nearest mark at or above it is one of content, -1: of boilerplate, 0: there is none.
    mark: int = 0
    #: A mark of boilerplate stands above the nearest one of content.
    under: bool = False
    inside_content: bool = False
    #: The mark of boilerplate is that of a form.
    form: bool = False
    #: The nearest mark is content because of an article or main element, and no mark of boilerplate stands above it.
    whole: bool = False


@dataclass(eq=False, slots=True)
class Block:
    """A run of text without a block boundary in it."""

    element: Element
    text: str
    linked: int
    heading: bool
    features: list[float] = field(default_factory=list)


@functools.lru_cache(10_000)
def _meanings(name: str) -> tuple[bool, bool, bool, bool]:
    """Whether a class or id, as a whole, is a word of boilerplate, of comments, of content, of a page's head.

    'cookie-notice' and 'sidebar-left' are words of boilerplate, 'share-price-story' and
    'comments-open' aren't: every part must be known.
    """
    parts = {p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(p) > 1}
    boiler = bool(parts & _BOILER_WORDS) and parts <= _BOILER_WORDS | _NEUTRAL_WORDS
    content = not boiler and bool(parts & _CONTENT_WORDS) and parts <= _NEUTRAL_WORDS
    head = not boiler and bool(parts & _HEAD_WORDS) and parts <= _NEUTRAL_WORDS
    return boiler, boiler and bool(parts & _COMMENT_WORDS), content and not head, head


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    out = Element(tag, parent, parent.depth + 1 if parent else 0)
    if parent:
        out.mark, out.under, out.inside_content, out.form, out.whole = parent.mark, parent.under, parent.inside_content, parent.form, parent.whole
    if tag in ("html", "body"):
        return out
    boiler = comment = content = hidden = False
    head = tag == "header"
    role = ""
    if attributes and attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden":
                hidden |= name == "hidden" or value.lower() == "true"
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                for x in map(_meanings, value.split()):
                    boiler, comment, content, head = boiler or x[0], comment or x[1], content or x[2], head or x[3]
    own = tag in _CONTENT_TAGS or role in ("main", "article")
    # an article's class makes it boilerplate only where it is a reader's comment
    if hidden or tag in _BOILER_TAGS or role in _BOILER_ROLES or (comment and not content if own else boiler) or head and not out.inside_content and not own:
        out.mark, out.inside_content, out.form, out.whole = -1, False, tag in _FORM_TAGS and (out.mark >= 0 or out.form), False
    elif own or content:
        out.under |= out.mark < 0 and not out.form
        out.mark, out.inside_content, out.form = 1, True, False
        out.whole = (own or out.whole) and not out.under
    return out


@functools.cache
def _raw_end(tag: str, closing: bool = False) -> re.Pattern:
    """The next tag of that name, group 1 being its slash; only end tags where ``closing``."""
    return re.compile(rf"<(/{'' if closing else '?'}){tag}(?![^\s/>])[^>]*>", re.IGNORECASE)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in its order; the text of scripts, styles and the like is none."""
    out: list[Block] = []
    if not page:
        return out
    root = top = Element("", None, -1)
    texts: list[str] = []
    linked = links = headings = 0

    def flush(at: Element) -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                while at.tag in _INLINE and at.parent:
                    at = at.parent
                out.append(Block(at, text, linked, headings > 0))
            texts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        texts.append(text)
        if links:
            linked += len(text)

    def leave(at: Element) -> None:
        """Close ``at`` and all in it."""
        nonlocal top, links, headings
        while top is not at.parent:
            links -= top.tag == "a"
            headings -= len(top.tag) == 2 and top.tag[0] == "h" and top.tag[1].isdigit()
            top = top.parent

    unclosed: set[str] = set()
    place = 0
    while place < len(page):
        start = page.find("<", place)
        if start < 0:
            add(page[place:])
            break
        if start > place:
            add(page[place:start])
        m = _TOKEN.match(page, start) or _LOOSE_TAG.match(page, start)
        if not m:
            add("<")
            place = start + 1
            continue
        place = m.end()
        if not m.lastindex:
            # a comment or declaration; character data is text
            if page.startswith("<![CDATA[", start):
                add(page[start + 9 : place].removesuffix("]]>"))
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        inline = tag in _INLINE
        if not inline:
            flush(top)
        if closing:
            at = top
            while at.parent and at.tag != tag and not (inline and at.tag not in _INLINE):
                at = at.parent
            if at.parent and at.tag == tag:
                leave(at)
            continue
        if tag == "xmp":
            # shown as it is written
            end = _raw_end(tag, True).search(page, place)
            add(page[place : end.start() if end else len(page)].replace("&", "&amp;"))
            flush(_open(tag, attributes, top))
            place = end.end() if end else len(page)
            continue
        if tag in _RAW:
            if not attributes.endswith("/") and tag not in unclosed:
                end = _raw_end(tag).search(page, place)
                if end and end[1]:
                    place = end.end()
                elif tag in _RAW[:2]:
                    end = _raw_end(tag, True).search(page, place)
                    place = end.end() if end else len(page)
                elif not end:
                    unclosed.add(tag)
            continue
        if top.tag in _CHOICES and tag not in _CHOICES and tag != "hr":
            # nothing else stands in a list of choices: it wasn't closed
            while top.tag in _CHOICES:
                leave(top)
        if tag in _VOID:
            continue
        if not inline:
            # what this start tag ends
            ends = _SIBLINGS.get(tag, ())
            at = top
            while at.parent and at.tag not in _FENCES - {"td", "th"} and not (at.tag == "p" or at.tag in ends):
                at = at.parent
            if at.parent and (at.tag == "p" or at.tag in ends):
                leave(at)
        top = _open(tag, attributes, top)
        links += tag == "a"
        headings += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    flush(top)
    assert root.depth == -1
    return out


#: What the nearest mark above a block is worth: one of content, of boilerplate, and one of content that stands in boilerplate.
MARKS = np.array([4.0, -5.0, -4.0])
#: What a block of an article has besides, if no mark of boilerplate stands between or above: more than form and neighbours can take away, since an article is taken whole.
ARTICLE = 30.0
#: What the classifier sees of a block, and its weights before training.
FEATURES = ("bias", "link share", "log words", "sentence", "heading", "paragraph", "list item")
PRIOR = np.array([-0.8, -4.0, 0.5, 0.8, 0.2, 0.3, -0.2])


def features(block: Block) -> list[float]:
    """The form of a block, whatever its marks."""
    text, tag = block.text, block.element.tag
    return [1.0, min(1.0, block.linked / len(text)), math.log(text.count(" ") + 1), float(bool(_SENTENCE_END.search(text))), float(block.heading), float(tag in ("p", "pre", "blockquote")), float(tag in ("li", "dt", "dd", "td", "th"))]


def marks(block: Block) -> list[float]:
    return [float(block.element.mark > 0), float(block.element.mark < 0), float(block.element.under)]


def fit(rows: np.ndarray, labels: np.ndarray, pull: float = 0.02) -> np.ndarray:
    """Logistic weights for blocks with a label, held near :data:`PRIOR` (Newton's method)."""
    if not len(rows):
        return PRIOR
    x, y = rows, labels
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(x) + pull * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + pull * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def distance(a: Element, b: Element) -> int:
    """Edges between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block], strength: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between neighbours under one element."""
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, strength * math.exp(-0.5 * distance(found[i - 1].element, block.element))))
        above = id(block.element.parent)
        if above in last and last[above] < i - 1:
            out.append((last[above], i, strength * 0.5))
        last[above] = i
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    A node with a positive ``gain`` has a terminal edge of that capacity from the source,
    one with a negative an edge to the sink; ``links`` (a, b, capacity) hold both ways.
    Flow is augmented from one node after another, along the shortest path to a node with
    room to the sink, so that a search stays near its start however long the page is. The
    nodes that a vain search saw reach no such node any more, and no later flow leaves
    them; together they are what the source reaches in the end, its side of the cut.
    """
    n = len(gain)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in links:
        room[a][b] = room[a].get(b, 0.0) + capacity
        room[b][a] = room[b].get(a, 0.0) + capacity
    take = [max(-g, 0.0) for g in gain]
    tiny = 1e-12
    side = [False] * n
    for start in range(n):
        give = gain[start]
        while give > tiny and not side[start]:
            came = {start: -1}
            queue = deque(came)
            end = -1
            while queue and end < 0:
                a = queue.popleft()
                for b, capacity in room[a].items():
                    if capacity > tiny and b not in came and not side[b]:
                        came[b] = a
                        if take[b] > tiny:
                            end = b
                            break
                        queue.append(b)
            if end < 0:
                for a in came:
                    side[a] = True
                break
            path = [end]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            flow = min(take[end], give, *(room[a][b] for b, a in zip(path, path[1:])))
            take[end] -= flow
            give -= flow
            for b, a in zip(path, path[1:]):
                room[a][b] -= flow
                room[b][a] += flow
    return side


def main_text(page: str | None, weights: np.ndarray, strength: float = 1.0) -> str:
    """The content blocks of a page, joined by spaces."""
    found = blocks(page)
    if not found:
        return ""
    gain = (np.array([features(b) for b in found]) @ weights + np.array([marks(b) for b in found]) @ MARKS + ARTICLE * np.array([b.element.whole for b in found])).tolist()
    side = minimum_cut(gain, edges(found, strength))
    return " ".join(b.text for b, keep in zip(found, side) if keep)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the classifier, from the form of those blocks of ``sample_pages`` pages that have a mark.

    The pages are those whose ids have the smallest hashes. The label of a block is its
    nearest mark; pages without marks leave the weights as they were.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(features(b), float(b.element.mark > 0 and not b.element.under)) for page in batch["html"].to_pylist() for b in blocks(page)[:SAMPLE_BLOCKS] if b.element.mark]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], ["features", "label"])

    pages = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    got = pages.join(F.broadcast(chosen), "page_id", "left_semi").select("html").mapInArrow(rows, "features array<double>, label double").collect()
    if not got:
        return PRIOR
    # in one order, whatever the partitions
    table = np.array(sorted([*r["features"], r["label"]] for r in got))
    return fit(table[:, :-1], table[:, -1])


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = 1.0) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    text holds the blocks of the main text, each with single spaces inside, joined by one
    space; it is empty for null and empty pages and those without content. n_chars counts
    code points. Rows are taken one by one, so repeated rows and ids give repeated results;
    other columns aren't read; an empty table gives an empty one. Without ``weights`` they
    are trained from a bounded sample of the pages.
    """
    weights = train(pages, id_col, html_col) if weights is None else weights
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights, strength) for page in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return bounded(rows).mapInArrow(make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
