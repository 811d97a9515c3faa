"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path (tag
names with their classes).  The paths form a tree.

1. For each path, text without links and punctuation are aggregated over its
   blocks: characters a block, marks a block, and characters for each element
   that holds such blocks.  The logarithms of the three ratios are fused by
   addition.
2. Paths with little text of their own lean on the path of the element around
   them, aggregated over its direct blocks: both are weighed by characters,
   from the root down.
3. Each step of a path adds a fixed feature value by its tag, role and class
   words (an article up; menus, adverts, comments and the like down).  A step
   that holds nearly all the text of a long page says nothing and adds none.
4. Scores are smoothed along the page over neighbouring blocks whose paths
   meet in one element or in one directly inside the other.
5. Paths are kept from ``spread`` times the mean score on (of the paths above
   zero, weighed by characters and score).  All blocks of the paths kept are
   returned in page order.

Only what a browser does not show as text is left out beforehand: scripts,
styles, comments in the markup, form controls and hidden elements.

The page is read once; elements, paths and open tags are kept in tables, so
that time grows in proportion to the page, also for deep or misnested ones.

Edge cases: a null or empty page, and one without content, gives an empty
text; unclosed and misnested tags are closed as browsers do for paragraphs,
list items and table cells; text outside any tag counts as a block of the
page; repeated pages give equal rows; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import map_rows

# HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
UNSEEN = frozenset("head script style noscript template iframe button select option datalist textarea svg canvas object audio video map".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd td th figcaption caption summary blockquote".split())
# Feature values of a step of a path, in units of the fused ratios (prose has about 15).
TAG_VALUE = {"article": 4.0, "main": 3.0, "h1": 6.0, "h2": 3.0, "h3": 3.0, "nav": -12.0, "header": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0}
ROLE_VALUE = {"main": 3.0, "article": 4.0} | dict.fromkeys("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split(), -12.0)
#: Inside another article an article is a reader's comment or a teaser.
NESTED_ARTICLE = -12.0
#: One of these among the words of a class or id.
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising advertorial sponsored cookie cookies gdpr popup newsletter navbar nav navigation breadcrumb breadcrumbs pagination sidebar masthead footer comment comments commentlist disqus".split())
#: In proportion to their share of the words of a class or id.
WEAK_WORDS = frozenset(
    "adbox sponsor promo promotion banner consent notice notices alert modal overlay subscribe subscription signup login logo menu menubar pager toc header topbar footnav copyright side aside rail widget widgets "
    "related recommended recommendations disclaimer skip share sharing social replies reply respond discussion search form".split()
)
#: In proportion to their share, on elements that hold others.
CONTENT_WORDS = frozenset("article articlebody content entry post story text maincontent".split())
WORD_VALUE, CONTENT_VALUE, LEAF_SHARE = -12.0, 4.0, 0.2

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")


@dataclass
class Element:
    tag: str
    path: int
    parent: int
    hidden: bool
    in_link: bool
    block: int  # itself, or the element around an inline one


@dataclass
class Path:
    """A node of the tree of tag paths."""

    parent: int
    value: float  # of its last step
    in_article: bool
    worded: bool = False  # whether the value is from words, or from a form


@dataclass
class Block:
    element: int
    path: int
    text: str
    linked: int


def _words_value(given: str) -> float:
    words = {*re.split(r"[^a-z0-9]+", given.lower()), *(w.lower() for w in _CAMEL.findall(given))} - {""}
    if not STRONG_WORDS.isdisjoint(words):
        return WORD_VALUE
    n = max(1, len([w for w in re.split(r"[^a-zA-Z0-9]+", given) if w]))
    return WORD_VALUE * min(1.0, len(WEAK_WORDS & words) / n) or CONTENT_VALUE * min(1.0, len(CONTENT_WORDS & words) / n)


def _features(tag: str, attributes: str) -> tuple[float, bool, bool, str]:
    """Value by attributes, whether it is from words, whether the element is hidden, and the class for the path."""
    value, hidden, worded, label = 0.0, False, False, ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, given = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if name == "class":
                    label = given.lower()
                if tag not in ("html", "body"):
                    values = [_words_value(x) for x in given.split()] or [0.0]
                    said = (min(values) if min(values) < 0 else max(values)) * (LEAF_SHARE if tag in LEAVES and tag not in ("li", "td") else 1.0)
                    if said < 0 or value >= 0:
                        value, worded = (min(value, said) if said < 0 else max(value, said)), worded or said < 0
            elif name == "role":
                value += ROLE_VALUE.get(given.strip().lower(), 0.0)
            elif name == "hidden" or "display:none" in given.lower().replace(" ", ""):
                hidden = True
    return value, worded, hidden, label


class _Page:
    """One pass over a page: its elements, the tree of its paths, and its blocks in page order."""

    def __init__(self, page: str):
        self.elements, self.paths, self.blocks = [Element("", 0, -1, False, False, 0)], [Path(-1, 0.0, False)], []
        self._ids: dict[tuple[int, str, str], int] = {}
        self._stack = [0]
        self._open: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        self._parts: list[str] = []
        self._linked = 0
        self._read(page)

    def _text(self, text: str) -> None:
        top = self.elements[self._stack[-1]]
        if not top.hidden:
            text = html.unescape(text) if "&" in text else text
            self._parts.append(text)
            if top.in_link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                at = self.elements[self._stack[-1]].block
                self.blocks.append(Block(at, self.elements[at].path, text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        """Close the nearest open ``tag`` and all in it, unless an element of ``stop`` is between."""
        places = self._open.get(tag)
        if not places:
            return
        depth = places[-1]
        if any(self._open.get(s, (0,))[-1] > depth for s in stop if self._open.get(s)):
            return
        if any(self.elements[k].block == k for k in self._stack[depth:]):
            self._flush()
        for k in self._stack[depth:]:
            self._open[self.elements[k].tag].pop()
        del self._stack[depth:]

    def _add(self, tag: str, attributes: str) -> None:
        up_at = self._stack[-1]
        up = self.elements[up_at]
        value, worded, hidden, label = _features(tag, attributes) if attributes else (0.0, False, False, "")
        hidden = up.hidden or hidden or tag in UNSEEN
        at = len(self.elements)
        if tag in INLINE and value > WORD_VALUE:
            self.elements.append(Element(tag, up.path, up_at, hidden, up.in_link or tag == "a", up.block))
        else:
            self._flush()
            key = (up.path, tag, label)
            if key not in self._ids:
                self._ids[key] = len(self.paths)
                around = self.paths[up.path]
                if tag == "article" and around.in_article:
                    value += NESTED_ARTICLE
                else:
                    value += TAG_VALUE.get(tag, 0.0)
                self.paths.append(Path(up.path, max(value, WORD_VALUE), around.in_article or tag == "article", worded or tag == "form"))
            self.elements.append(Element(tag, self._ids[key], up_at, hidden, up.in_link, at))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(at)

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                self._text(page[at:end])
            if m is None:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag, ("td", "th", "table", "article", "body") if tag in INLINE or tag == "p" else ())
                continue
            attributes = m[3] or m[6] or ""
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag not in INLINE:
                self._flush()
                if tag in CLOSES_P:
                    self._close("p", ("td", "th", "table", "button"))
                if tag == "li":
                    self._close("li", ("ul", "ol", "menu"))
                elif tag in ("dt", "dd"):
                    self._close("dt", ("dl",))
                    self._close("dd", ("dl",))
                elif tag in ("td", "th", "tr"):
                    for other in ("td", "th", *(("tr",) if tag == "tr" else ())):
                        self._close(other, ("table",))
                elif tag == "body":
                    self._close("head")
            if tag in RAW:
                stop = _raw_end(tag).search(page, at)
                at = stop.end() if stop else len(page)
            elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag in ("svg", "path")):
                self._add(tag, attributes)
        self._flush()


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def _fused(chars: float, blocks: float, marks: float, linked: float, holders: float) -> float:
    """The fused ratios of a path: characters (links left out) and marks a block, and characters an element."""
    plain = max(0.0, chars - linked)
    return math.log1p(plain / blocks) + math.log1p(marks / blocks * plain / chars) + math.log1p(plain / holders)


def score_paths(page: _Page, lean: float = 300.0, nearly_all: float = 0.7, long: int = 1_000) -> dict[int, float]:
    """The smoothed score of each path that has blocks.

    With ``lean`` characters, or half of the largest path's if that is less, a
    path weighs as much as what is around it.
    """
    paths, blocks = page.paths, page.blocks
    own = [[0.0, 0.0, 0.0, 0.0, 0.0] for _ in paths]  # blocks of this very path
    inner = [[0.0, 0.0, 0.0, 0.0, 0.0] for _ in paths]  # and of paths one step longer
    whole = [0.0] * len(paths)  # characters of all below
    seen: set[tuple[int, int]] = set()
    for b in blocks:
        holder = page.elements[page.elements[b.element].parent].block if b.element else 0
        marks = len(_PUNCTUATION.findall(b.text))
        up = max(0, paths[b.path].parent)
        whole[b.path] += len(b.text)
        for sums, at, holds in ((own, b.path, holder), (inner, b.path, b.element), (inner, up, holder)):
            if sums is inner and at == up == b.path and holds == b.element:
                continue  # the root is its own surrounding
            t = sums[at]
            t[0] += len(b.text)
            t[1] += 1
            t[2] += marks
            t[3] += b.linked
            if (holds, id(sums) == id(own), at) not in seen:
                seen.add((holds, id(sums) == id(own), at))
                t[4] += 1
    for k in range(len(paths) - 1, 0, -1):
        whole[paths[k].parent] += whole[k]
    total = whole[0]
    lean = min(lean, max(t[0] - t[3] for t in own) / 2) or 1.0

    around, value, raw = [0.0] * len(paths), [0.0] * len(paths), {}
    for k, p in enumerate(paths):
        lent = around[p.parent] if k else 0.0
        says_nothing = p.worded and total >= long and whole[k] >= nearly_all * total
        value[k] = (value[p.parent] if k else 0.0) + (0.0 if says_nothing else p.value)
        chars = inner[k][0]
        around[k] = (chars * _fused(*inner[k]) + lean * lent) / (chars + lean) if chars else lent
        if own[k][0]:
            raw[k] = (own[k][0] * _fused(*own[k]) + lean * lent) / (own[k][0] + lean) + value[k]

    # neighbours on the page, where one's element is around the other or the same is around both
    score = dict.fromkeys(raw, 0.0)
    chars = dict.fromkeys(raw, 0.0)
    for k, b in enumerate(blocks):
        up = paths[b.path].parent
        s, w = 4 * raw[b.path], 4.0
        for other in blocks[max(0, k - 1) : k] + blocks[k + 1 : k + 2]:
            there = paths[other.path].parent
            if up == there or up == other.path or there == b.path or paths[there].parent == up or paths[up].parent == there:
                share = 1 - b.linked / len(b.text)  # text of links stays what it is
                s += share * raw[other.path]
                w += share
        score[b.path] += len(b.text) * s / w
        chars[b.path] += len(b.text)
    return {p: score[p] / chars[p] for p in score}


def chosen_paths(page: _Page, spread: float = 0.6) -> set[int]:
    """The paths whose score is above zero and at least ``spread`` times the mean of such, weighed by characters and score."""
    score = score_paths(page)
    mass = dict.fromkeys(score, 0)
    for b in page.blocks:
        mass[b.path] += len(b.text) - b.linked
    above = [p for p in score if score[p] > 0]
    total = sum(score[p] * mass[p] for p in above)
    limit = spread * sum(score[p] ** 2 * mass[p] for p in above) / total if total else math.inf
    return {p for p in above if score[p] >= limit}


def main_text(page: str | None) -> str:
    read = _Page(page or "")
    kept = chosen_paths(read) if read.blocks else set()
    return "\n\n".join(b.text for b in read.blocks if b.path in kept)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""

    def rows(batch):
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), f"{id_col} {kind}, {url_col} string, text string, n_chars long", rows)
