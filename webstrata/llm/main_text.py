"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' numbers.

A page is read once into blocks, the runs of text between block-level tags (one ``<br>`` is white space, two part
blocks).  A block's features are its words and link density, those of the blocks before and after it, how surely a
container marks it as boilerplate (1 by words or a form, 2 by tags or as others' text), whether one marks it as main content, and whether the page has such a main container at all.  The tree
is grown from the labelled table below.  Kept blocks are joined in page order.

NULL and empty pages give an empty text, as do pages without a block that is kept.  Scripts, styles, templates, the
head and comments never make blocks, nor do containers that are hidden by an attribute or by their own style (a class
name tells nothing, as style sheets may show it again); an unclosed one swallows the rest of the page, as in browsers.  A tag cut off at
the page's end is markup, a quote that never closes ends at the next ``>``.  Repeated rows are read alike; extra
columns pass through ``with_main_text`` untouched.  Nothing is cut, whatever the length or depth of a page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column

from .common import text_function, worker_memory

# fixed values: HTML element names, and words that sites use in class, id and role attributes
BLOCK_TAGS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                 "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
                 "td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
SKIPPED_TAGS = set("head iframe noembed noframes noscript object script select style svg template textarea title".split())
RAW_TAGS = set("script style textarea title iframe noembed noframes noscript".split())
BOILERPLATE_TAGS = set("nav footer aside form menu dialog button fieldset".split())
MAIN_TAGS = {"article", "main"}
HEADING_TAGS = set("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense alert banner banners breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "copyright disclaimer discussion disqus feedback foot footer gdpr head header legal links login masthead menu menus meta modal nav navbar navigation "
    "newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion recommendations recommended register "
    "related replies reply respond response responses search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe "
    "subscription taboola tags teaser toolbar topbar warning widget widgets".split())
OTHERS_WORDS = set("comment comments discussion disqus outbrain promo promoted promotion recommendations recommended related replies reply respond response responses "
                   "sponsor sponsored sponsors taboola teaser".split())  # what others wrote, and excerpts of other pages
MAIN_WORDS = set("article articlebody content entry main post postbody story".split())
PLACE_WORDS = set(
    "area bar block blocks body bottom box button buttons center class col column container desktop div fixed float footer form global group header holder icon icons "
    "inner item items left link list mobile outer page panel posts primary right row secondary section single site sticky sub text title top trail wrap wrapper zone".split())
# end of fixed values

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_boilerplate", "in_main", "page_has_main"]
# the labelled table: features as above, then 1 for main text
LABELLED = """
 5 1.00  0 0.00  4 1.00 1 0 0 0 |  4 1.00  5 1.00  6 1.00 1 0 1 0 | 12 0.00  5 1.00  9 0.00 1 0 1 0 |  9 0.00 60 0.00  0 0.00 1 0 1 0 |  1 1.00  0 0.00  1 1.00 1 0 1 0
30 0.10 44 0.00  3 0.50 1 0 0 0 | 55 0.00 20 0.05 31 0.00 1 1 1 0 | 25 0.00 70 0.00 40 0.00 1 1 1 0 |  6 0.00 90 0.00 45 0.00 1 0 0 0 | 80 0.02 60 0.00 20 0.00 1 0 1 0
 2 0.00  3 0.00  2 0.00 1 1 1 0 | 40 0.00  2 1.00 60 0.00 1 0 1 0 | 14 0.00 35 0.00 10 1.00 1 1 1 0 | 18 0.30  0 0.00  5 1.00 1 0 0 0 | 22 0.00 18 0.00 80 0.00 1 0 0 0
 8 0.00  5 1.00 60 0.00 0 1 1 1 | 60 0.00  8 0.00 45 0.00 0 1 1 1 |  3 0.00 45 0.00 52 0.00 0 1 1 1 |  1 0.00 30 0.00 28 0.00 0 1 1 1 | 35 0.20 50 0.00 20 0.10 0 1 1 1
12 0.00  4 1.00  2 0.00 0 1 1 1 |  2 0.00 12 0.00  9 0.00 0 1 1 1 | 90 0.05 10 0.00  3 1.00 0 1 1 1 | 15 0.40 33 0.00 41 0.02 0 1 1 1 |  6 1.00 40 0.00 38 0.00 0 1 1 1
 4 0.00  0 0.00  0 0.00 0 1 1 1 | 20 0.00  6 1.00 12 0.00 0 1 1 1 |  7 0.50 25 0.00 60 0.00 0 1 1 1 |150 0.01 80 0.00 95 0.00 0 1 1 1 |  5 0.00  2 1.00  1 0.00 0 1 1 1
 3 0.00  5 1.00  6 1.00 0 0 1 0 | 10 0.00  0 0.00 40 0.00 0 0 1 0 | 25 0.10 50 0.00  4 1.00 0 0 1 0 | 45 0.00  3 0.00 60 0.00 0 0 1 0 |  1 1.00  2 1.00  1 1.00 0 0 1 0
 8 0.80 40 0.00 12 0.90 0 0 1 0 | 60 0.00 40 0.00  9 0.00 0 0 1 0 |  2 0.00  0 0.00  3 0.00 0 0 1 0 | 17 0.50  1 1.00 20 0.00 0 0 1 0 |120 0.00 75 0.00  8 0.40 0 0 1 0
 3 1.00  0 0.00  4 1.00 0 0 0 0 |  4 1.00  3 1.00  5 1.00 0 0 0 0 |  2 0.00  4 1.00  3 1.00 0 0 0 0 |  9 0.90 40 0.00  6 1.00 0 0 0 0 | 20 0.85  3 1.00 25 0.80 0 0 0 0
 4 0.00  3 1.00  2 0.00 0 0 0 0 |  3 0.00  2 0.00  4 1.00 0 0 0 0 |  5 0.00  1 0.00  3 0.60 0 0 0 0 |  6 0.50  9 0.80  0 0.00 0 0 0 0 |  1 0.00  2 1.00  2 1.00 0 0 0 0
40 0.00  6 0.00 55 0.00 0 0 0 1 | 55 0.02 40 0.00 33 0.00 0 0 0 1 | 33 0.00 55 0.00  4 1.00 0 0 0 1 | 18 0.00  4 1.00 30 0.00 0 0 0 1 | 12 0.10 30 0.00 44 0.00 0 0 0 1
 6 0.00  4 1.00 40 0.00 0 0 0 1 |  7 0.00 35 0.00 50 0.00 0 0 0 1 | 70 0.15  3 0.00  5 1.00 0 0 0 1 | 25 0.00  2 0.00  3 0.00 0 0 0 1 | 16 0.00 60 0.00  3 1.00 0 0 0 1
80 0.00 60 0.00 70 0.00 1 0 0 1 |120 0.02 90 0.00 99 0.00 1 0 0 1 | 60 0.00  8 0.00 45 0.00 1 0 0 1 | 45 0.05 70 0.00  3 1.00 1 0 0 1 |150 0.00  0 0.00  0 0.00 1 0 0 1
80 0.00 60 0.00 70 0.00 2 0 0 0 |120 0.02 90 0.00 99 0.00 2 0 0 0 | 60 0.00  8 0.00 45 0.00 2 0 0 0 | 45 0.05 70 0.00  3 1.00 2 0 0 0 |150 0.00  0 0.00  0 0.00 2 0 0 0
70 0.60 60 0.10 50 0.20 1 0 0 0 | 90 0.80  5 1.00 80 0.70 1 0 0 0 |130 0.01 80 0.00 95 0.00 1 1 1 1 |110 0.00 60 0.00 30 0.00 1 1 1 1 |120 0.70 60 0.00 40 0.20 1 1 1 0
130 0.01 80 0.00 95 0.00 2 1 1 0 |110 0.00 60 0.00 30 0.00 2 1 1 0 |130 0.00 80 0.00 60 0.00 2 0 1 0 |130 0.00 80 0.00 60 0.00 1 0 1 0
"""

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NO_DECLARATION = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z)""", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}


def _attributes(raw: str) -> dict[str, str]:
    """Names in small letters and their values, empty if there is none; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _declared(style: str) -> dict[str, str]:
    """Properties of a style attribute and their values; the last of a name counts, unless an earlier one is important."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in _NO_DECLARATION.sub(" ", style.lower()).split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        name, important = name.strip(), bool(mark)
        if important or not found.get(name, (False, ""))[0]:
            found[name] = important, value.strip()
    return {name: value for name, (_, value) in found.items()}


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    boilerplate: int  # how sure its containers' mark is: 0 no mark, 1 words or a form, 2 words of others' text, 3 tags
    main: bool
    mark: int = 0  # number of the innermost container with a mark of 1

    @property
    def links(self) -> float:
        return self.linked / max(1, len(self.text))


@dataclass
class _Open:
    tag: str
    boilerplate: int
    main: bool
    skipped: bool
    unseen: bool = False  # by visibility, which a container inside can undo
    mark: int = 0


def _named_as(named: dict[str, str], in_main: bool) -> tuple[int, bool, bool]:
    """The mark by class, id and role, whether it is one of comments, and whether they name main content.

    A name marks only as a whole: all its parts are boilerplate words or say where on the page it is.
    """
    tokens = [{w.lower() for w in _PARTS.findall(t)} for n in ("class", "id", "role") for t in named.get(n, "").split()]
    if in_main or any(t & MAIN_WORDS for t in tokens):  # the head of an article belongs to it
        tokens = [t - {"head", "header", "meta"} for t in tokens]
    whole = [t for t in tokens if t & BOILERPLATE_WORDS and t <= BOILERPLATE_WORDS | MAIN_WORDS | PLACE_WORDS]
    level = max((2 if t & OTHERS_WORDS else 1 for t in whole), default=0)
    return level, any(t & {"comment", "comments", "reply"} for t in whole), any(t & MAIN_WORDS and not t & BOILERPLATE_WORDS for t in tokens)


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=lambda: [_Open("", 0, False, False)])
    around: list[int] = field(default_factory=lambda: [0])  # for each container with a mark of 1 the one around it
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0  # how many containers were open where the link begins
    breaks: int = 0

    def text(self, raw: str) -> None:
        if self.open[-1].skipped or self.open[-1].unseen or not raw:
            return
        if self.breaks and not raw.isspace():
            self.breaks = 0
        decoded = html.unescape(raw)  # a reference ends with its piece of text
        self.parts.append(decoded)
        if self.in_link:
            self.linked += len(" ".join(decoded.split()))

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.open[-1].boilerplate, self.open[-1].main, self.open[-1].mark))
        self.parts, self.linked, self.breaks = [], 0, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.close_block()
            return
        if tag == "a":  # also ends an open one
            self.in_link = len(self.open) if "href" in _attributes(attributes) else 0
        if tag in VOID_TAGS and tag != "hr":
            return
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            self.close_block()
        if tag == "hr" or tag not in BLOCK_TAGS and tag not in SKIPPED_TAGS:
            return
        named = _attributes(attributes) if attributes else {}
        style = _declared(named["style"]) if "style" in named else {}
        hidden = "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or style.get("display") == "none"
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # the next of its kind ends it
            self._end(tag, until=("ul", "ol", "table", "dl", "select", "div", "section", "article", "main", "blockquote", "body"))
            self._end_link()
        elif self.open[-1].tag == "p":
            self._end("p")
            return self.start(tag, attributes)
        unseen = style["visibility"] in ("hidden", "collapse") if style.get("visibility", "inherit") != "inherit" else self.open[-1].unseen
        top = self.open[-1]
        level, comments, named_main = _named_as(named, top.main) if named and tag not in ("html", "body") else (0, False, False)
        if tag in HEADING_TAGS or tag in MAIN_TAGS and not comments:
            level = 0
        if tag in BOILERPLATE_TAGS or tag == "header" and not top.main:
            level = max(level, 1 if tag in ("form", "fieldset") else 3)
        # main content resets what words or a form around it say; within comments and the like only <main> does
        inherited, mark = top.boilerplate, top.mark
        if not level and (inherited == 1 and (tag in MAIN_TAGS or named_main) or inherited == 2 and tag == "main"):
            inherited = mark = 0
        if level == 1 and inherited < 2:
            self.around.append(mark)
            mark = len(self.around) - 1
        boilerplate = max(level, inherited)
        main = top.main or tag in MAIN_TAGS or named_main and not boilerplate
        self.open.append(_Open(tag, boilerplate, main, top.skipped or tag in SKIPPED_TAGS or hidden, unseen, mark))

    def _end(self, tag: str, until: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in until:
                return

    def _end_link(self) -> None:
        """A link that was never closed ends with the container where it begins."""
        if len(self.open) < self.in_link:
            self.in_link = 0

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        elif tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            self.close_block()
            self._end(tag)
            self._end_link()

    def drop_marks(self) -> None:
        """A mark of 1 on more than half of the page's text outside surer marks and links tells nothing."""
        own = [round((1 - b.links) * len(b.text.split())) if b.boilerplate < 2 else 0 for b in self.blocks]
        inside, holds = [0] * len(self.around), [False] * len(self.around)
        for b, n in zip(self.blocks, own):
            inside[b.mark] += n
        for k in range(len(inside) - 1, 0, -1):  # a container comes after the one around it
            inside[self.around[k]] += inside[k]
        for k in range(1, len(inside)):
            holds[k] = 2 * inside[k] <= inside[0] or holds[self.around[k]]
        for b in self.blocks:
            if b.boilerplate == 1 and not holds[b.mark]:
                b.boilerplate = 0


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; time grows with its length only."""
    reader, at, pattern = _Reader(), 0, _TAG
    while at < len(page):
        k = page.find("<", at)
        if k < 0:
            reader.text(page[at:])
            break
        reader.text(page[at:k])
        after = page[k + 1:k + 2]
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = len(page) if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", k)
            at = len(page) if end < 0 else end + 1
        elif after.isascii() and after.isalpha() or after == "/" and page[k + 2:k + 3].isalpha():
            found = pattern.match(page, k)
            if not found and pattern is _TAG:
                if page.find(">", k) < 0:
                    break
                pattern = _PLAIN_TAG  # a quote without end: from here on quotes mean nothing
                found = pattern.match(page, k)
            if not found:
                break
            closing, tag, attributes = found[1], found[2].lower(), found[3]
            at = found.end()
            if closing:
                reader.end(tag)
            elif tag in RAW_TAGS:
                reader.start(tag, "")
                end = _END_OF_RAW[tag].search(page, at)
                at = len(page) if end is None else end.start()
            elif not (attributes.endswith("/") and tag in SKIPPED_TAGS):
                reader.start(tag, attributes)
        else:
            reader.text("<")
            at = k + 1
    reader.close_block()
    reader.drop_marks()
    return reader.blocks


def features_of(blocks: list[Block]) -> np.ndarray:
    words = np.array([0, *(len(b.text.split()) for b in blocks), 0], float)
    links = np.array([0, *(b.links for b in blocks), 0])
    flags = np.array([(min(b.boilerplate, 2), b.main) for b in blocks], float).reshape(-1, 2)
    has_main = float((flags[:, 1] * (flags[:, 0] == 0)).any())
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags, np.full(len(blocks), has_main)])


@dataclass
class Node:
    value: float
    feature: int = 0
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by Gini impurity; ties go to the earlier feature and the lower threshold."""
    node = Node(float(y.mean()))
    if depth == 0 or y.min() == y.max():
        return node
    best = y.mean() * (1 - y.mean()) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            right = x[:, f] > cut
            impurity = sum(side.mean() * (1 - side.mean()) * len(side) for side in (y[right], y[~right])) / len(y)
            if impurity < best:
                best, node.feature, node.threshold = impurity, f, float(cut)
    right = x[:, node.feature] > node.threshold
    if best < y.mean() * (1 - y.mean()) - 1e-9 and right.any() and not right.all():
        node.low, node.high = grow(x[~right], y[~right], depth - 1), grow(x[right], y[right], depth - 1)
    return node


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value >= 0.5)
    right, out = x[:, node.feature] > node.threshold, np.zeros(len(x), bool)
    out[right], out[~right] = classify(node.high, x[right]), classify(node.low, x[~right])
    return out


def tree() -> Node:
    """The classifier, grown once a worker."""
    known = worker_memory("main text")
    if LABELLED not in known:
        table = np.array([[float(v) for v in row.split()] for line in LABELLED.split("\n") for row in line.split("|") if row.strip()])
        known[LABELLED] = grow(table[:, :-1], table[:, -1])
    return known[LABELLED]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, classify(tree(), features_of(blocks))) if keep)


def extracted(page: Column) -> Column:
    """A struct of text and n_chars for a column of pages."""

    def build():
        def work(pages: list[bytes]) -> list:
            texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
            return [texts, [len(t) for t in texts]]
        return work

    return text_function(build, "text string, n_chars long")(page)
