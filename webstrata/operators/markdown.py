"""Markdown form of HTML pages, for reading and for counting what a page really says."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.htmltree import Node, Tree
from .groups import spread

TAG_START = re.compile(r"<[a-zA-Z]")
SPACES = re.compile(r"[ \t\r\n]+")
BLANK_LINES = re.compile(r"(?:\n\s*-\s*\n|\n\s*\n)+")

# --- fixed values: how elements map to Markdown
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
HEADINGS = {"h1": "#", "h2": "##", "h3": "###", "h4": "####", "h5": "#####", "h6": "######"}
DROPPED = set("""script style svg head meta title link input select textarea base object embed param applet canvas
    audio video source track noscript template wbr bdi bdo ruby rt rp details summary dialog menu menuitem slot
    img""".split())
BLOCKS_IN_LINK = {"div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
# --- end of fixed values


def _words(text: str) -> str:
    return SPACES.sub(" ", text).strip(" ")


@dataclass(frozen=True)
class Place:
    """What encloses the element being written."""

    items: int = 0          # list items around it
    holder: bool = False    # inside a list item, table cell or definition
    cell: bool = False
    table: bool = False

    def inside(self, tag: str | None) -> "Place":
        return Place(self.items + (tag == "li"), self.holder or tag in ("li", "td", "th", "dd"),
                     self.cell or tag == "td", self.table or tag == "table")


class Sides:
    """Neighbours of every child of one element: the nearest texts, and where each kind of element occurs."""

    def __init__(self, items: list):
        self.before, self.after = [""] * len(items), [""] * len(items)
        self.first: dict[str, int] = {}
        self.last: dict[str, int] = {}
        text = ""
        for i, item in enumerate(items):
            self.before[i] = text
            if isinstance(item, str):
                text = item
            elif item.tag:
                self.first.setdefault(item.tag, i)
                self.last[item.tag] = i
        text = ""
        for i in range(len(items) - 1, -1, -1):
            self.after[i] = text
            if isinstance(items[i], str):
                text = items[i]


class Writer:
    def __init__(self, source: str):
        self.tree = Tree(source)
        self.sides: dict[int, Sides] = {}

    def result(self) -> str:
        return BLANK_LINES.sub("\n\n", self.children(self.tree.root, Place())).strip()

    def text(self, node: Node) -> str:
        return _words(self.tree.string(node))

    def children(self, node: Node, place: Place) -> str:
        inner = place.inside(node.tag)
        self.sides[id(node)] = Sides(node.items)
        return "".join(self.plain(node, i, inner) if isinstance(item, str) else self.element(item, node, i, inner)
                       for i, item in enumerate(node.items))

    def plain(self, parent: Node, position: int, place: Place) -> str:
        gap = self.later(parent, position, "ol", "table") or (not place.items and self.later(parent, position, "ul"))
        return _words(parent.items[position]) + ("\n\n" if gap else "")

    def element(self, node: Node, parent: Node, position: int, place: Place) -> str:
        tag = node.tag
        if node.kind != "element" or tag in DROPPED:
            return ""
        if tag in HEADINGS:
            words = self.text(node)
            return f"\n\n{HEADINGS[tag]} {words}\n\n" if words else ""
        if tag in MARKS:
            mark = MARKS[tag]
            return self.spaced(parent, position, f"{mark}{self.children(node, place)}{mark}") if self.text(node) else ""
        if tag in ("span", "code"):
            if tag == "span":
                return self.spaced(parent, position, self.text(node)) if self.text(node) else ""
            return self.spaced(parent, position, "" if parent.tag == "pre" else f"`{self.tree.string(node)}`")
        block = getattr(self, f"_{tag}", None)
        if block is not None:
            return block(node, parent, position, place)
        line = not place.items or self.later(parent, position, "ul", "ol")
        inner = self.children(node, place)
        return f"\n\n{inner}\n" if line else inner

    def later(self, parent: Node, position: int, *tags: str) -> bool:
        """Whether one of the elements follows among the siblings."""
        return any(self.sides[id(parent)].last.get(t, -1) > position for t in tags)

    def spaced(self, parent: Node, position: int, body: str) -> str:
        """Give back the blanks that the neighbouring texts lose at their ends."""
        sides = self.sides[id(parent)]
        return " " * sides.before[position].endswith(" ") + body + " " * sides.after[position].startswith(" ")

    def _a(self, node, parent, position, place):
        words, href = self.text(node), _words(node.attrs.get("href", ""))
        if node.attrs.get("href", "").startswith("#"):
            return self.spaced(parent, position, words)
        link = f"[{words}]({href})" if words and href else ""
        if link and not place.holder and any(isinstance(i, Node) and i.tag in BLOCKS_IN_LINK for i in node.items):
            link += "\n\n"
        return self.spaced(parent, position, link)

    def _p(self, node, parent, position, place):
        inner = self.children(node, place)
        return inner if place.holder else f"\n\n{inner}\n\n"

    def _div(self, node, parent, position, place):
        if parent.tag in ("span", "li", "td"):
            return self.children(node, place)
        if parent.tag != "div" and not place.cell:
            return "\n" + self.children(node, place) if self.text(node) else ""
        return self.children(node, place) + ("" if place.table else "\n\n")

    def _list(self, node, parent, position, place):
        lead = "" if place.items and self.sides[id(parent)].first.get("li", position) < position else "\n"
        if not self.text(node):
            return lead
        inner, number, lines = place.inside(node.tag), 0, []
        for item in (i for i in node.items if isinstance(i, Node) and i.tag == "li"):
            filled = bool(self.text(item))
            number += filled
            lines.append(self.item(item, inner, "* " if node.tag == "ul" else f"{number if filled else ''}. "))
        return lead + "".join(lines)

    _ul = _ol = _list

    def item(self, node: Node, place: Place, bullet: str) -> str:
        shown = bullet if self.text(node) or self.has_link(node) else ""
        return " " * min(4 * place.items, 40) + shown + self.children(node, place) + "\n"

    def _li(self, node, parent, position, place):
        return self.item(node, place, "* ")

    def has_link(self, node: Node) -> bool:
        return any(isinstance(i, Node) and (i.tag == "a" or self.has_link(i)) for i in node.items)

    def _pre(self, node, parent, position, place):
        code = next((i for i in node.items if isinstance(i, Node) and i.tag == "code"), None)
        language = re.search(r"(?:language|lang)-(\S*)", code.attrs.get("class", "")) if code else None
        return f"\n\n```{language.group(1) if language else ''}\n{self.tree.string(code or node)}\n```\n\n"

    def rows(self, node: Node, place: Place) -> list[tuple[Node, Place]]:
        inner, found = place.inside(node.tag), []
        for i in node.items:
            if isinstance(i, Node):
                found += ([(i, inner)] if i.tag == "tr" else []) + self.rows(i, inner)
        return found

    def _table(self, node, parent, position, place):
        if not self.text(node):
            return "\n\n\n\n"
        rows = self.rows(node, place)
        lines = [self.row(r, p) for r, p in rows]
        cells = [i.tag for i in rows[0][0].items if isinstance(i, Node) and i.tag in ("th", "td")] if rows else []
        rule = "|" + "---|" * len(cells) + "\n"
        head = lines[:1] if "th" in cells else ["|" + "   |" * len(cells) + "\n"]
        return "\n\n" + "".join(head + [rule] + lines[len(head) if "th" in cells else 0:]) + "\n\n"

    def row(self, node: Node, place: Place) -> str:
        inner = place.inside("tr")
        cells = [i for i in node.items if isinstance(i, Node) and i.tag in ("th", "td")]
        return "|" + "".join(f" {self.children(c, inner) if self.text(c) else ' '} |" for c in cells) + "\n"

    def _tr(self, node, parent, position, place):
        return self.row(node, place)

    def _td(self, node, parent, position, place):
        return f" {self.children(node, place) if self.text(node) else ' '} |"

    _th = _td

    def _tbody(self, node, parent, position, place):
        return self.children(node, place)

    def _blockquote(self, node, parent, position, place):
        words = self.text(node)
        return "\n\n" + (f"> {words}\n" if words else "") + "\n\n"

    def _hr(self, *_):
        return "\n\n---\n\n"

    def _br(self, *_):
        return "  \n"

    def _dl(self, node, parent, position, place):
        return f"\n{self.children(node, place)}\n"

    def _dt(self, node, parent, position, place):
        term = f"**{self.children(node, place)}**"
        return term if place.holder else f"\n{term}\n"

    def _dd(self, node, parent, position, place):
        inner = self.children(node, place)
        return f": {inner}" if place.holder else f"    {inner}\n"


def markdown_text(source: str | None) -> str | None:
    """Markdown of one page; NULL without any tag, or if the page cannot be converted."""
    start = TAG_START.search(source) if source else None
    if start is None or source.find(">", start.end()) < 0:
        return None
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        return Writer(source).result()
    except RecursionError:
        return None
    finally:
        sys.setrecursionlimit(limit)


def markdown(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([markdown_text(p) for p in pages.to_pylist()], pa.string())

    return run(html)


def to_markdown(resources: DataFrame) -> DataFrame:
    """(site, id, url, markdown) of the HTML rows."""
    pages = resources.where((F.col("type") == "html") & F.col("content").isNotNull())
    return spread(pages.select("site", "id", "url", "content")).select("site", "id", "url", markdown(F.col("content")).alias("markdown"))


def markdown_savings(resources: DataFrame) -> DataFrame:
    """Bytes before and after conversion, per site."""
    pages = resources.where((F.col("type") == "html") & F.col("content").isNotNull())
    sizes = spread(pages.select("site", "content")).select("site", F.octet_length("content").alias("html"), F.octet_length(markdown(F.col("content"))).alias("md"))
    return sizes.groupBy("site").agg(
        F.count("*").alias("pages"), F.sum("html").alias("html_bytes"),
        F.sum(F.coalesce("md", F.lit(0))).alias("markdown_bytes"))
