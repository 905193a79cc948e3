"""A tolerant HTML tree for use inside tasks.

The tokenizer is one pattern whose every branch consumes what it looked at, so the time
per page grows with its size, also on pages that open thousands of tags and close none.
"""

from __future__ import annotations

import html as html_lib
import re

# --- fixed values of the HTML language
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
RAW_TEXT = {"script", "style"}
BLOCK = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
         "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
# start tag -> (open elements it ends, ancestors beyond which it does not look)
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}),
        "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
P_SCOPE = {"table", "td", "th", "caption", "button", "object", "applet", "marquee", "template", "html"}
# --- end of fixed values

class Node:
    """An element (``tag`` set), comment or processing instruction; ``items`` mixes text and children."""

    __slots__ = ("kind", "tag", "attrs", "parent", "items", "data", "first", "last")

    def __init__(self, kind: str, tag: str | None, parent: "Node | None", first: int, data: str = ""):
        self.kind, self.tag, self.parent, self.data = kind, tag, parent, data
        self.attrs: dict[str, str] = {}
        self.items: list = []
        self.first = self.last = first


# a quoted value may hold anything; only the last quote of a page can be without an end, so a vain search for one
# happens once per kind of quote
_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<bogus>[!?/])(?P<data>[^>]*+)(?:>|\Z)"
    rf"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|{_QUOTED})*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
RAW_END = {tag: re.compile(rf"</{tag}[\s/>][^>]*>?|</{tag}\Z", re.IGNORECASE) for tag in RAW_TEXT}


def _decoded(text: str) -> str:
    return html_lib.unescape(text) if "&" in text else text


class Tree:
    """Parsed document; ``root`` is a nameless node above all top-level ones."""

    def __init__(self, source: str):
        self.chunks: list[str] = []
        self.names: dict[str, int] = {}  # how many elements of a name are open
        self.latest: Node | None = None
        self.root = self.open = Node("root", None, None, 0)
        self._read(source)
        while self.open is not self.root:
            self._end()
        self.root.last = len(self.chunks)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                self._text(_decoded(source[at:]))
                return
            if found.start() > at:
                self._text(_decoded(source[at:found.start()]))
            at = found.end()
            if found["start"] is not None:
                tag = found["start"].lower()
                self._start(tag, found["attrs"])
                if tag in RAW_TEXT and self.open is self.latest:
                    close = RAW_END[tag].search(source, at)
                    stop = close.start() if close else size
                    if stop > at:
                        self._text(source[at:stop])
                    at = stop
            elif found["end"] is not None:
                self._end_tag(found["end"].lower())
            elif found["comment"] is not None:
                self._note("comment", found["comment"])
            elif found["bogus"] == "?":
                self._note("pi", found["data"])

    def string(self, node: Node) -> str:
        """All text inside a node."""
        return "".join(self.chunks[node.first:node.last])

    def _end(self) -> None:
        self.open.last = len(self.chunks)
        self.names[self.open.tag] -= 1
        self.open = self.open.parent

    def _end_open(self, tags: set[str], scope: set[str]) -> None:
        """End the outermost open element among ``tags`` within ``scope``, and all inside it."""
        node, found = self.open, None
        if not any(self.names.get(t) for t in tags):
            return
        while node.tag is not None and node.tag not in scope:
            if node.tag in tags:
                found = node
            node = node.parent
        while found is not None and self.open is not found.parent:
            self._end()

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._end_open({"p"}, P_SCOPE)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        node = self.latest = Node("element", tag, self.open, len(self.chunks))
        for name, *values in ATTRIBUTE.findall(attrs):
            node.attrs.setdefault(name.lower(), _decoded("".join(values)))
        self.open.items.append(node)
        if tag not in VOID and not SELF_CLOSED.search(attrs):
            self.open = node
            self.names[tag] = self.names.get(tag, 0) + 1

    def _end_tag(self, tag: str) -> None:
        node = self.open
        if not self.names.get(tag):
            return
        while node.tag is not None and node.tag != tag:
            node = node.parent
        if node.tag is not None:
            while self.open is not node.parent:
                self._end()

    def _text(self, data: str) -> None:
        items = self.open.items
        self.chunks.append(data)
        if items and isinstance(items[-1], str):
            items[-1] += data
        else:
            items.append(data)

    def _note(self, kind: str, data: str) -> None:
        self.open.items.append(Node(kind, None, self.open, len(self.chunks), data))


def _start_tag(node: Node) -> str:
    attrs = "".join(f' {k}="{html_lib.escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>"


def flatten(source: str, paths: bool = False) -> dict:
    """The document as rows: markup written out once, and one row per node in document order.

    ``start``, ``stop`` and ``tail_stop`` are character offsets into that markup, so the
    outer HTML of any node is a substring.  ``last`` is the last row inside a node.
    """
    tree = Tree(source)
    out: list[str] = []
    rows: list[dict] = []
    at = 0

    def write(piece: str) -> None:
        nonlocal at
        out.append(piece)
        at += len(piece)

    lead = tree.root.items[0] if tree.root.items and isinstance(tree.root.items[0], str) else ""
    stack: list[list] = [[tree.root, 0, -1, -1]]  # node, position of the next item, own row, last child's row
    while stack:
        frame = stack[-1]
        node, position, own, child = frame
        if position < len(node.items):
            frame[1] += 1
            item = node.items[position]
            if isinstance(item, str):
                write(item if node.tag in RAW_TEXT else html_lib.escape(item, quote=False))
                if position:
                    rows[child]["tail"], rows[child]["tail_stop"] = item, at
                continue
            row = {"node": len(rows), "parent": own, "depth": len(stack) - 1, "kind": item.kind,
                   "tag": item.tag, "attrs": list(item.attrs.items()), "start": at, "stop": at, "tail_stop": at,
                   "last": len(rows), "text": item.data, "tail": "",
                   "path": (rows[own]["path"] if own >= 0 else "") + "/" + (item.tag or item.kind) if paths else None}
            if item.kind == "element" and item.items and isinstance(item.items[0], str):
                row["text"] = item.items[0]
            frame[3] = row["node"]
            rows.append(row)
            if item.kind == "comment":
                write(f"<!--{item.data}-->")
            elif item.kind == "pi":
                write(f"<?{item.data}>")
            else:
                write(_start_tag(item))
            stack.append([item, 0, row["node"], -1])
            continue
        stack.pop()
        if own >= 0:
            if node.kind == "element" and node.tag not in VOID:
                write(f"</{node.tag}>")
            rows[own]["stop"] = rows[own]["tail_stop"] = at
            rows[own]["last"] = len(rows) - 1
    return {"html": "".join(out), "lead": lead, "nodes": rows}
