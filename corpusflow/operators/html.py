"""HTML to content: the one step that needs a tree, and so Python; Arrow carries pages in and blocks out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.config import BOILERPLATE, HARD_STRIP, STRUCTURAL_STRIP
from corpusflow.functions.arrow import by_parts
from corpusflow.functions.text import BLANKS, once
from corpusflow.functions.tokens import units

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HEAD_ONLY = frozenset("title meta link style script base noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag ends open elements of these names, looked for up to the stated limits.
IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
BARRIERS = frozenset(("table", "td", "th", "caption", "button", "html", "body"))
_SPACE = re.compile(f"[{re.escape(BLANKS)}]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node | str]:
        """All below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.children))

    def all(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag in tags]

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def line(self) -> str:
        return _SPACE.sub(" ", self.text()).strip(" ")

    def within(self, *tags: str) -> bool:
        x = self.parent
        while x is not None:
            if x.tag in tags:
                return True
            x = x.parent
        return False

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [x for x in self.parent.children if x is not self]
            self.parent = None


class Builder(HTMLParser):
    """A tree with html, head and body; start tags end what HTML says they end."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head, self.body = Node("head", {}, self.root), Node("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.open: list[Node] = [self.body]
        self.in_head, self.quirks = True, True
        self.feed(html)
        self.close()

    def handle_decl(self, decl: str) -> None:
        self.quirks = self.quirks and not decl.lower().startswith("doctype")

    def _end(self, names: tuple[str, ...], limits: tuple[str, ...] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return
            if self.open[i].tag in limits:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in ("html", "head", "body"):
            {"html": self.root, "head": self.head, "body": self.body}[tag].attrs.update(own)
            self.in_head = self.in_head and tag != "body"
            return
        if self.in_head and tag in HEAD_ONLY and len(self.open) == 1:
            node = Node(tag, own, self.head)
            self.head.children.append(node)
            if tag not in VOID:
                self.open.append(node)
            return
        self.in_head = False
        if tag in CLOSES_P and not (tag == "table" and self.quirks):
            self._end(("p",), BARRIERS)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            for _ in names:
                self._end(names, limits)
        if tag == "a":
            self._end(("a",), BARRIERS)
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name == tag or tag in HEADINGS and name in HEADINGS:
                del self.open[i:]
                return
            if name in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return
        if tag == "p":
            self.open[-1].children.append(Node("p", {}, self.open[-1]))

    def handle_data(self, data: str) -> None:
        if self.in_head and len(self.open) == 1:
            if not data.strip():
                return
            self.in_head = False
        self.open[-1].children.append(data)


def strip(root: Node) -> None:
    """Remove what is no content: by tag, then by marked class or id unless it looks like content."""
    for node in root.all(*HARD_STRIP, *STRUCTURAL_STRIP):
        node.drop()
    body = next(x for x in root.children if isinstance(x, Node) and x.tag == "body")
    limit = units(body.line()) * 0.25
    marked = [(n, f"{n.attrs.get('class', '')}\n{n.attrs.get('id', '')}".lower()) for n in root.walk() if isinstance(n, Node) and (n.attrs.get("class") or n.attrs.get("id"))]
    for word in BOILERPLATE:
        for node, names in marked:
            if word not in names or not node.within("body"):
                continue
            if units(node.line()) > limit or len(node.all("p")) >= 3 or len(node.all(*HEADINGS)) >= 2:
                continue
            node.drop()


def table_text(table: Node) -> str:
    rows = [[cell.line() for cell in tr.all("th", "td")] for tr in table.all("tr")]
    first = table.all("tr")[:1]
    head = " | ".join(t for t in (th.line() for tr in first for th in tr.all("th")) if t)
    lines = [f"Columns: {head}"] if head else []
    for cells in rows:
        text = " | ".join(c for c in cells if c)
        if text and text != head:
            lines.append(f"Row: {text}")
    return "\n".join(lines)


def list_text(items: Node) -> str:
    texts = (x.line() for x in items.children if isinstance(x, Node) and x.tag == "li")
    return "\n".join(f"- {t}" for t in texts if t)


def content(html: str) -> dict:
    """title, headings, blocks and links of a page."""
    root = Builder(html).root
    links = [a.attrs["href"] for a in root.all("a") if a.attrs.get("href")]
    strip(root)
    titles, tops = root.all("title"), root.all("h1", "h2")
    title = titles[0].line() if titles else ""
    about = f"{titles[0].text() if titles else ''} {tops[0].text() if tops else ''}".lower()
    faq = re.search(r"faq|frequently\s+asked", about) is not None
    headings, blocks, path = [], [], []
    for node in root.all(*HEADINGS, "p", "ul", "ol", "table"):
        if node.within(*HEADINGS, "table", "ul", "ol"):
            continue
        if node.tag in HEADINGS:
            text = node.line()
            if text:
                level = int(node.tag[1])
                path = [h for h in path if h["level"] < level] if path and path[-1]["level"] >= level else path
                path = [*path, {"level": level, "text": text}]
                headings.append(path[-1])
            continue
        kind, text = {"table": ("table", table_text), "ul": ("faq" if faq else "list", list_text), "ol": ("faq" if faq else "list", list_text)}.get(node.tag, ("paragraph", Node.line))
        text = text(node)
        if text:
            blocks.append({"type": kind, "content": text, "headingPath": [h["text"] for h in path]})
    return {"title": title or (headings[0]["text"] if headings else ""), "headings": headings, "blocks": blocks, "links": links}


SCHEMA = "struct<title:string,headings:array<struct<level:int,text:string>>,blocks:array<struct<type:string,content:string,headingPath:array<string>>>,links:array<string>,error:string>"
_ARROW = pa.struct([
    ("title", pa.string()), ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
    ("blocks", pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("headingPath", pa.list_(pa.string()))]))), ("links", pa.list_(pa.string())), ("error", pa.string()),
])


def parsed(html: Column, or_error: bool = False) -> Column:
    """The content struct of a page; null for null. Filter pages before it: no filter moves below it. or_error: a page
    that the parser fails on has only `error`, what it failed with, and doesn't hold up the others."""

    def read(page: str) -> dict:
        try:
            return content(page)
        except MemoryError:
            raise
        except Exception as e:
            if not or_error:
                raise
            return {"error": f"{type(e).__name__}: {e}"}

    @F.arrow_udf(SCHEMA)
    def parse(pages: pa.Array) -> pa.Array:
        return by_parts(lambda some: [None if p is None else read(p) for p in some], _ARROW, pages)

    return once(parse)(html)
