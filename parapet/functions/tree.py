"""Trees of HTML as it is found: nodes numbered so that every axis is a test of numbers, and paths as steps of Column expressions.

`tree` gives a page's nodes in document order. A node's number is `pre`; its subtree is `pre` to `end`. So a descendant lies in the
interval, an ancestor's interval holds the node, what follows begins after `end`. A path is written as steps (`pick`), not as text.
Bind the tree to a column first: steps read it many times.

    pages.withColumn("t", tree("html")).select(pick(F.col("t"), "a", of=pick(F.col("t"), "article"), test=lambda n: n["attributes"]["rel"] == "next"))
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.functions import strings as S

#: Fixed values of HTML: elements without content, with raw content, of the head; what an open element is ended by, and what shields it.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW, REFERENCED = {"script", "style", "iframe", "noembed", "noframes", "xmp"}, {"title", "textarea"}
HEAD = set("title meta link base style script noscript template".split())
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPE = set("html body table td th caption button object".split())
ENDED = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, SCOPE | {"dl"}), "dd": ({"dt", "dd"}, SCOPE | {"dl"}), "option": ({"option"}, SCOPE | {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "a": ({"a"}, SCOPE), **{x: ({"tbody", "thead", "tfoot"}, {"table"}) for x in ("tbody", "thead", "tfoot")},
}
#: Elements whose text nobody reads, and those after which a line or a word ends.
UNREAD = {"script", "style", "head", "title", "noscript"}
BREAKS = {**dict.fromkeys("p div br tr li table h1 h2 h3 h4 h5 h6".split(), "\n"), "td": " ", "th": " "}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INVISIBLE = re.compile(r"display:none|visibility:hidden|font-size:0|opacity:0")

NODE = "struct<pre:int,end:int,level:int,parent:int,nth:int,name:string,attributes:map<string,string>,start:int,stop:int>"
PIECE = "struct<at:int,text:string,skip:int,hide:int>"
TREE = f"struct<nodes:array<{NODE}>,pieces:array<{PIECE}>>"
_NODE = pa.struct([(k, pa.int32()) for k in ("pre", "end", "level", "parent", "nth")] + [("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("stop", pa.int32())])
_PIECE = pa.struct([("at", pa.int32()), ("text", pa.string()), ("skip", pa.int32()), ("hide", pa.int32())])
_TREE = pa.struct([("nodes", pa.list_(_NODE)), ("pieces", pa.list_(_PIECE))])


class _Builder:
    """Nodes and pieces of text. A piece knows the innermost element around it whose text is unread, and that is invisible (-1: none)."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.pieces: list[dict] = []
        self.stack: list[int] = []
        self.around: list[tuple[int, int]] = []  # of each node: itself or what is around it
        self.seen: list[dict[str, int]] = []  # of each node: how many children of a name so far

    def open(self, name: str, attributes: dict[str, str], start: int, stop: int) -> None:
        pre, parent = len(self.nodes), self.stack[-1] if self.stack else -1
        nth = 1
        if self.stack:
            nth = self.seen[parent][name] = self.seen[parent].get(name, 0) + 1
        skip, hide = self.around[parent] if self.stack else (-1, -1)
        if "hidden" in attributes or INVISIBLE.search(attributes.get("style", "").lower().replace(" ", "")):
            hide = pre
        self.around.append((pre if name in UNREAD else skip, hide))
        self.seen.append({})
        self.nodes.append({"pre": pre, "end": pre, "level": len(self.stack), "parent": parent, "nth": nth, "name": name, "attributes": list(attributes.items()), "start": start, "stop": stop})
        self.stack.append(pre)

    def close(self, stop: int) -> None:
        node = self.nodes[at := self.stack.pop()]
        node["end"], node["stop"] = len(self.nodes) - 1, stop
        if mark := BREAKS.get(node["name"]):
            self.text(mark, at)

    def text(self, text: str, at: int) -> None:
        self.pieces.append({"at": at, "text": text, "skip": self.around[at][0], "hide": self.around[at][1]})

    def names(self) -> list[str]:
        return [self.nodes[i]["name"] for i in self.stack]

    def end(self, ended: set[str], shields: set[str], stop: int) -> None:
        """Close the innermost of `ended` with what is inside it, unless one of `shields` is around."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[depth]]["name"]
            if name in ended:
                while len(self.stack) > depth:
                    self.close(stop)
                return
            if name in shields:
                return

    def place(self, name: str | None, at: int) -> None:
        """Open what a page may leave out around an element or text: html, head, body."""
        if not self.stack:
            self.open("html", {}, at, at)
        names = self.names()
        if names[-1] == "head" and name not in HEAD:
            self.close(at)
            names.pop()
        if len(names) == 1 and "body" not in self.seen[0]:
            early = name in HEAD and "head" not in self.seen[0]
            self.open("head" if early else "body", {}, at, at)
        elif len(names) == 1:  # after the body's end
            body = next(x["pre"] for x in self.nodes if x["name"] == "body" and x["level"] == 1)
            self.stack.append(body)


def build(page: str) -> dict:
    b, at = _Builder(), 0
    while m := TOKEN.match(page, at):
        start, at = at, m.end()
        name = m[2] and m[2].lower()
        if not name:
            if m[0].startswith(("<!", "<?")):
                continue
            if b.stack[1:] or m[0].strip():
                b.place(None, start) if m[0].strip() else None
                b.text(entities.unescape(m[0]), b.stack[-1])
            continue
        if m[1]:
            names = b.names()
            if name in ("html", "body") or name not in names:
                continue
            inner = names[len(names) - names[::-1].index(name) :]
            if name not in BLOCKS | set(ENDED) | {"head"} and any(x in BLOCKS | {"td", "th"} for x in inner):
                continue  # an inline element doesn't end across a block
            b.end({name}, set(), at)
            continue
        attributes: dict[str, str] = {}
        for x in ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(x[1].lower(), entities.unescape(x[2] or x[3] or x[4] or ""))
        if name in ("html", "body", "head"):
            if name == "html" and not b.stack:
                b.open("html", attributes, start, at)
                continue
            if not b.stack:
                b.open("html", {}, start, start)
            known = next((x for x in b.nodes if x["name"] == name and x["level"] < 2), None)
            if known is not None:
                known["attributes"] = list({**attributes, **dict(known["attributes"])}.items())
                continue
            if name == "body" and b.names()[-1] == "head":
                b.close(start)
            if len(b.stack) == 1:
                b.open(name, attributes, start, at)
            continue
        b.place(name, start)
        if name in BLOCKS:
            b.end({"p"}, SCOPE, start)
        if name in ENDED:
            b.end(*ENDED[name], start)
        b.open(name, attributes, start, at)
        if name in VOID or m[3].endswith("/"):
            b.close(at)
        elif name in RAW | REFERENCED:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            b.text(entities.unescape(inner) if name in REFERENCED else inner, b.stack[-1])
            at = end.end() if end else len(page)
            b.close(at)
    while b.stack:
        b.close(len(page))
    return {"nodes": b.nodes, "pieces": b.pieces}


HELD = 1 << 20  # characters of pages whose nodes are Python objects at once


def _trees(pages: pa.Array, held: int = HELD) -> pa.Array:
    """Trees of pages, turned into Arrow whenever `held` characters have been read, so that a batch of many pages needs no more objects."""
    done, part, size = [], [], 0
    for page in pages:
        page = page.as_py()
        part.append(None if page is None else build(page))
        size += len(page or "")
        if size >= held:
            done.append(pa.array(part, _TREE))
            part, size = [], 0
    return pa.concat_arrays([*done, pa.array(part, _TREE)])


def tree(page: Column | str) -> Column:
    """struct(nodes, pieces) of a page; null for null. Elements that may be left out (html, body, ends of paragraphs and items) are filled in."""

    @F.arrow_udf(TREE)
    def built(x: pa.Array) -> pa.Array:
        return _trees(x)

    return built(page)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


AXES: dict[str, Callable[[Column, Column], Column]] = {
    "child": lambda n, c: n["parent"] == c["pre"],
    "parent": lambda n, c: n["pre"] == c["parent"],
    "self": lambda n, c: n["pre"] == c["pre"],
    "descendant": lambda n, c: (n["pre"] > c["pre"]) & (n["pre"] <= c["end"]),
    "descendant-or-self": lambda n, c: (n["pre"] >= c["pre"]) & (n["pre"] <= c["end"]),
    "ancestor": lambda n, c: (n["pre"] < c["pre"]) & (n["end"] >= c["pre"]),
    "ancestor-or-self": lambda n, c: (n["pre"] <= c["pre"]) & (n["end"] >= c["pre"]),
    "following": lambda n, c: n["pre"] > c["end"],
    "preceding": lambda n, c: n["end"] < c["pre"],
    "following-sibling": lambda n, c: (n["parent"] == c["parent"]) & (n["pre"] > c["pre"]),
    "preceding-sibling": lambda n, c: (n["parent"] == c["parent"]) & (n["pre"] < c["pre"]),
}


def pick(t: Column, name: str = "*", of: Column | None = None, axis: str = "descendant", test: Callable[[Column], Column] | None = None) -> Column:
    """One step: nodes of a name on an axis of the nodes `of` (None: of the whole page), each once, in document order. `test` takes a node; its
    `nth` is its place among its siblings of the same name. Null for no tree."""

    def named(n: Column) -> Column:
        parts = F.lit(True) if name == "*" else n["name"] == name
        return parts & F.coalesce(test(n), F.lit(False)) if test else parts

    if of is None:
        return F.filter(t["nodes"], named)
    return _bound(of, lambda context: F.filter(t["nodes"], lambda n: named(n) & F.exists(context, lambda c: AXES[axis](n, c))))


def _text(t: Column, n: Column, shown: bool) -> Column:
    here = lambda p: (p["at"] >= n["pre"]) & (p["at"] <= n["end"]) & (p["skip"] < n["pre"])
    held = F.filter(t["pieces"], (lambda p: here(p) & (p["hide"] < n["pre"])) if shown else here)
    lines = F.transform(F.split(F.array_join(F.transform(held, lambda p: p["text"]), ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def inner_text(t: Column, nodes: Column) -> Column:
    """array of each node's text, a line for each block."""
    return F.transform(nodes, lambda n: _text(t, n, False))


def display_text(t: Column, nodes: Column) -> Column:
    """array of each node's text without what is invisible inside it."""
    return F.transform(nodes, lambda n: _text(t, n, True))


def links(t: Column, nodes: Column) -> Column:
    """array of arrays of struct(href, url, text): the anchors in or at each node that lead anywhere."""

    def inside(n: Column) -> Column:
        anchors = F.filter(t["nodes"], lambda a: (a["name"] == "a") & AXES["descendant-or-self"](a, n) & F.map_contains_key(a["attributes"], "href"))
        return F.transform(anchors, lambda a: F.struct(F.trim(a["attributes"]["href"]).alias("href"), S.parse_url(F.trim(a["attributes"]["href"])).alias("url"), _text(t, a, False).alias("text")))

    return F.transform(nodes, inside)


def details(t: Column, page: Column, nodes: Column) -> Column:
    """array of struct(raw, inner_text, display_text, links): raw as it is written in the page."""
    raw = F.transform(nodes, lambda n: F.substring(page, n["start"] + 1, n["stop"] - n["start"]))
    parts = F.arrays_zip(raw.alias("raw"), inner_text(t, nodes).alias("inner_text"), display_text(t, nodes).alias("display_text"), links(t, nodes).alias("links"))
    return F.when(t.isNotNull(), parts)
