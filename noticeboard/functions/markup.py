"""The one HTML kernel: pick cards and their fields out of a page.

A page becomes an array with one entry per card; an entry maps each requested
field to the elements that matched it, in document order, as attributes plus
text. Everything that *decides* anything (dates, places, agreement) happens
afterwards in native expressions, so this file only walks tags.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

PIECE = 32                  # pages whose cards are held as Python objects at once
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:([*^~]?)=[\"']?([^\"'\]]*)[\"']?)?\]")

ELEMENT = T.StructType([T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("text", T.StringType()), T.StructField("joined", T.StringType())])
CARDS = T.ArrayType(T.MapType(T.StringType(), T.ArrayType(ELEMENT)))
_ARROW_ELEMENT = pa.struct([("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("joined", pa.string())])
_ARROW_CARDS = pa.list_(pa.map_(pa.string(), pa.list_(_ARROW_ELEMENT)))


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in ("script", "style", "template"):
                stack.extend(reversed(item.children))

    def own_script(self):
        return "".join(c for c in self.children if isinstance(c, str))

    def walk(self):
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def updatepos(self, i, j):
        return j                # lines and columns are never asked for

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def _tree(markup: str) -> _Node:
    parser = _Tree()
    parser.feed(markup or "")
    parser.close()
    return parser.root


def fragment_text(markup: str) -> str:
    """Text of a fragment, its pieces joined by spaces."""
    return " ".join(_tree(markup).strings())


def _compile(selector: str):
    """``a.b[c] d, e`` -> alternatives of chains of (tag, classes, id, attribute tests)."""
    out = []
    for part in selector.split(","):
        chain = []
        for step in part.split():
            tag, classes, ident, attrs = None, [], None, []
            for m in _SIMPLE.finditer(step):
                if m[1] and m[1] != "*":
                    tag = m[1].lower()
                elif m[2]:
                    classes.append(m[2])
                elif m[3]:
                    ident = m[3]
                elif m[4]:
                    attrs.append((m[4].lower(), m[5], m[6]))
            chain.append((tag, classes, ident, attrs))
        out.append(chain)
    return out


def _fits(node, step) -> bool:
    tag, classes, ident, attrs = step
    if tag and node.tag != tag or ident and node.attrs.get("id") != ident:
        return False
    own = node.attrs.get("class", "").split() if classes else ()
    if any(c not in own for c in classes):
        return False
    for name, op, want in attrs:
        have = node.attrs.get(name)
        if have is None:
            return False
        if want is not None and not (want in have if op == "*" else have.startswith(want) if op == "^"
                                     else want in have.split() if op == "~" else have == want):
            return False
    return True


def _matches(node, alternatives, top) -> bool:
    for chain in alternatives:
        if not _fits(node, chain[-1]):
            continue
        rest, up = list(chain[:-1]), node.parent
        while rest and up is not None and up is not top.parent:
            if _fits(up, rest[-1]):
                rest.pop()
            up = up.parent
        if not rest:
            return True
    return False


def _by_mark(selectors: dict) -> dict:
    """(name, selector) of every field under one thing its last step asks of a node, so that a node is tested against few of them: a class, an id, a tag, an attribute, or None."""
    marks = {}
    for name, alternatives in selectors.items():
        for chain in alternatives:
            tag, classes, ident, attrs = chain[-1]
            mark = ("class", classes[0]) if classes else ("id", ident) if ident else ("tag", tag) if tag else ("attr", attrs[0][0]) if attrs else None
            marks.setdefault(mark, []).append((name, [chain]))
    return marks


def _fields_of(node, marks: dict, top) -> set:
    """Names of the fields whose selectors match the node."""
    attrs = node.attrs
    own = [None, ("tag", node.tag)]
    if attrs:
        own += [("attr", name) for name in attrs]
        if "class" in attrs:
            own += [("class", c) for c in attrs["class"].split()]
        if "id" in attrs:
            own.append(("id", attrs["id"]))
    return {name for mark in own if mark in marks for name, chain in marks[mark] if _matches(node, chain, top)}


def _element(node):
    if node.tag == "script":
        text = joined = node.own_script()
    else:
        parts = list(node.strings())
        text, joined = " ".join(" ".join(parts).split()), " ".join("".join(parts).split())
    return {"attrs": list(node.attrs.items()), "text": text, "joined": joined}


def in_pieces(batches, one):
    """``one`` of every value of every batch, a few rows at a time: a page's cards are many times its size, and Spark's batches hold thousands of pages."""
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            yield batch.iloc[at:at + PIECE].map(one)
        if not len(batch):
            yield batch.map(one)


def card_fields(body: Column, card: str | None, fields: dict[str, str]) -> Column:
    """Arrow kernel: for each ``card`` match (or the whole page), the matches of every field.

    The field ``""`` is the card element itself. ``text`` joins pieces with
    spaces, ``joined`` without.
    """
    card_sel = _compile(card) if card else None
    marks = _by_mark({name: _compile(sel) for name, sel in fields.items() if sel})

    def one(markup):
        root = _tree(markup)
        cards = [n for n in root.walk() if _matches(n, card_sel, root)] if card_sel else [root]
        out = []
        for c in cards:
            found = {name: [] for name in fields}
            if "" in found:
                found[""].append(_element(c))
            for node in c.walk():
                names = _fields_of(node, marks, c)
                if names:
                    element = _element(node)
                    for name in names:
                        found[name].append(element)
            out.append(list(found.items()))
        return out

    @F.arrow_udf(CARDS)
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in in_pieces((pd.Series(batch.to_pylist(), dtype=object) for batch in batches), one):
            yield pa.array(piece.tolist(), _ARROW_CARDS)

    return kernel(body)


def first_text(field: Column) -> Column:
    """Text of a field's first match, or null."""
    return F.try_element_at(field, F.lit(1))["text"]


def first_attr(field: Column, name: str) -> Column:
    return F.try_element_at(F.try_element_at(field, F.lit(1))["attrs"], F.lit(name))
