"""A small document tree over the standard library's HTML tokeniser.

Paragraphs and list items end where HTML implies it; other unclosed elements end
with their parent. Character references are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Open elements that end where one of the same kind begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"[ \t]{2,}")
_LINES = re.compile(r"\s*\n\s*")
_INVISIBLE = re.compile("[​-‏‪-‮⁦-⁩]")


def normalize(text: str) -> str:
    """As ``text.normalize``, for one string."""
    text = _INVISIBLE.sub("", text.replace(" ", " "))
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


class Node:
    """An element with attributes and ordered children, which are nodes or strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n is not self and test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def raw_text(self) -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def text(self) -> str:
        return normalize(self.raw_text())

    def without(self, junk: Callable[[Node], bool]) -> Node:
        """A copy from which the elements that are junk are gone."""
        root = Node(self.tag, self.attrs, None)
        stack = [(self, root)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                if isinstance(c, str):
                    new.children.append(c)
                elif not junk(c):
                    kid = Node(c.tag, c.attrs, new)
                    new.children.append(kid)
                    stack.append((c, kid))
        return root


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.at = self.root

    def _close_open(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        node: Node | None = self.at
        while node is not None and node.tag not in stop:
            if node.tag in tags and node.parent is not None:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close_open({"p"}, frozenset({"#document", "td", "th", "button"}))
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag], frozenset({"#document", "ul", "ol", "dl", "table", "select"}))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; null and empty pages give an empty document."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# Tests of elements, from which selectors are made.


def tag(*names: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in names


def ident(value: str) -> Callable[[Node], bool]:
    return lambda n: n.get("id") == value


def has(attr: str, part: str, *tags: str) -> Callable[[Node], bool]:
    return lambda n: part in n.get(attr) and (not tags or n.tag in tags)


def inside(outer: Callable[[Node], bool], inner: Callable[[Node], bool]) -> Callable[[Node], bool]:
    """Elements that pass ``inner`` and have an ancestor that passes ``outer``."""

    def test(n: Node) -> bool:
        if not inner(n):
            return False
        up = n.parent
        while up is not None:
            if outer(up):
                return True
            up = up.parent
        return False

    return test


def either(*tests: Callable[[Node], bool]) -> Callable[[Node], bool]:
    return lambda n: any(t(n) for t in tests)
