"""A small document tree over the standard library's HTML parser, with what the page operators ask of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag of the key closes open elements of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    __slots__ = ("attrs", "items", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in order; without recursion, for pages may nest deeply."""
        stack = [iter(self.items)]
        while stack:
            for item in stack[-1]:
                if isinstance(item, Node):
                    yield item
                    stack.append(iter(item.items))
                    break
            else:
                stack.pop()

    def strings(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        stack = [iter(self.items)]
        while stack:
            for item in stack[-1]:
                if isinstance(item, str):
                    yield item
                elif item.tag not in without:
                    stack.append(iter(item.items))
                    break
            else:
                stack.pop()

    def text(self, separator: str = "", without: frozenset[str] = frozenset()) -> str:
        return separator.join(s for s in (x.strip() for x in self.strings(without)) if s)

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self._open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._open[-1].tag in CLOSES.get(tag, ()):
            self._open.pop()
        node = Node(tag, {})
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self._open[-1].items.append(node)
        if tag not in VOID:
            self._open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                del self._open[i:]
                return

    def handle_data(self, data: str) -> None:
        self._open[-1].items.append(data)


#: Scripts and styles, which hold no references, and what may begin a reference elsewhere.
_REFERENCE = re.compile(r"<(script|style)\b.*?</\1\s*>|&(#\d+;|#x[0-9a-f]+;|[a-z][a-z0-9]*;)?", re.IGNORECASE | re.DOTALL)


def _closed(found: re.Match) -> str:
    name = found[2] or ""
    return found[0] if found[1] or name[:1] == "#" or name in html5 else "&amp;" + name


def parse(html: str | None, closed: bool = False) -> Node:
    """``closed``: only references that a semicolon ends are read, others stay as they are written."""
    builder = _Builder()
    builder.feed(_REFERENCE.sub(_closed, html or "") if closed else html or "")
    builder.close()
    return builder.root
