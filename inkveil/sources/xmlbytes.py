"""A light tree of an XML part that knows where its elements stand in the bytes, and edits that touch nothing else."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

from inkveil.functions import catalogue as c

_OPEN_TAG = re.compile(rb"""<([^\s/>]+)((?:\s+[^\s=>]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*/?>""")
_ATTRIBUTE = re.compile(rb"""\s+([^\s=>]+)\s*=\s*("[^"]*"|'[^']*')""")


class Malformed(Exception):
    """Not well-formed, too deep, with a document type, or edits that do not fit."""


@dataclass(eq=False)
class Node:
    """tag and attribute names are 'namespace}local', or 'local' alone."""

    tag: str
    attributes: dict[str, str]
    begin: int
    parent: Node | None = None
    end: int = 0
    children: list[Node] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def local(self) -> str:
        return self.tag.rpartition("}")[2]


def parse(data: bytes) -> Node:
    """The root element. Document types and entities are refused, and so is any nesting beyond the limit."""
    top = Node("", {}, 0)
    stack, parser = [top], expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True

    def refuse(*_: object) -> None:
        raise Malformed("document type")

    def opened(tag: str, attributes: dict[str, str]) -> None:
        if len(stack) > c.MAX_DEPTH + 1:
            raise Malformed("depth")
        node = Node(tag, attributes, parser.CurrentByteIndex, stack[-1])
        stack[-1].children.append(node)
        stack.append(node)

    def closed(_: str) -> None:
        node, at = stack.pop(), parser.CurrentByteIndex
        start = None if node.children or node.texts else _OPEN_TAG.match(data, node.begin)
        node.end = start.end() if start and start.group().endswith(b"/>") else data.find(b">", at) + 1

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    parser.CharacterDataHandler = lambda text: stack[-1].texts.append(text)
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as error:
        raise Malformed(str(error)) from error
    return top.children[0]


class Edits:
    """Splices of a part's bytes. An edit inside a deleted element goes with it."""

    def __init__(self, data: bytes, root: Node) -> None:
        if not re.match(rb"""(?:\xef\xbb\xbf)?(?:<\?xml(?![^>]*encoding\s*=)|<\?xml[^>]*encoding\s*=\s*["'](?i:utf-8|us-ascii)["']|<[^?])""", data):
            raise Malformed("encoding")
        self.data, self.root, self.splices = data, root, []

    def _open(self, node: Node) -> re.Match[bytes]:
        found = _OPEN_TAG.match(self.data, node.begin)
        if not found:
            raise Malformed("tag")
        return found

    def delete(self, node: Node) -> None:
        self.splices.append((node.begin, node.end, b""))

    def unwrap(self, node: Node) -> None:
        start = self._open(node)
        self.splices.append((start.start(), start.end(), b""))
        if start.end() < node.end:
            self.splices.append((self.data.rindex(b"</", 0, node.end), node.end, b""))

    def write(self, node: Node, text: str) -> None:
        """Replace all that a text element holds."""
        name = self._open(node).group(1)
        body = escape(text, {"\r": "&#13;"}).encode()
        self.splices.append((node.begin, node.end, b"<" + name + b' xml:space="preserve">' + body + b"</" + name + b">"))

    def drop_attributes(self, node: Node, names: set[str]) -> None:
        """Attributes whose local name is among names."""
        start = self._open(node)
        for x in _ATTRIBUTE.finditer(self.data, start.start(2), start.end(2)):
            if x.group(1).decode().rpartition(":")[2] in names:
                self.splices.append((x.start(), x.end(), b""))

    def apply(self) -> bytes:
        out, at = [], 0
        for begin, end, new in sorted(set(self.splices), key=lambda s: (s[0], -s[1])):
            if begin < at:
                if end > at:
                    raise Malformed("edits overlap")
                continue
            out += [self.data[at:begin], new]
            at = end
        return b"".join([*out, self.data[at:]])
