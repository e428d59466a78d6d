"""A page's rows as a small tree, for selectors that are looked up one page at a time."""

from __future__ import annotations

import re

from .markup import tokenize


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip=frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip or node is self:
                stack += reversed(node.children)
        return "".join(out)


def build_tree(html: str | None) -> Node:
    root = Node("#root", {}, None)
    made = {-1: root}
    for pos, _, parent, _, _, tag, attrs, _, text, _ in tokenize(html, None):
        above = made[parent]
        if text is None:
            made[pos] = Node(tag, attrs, above)
        above.children.append(made[pos] if text is None else text)
    return root


def squeeze(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()
