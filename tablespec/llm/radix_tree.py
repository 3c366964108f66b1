"""An adaptive radix tree over byte keys: nodes grow with their children, chains of single children are one node.

A key may be a prefix of another. ``walk`` gives the nodes in the order of their keys.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Few:
    """Up to 4 or 16 children: their bytes in order beside them."""

    __slots__ = ("bytes", "nodes", "size")

    def __init__(self, size: int = 4):
        self.bytes, self.nodes, self.size = bytearray(), [], size

    def get(self, b: int) -> Node | None:
        k = self.bytes.find(b)
        return self.nodes[k] if k >= 0 else None

    def put(self, b: int, node: Node):
        """The layout that holds the new child too: this one or the next larger."""
        if len(self.nodes) == self.size:
            grown = Few(16) if self.size == 4 else Indexed()
            for x, child in self:
                grown.put(x, child)
            return grown.put(b, node)
        k = bisect_left(self.bytes, b)
        self.bytes.insert(k, b)
        self.nodes.insert(k, node)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)

    def __len__(self) -> int:
        return len(self.nodes)


class Indexed:
    """Up to 48 children: 256 bytes give each child's place among them."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, b: int) -> Node | None:
        k = self.places[b]
        return self.nodes[k - 1] if k else None

    def put(self, b: int, node: Node):
        if len(self.nodes) == 48:
            grown = Full()
            for x, child in self:
                grown.put(x, child)
            return grown.put(b, node)
        self.nodes.append(node)
        self.places[b] = len(self.nodes)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[k - 1]) for b, k in enumerate(self.places) if k)

    def __len__(self) -> int:
        return len(self.nodes)


class Full:
    """A place for each of 256 children."""

    __slots__ = ("nodes", "held")

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256
        self.held = 0

    def get(self, b: int) -> Node | None:
        return self.nodes[b]

    def put(self, b: int, node: Node):
        self.held += self.nodes[b] is None
        self.nodes[b] = node
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)

    def __len__(self) -> int:
        return self.held


class Node:
    """Bytes after the one that leads here, the children, and the values of the key that ends here.

    ``some`` is the value of one key through this node."""

    __slots__ = ("prefix", "kids", "values", "some")

    def __init__(self, prefix: bytes, some, kids=None, values: list | None = None):
        self.prefix, self.some, self.values = prefix, some, values or []
        self.kids = Few() if kids is None else kids


def common(a: bytes, b: bytes) -> int:
    """The number of equal leading bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root = Node(b"", None)

    def add(self, key: bytes, value) -> None:
        node, at = self.root, 0
        if node.some is None:
            node.some = value
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                n = common(prefix, key[at : at + len(prefix)])
                lower = Node(prefix[n + 1 :], node.some, node.kids, node.values)
                node.kids, node.values = Few().put(prefix[n], lower), []
                node.prefix = prefix = prefix[:n]
            at += len(prefix)
            if at == len(key):
                node.values.append(value)
                return
            child = node.kids.get(key[at])
            if child is None:
                node.kids = node.kids.put(key[at], Node(key[at + 1 :], value, values=[value]))
                return
            node, at = child, at + 1

    def walk(self) -> Iterator[tuple[Node, int, int, int]]:
        """(node, number of its parent in this walk or -1, bytes before it, bytes with it), parents first, in the order of keys."""
        stack, number = [(self.root, -1, 0)], 0
        while stack:
            node, parent, before = stack.pop()
            upto = before + (parent >= 0) + len(node.prefix)
            yield node, parent, before, upto
            stack += [(child, number, upto) for _, child in reversed(list(node.kids))]
            number += 1
