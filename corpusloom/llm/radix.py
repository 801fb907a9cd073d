"""An adaptive radix tree over byte keys of whole fixed-width units, and the trie nodes at unit borders.

Nodes grow through four layouts: up to 4 and up to 16 children as sorted bytes beside a list, up to 48
through an index of 256 slots, beyond that one place per byte. Chains without branches are one node with
the bytes they share (path compression). A key may be the beginning of another; a node holds the value of
the key that ends at it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """``prefix`` leads from the parent's byte to this node; ``value`` belongs to the key that ends here."""

    __slots__ = ("children", "index", "keys", "prefix", "value")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.keys: bytearray | None = bytearray()  # layouts of 4 and 16: sorted bytes
        self.index: bytearray | None = None  # layout of 48: place + 1 by byte
        self.children: list = []  # layout of 256 (no keys, no index): by byte

    def child(self, byte: int) -> Node | None:
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.index is not None:
            return self.children[self.index[byte] - 1] if self.index[byte] else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child of ``byte``, growing to the next layout where this one is full."""
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.children[at] = node
            elif len(self.keys) < 16:
                self.keys.insert(at, byte)
                self.children.insert(at, node)
            else:
                self.index = bytearray(256)
                for place, key in enumerate(self.keys):
                    self.index[key] = place + 1
                self.keys = None
                self.put(byte, node)
        elif self.index is not None:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
            else:
                wide: list = [None] * 256
                for key, place in enumerate(self.index):
                    if place:
                        wide[key] = self.children[place - 1]
                self.children, self.index = wide, None
                self.children[byte] = node
        else:
            self.children[byte] = node

    def layout(self) -> int:
        if self.keys is not None:
            return 4 if len(self.keys) <= 4 else 16
        return 48 if self.index is not None else 256

    def each(self) -> Iterator[Node]:
        """The children by byte."""
        if self.keys is not None:
            yield from self.children
        elif self.index is not None:
            yield from (self.children[place - 1] for place in self.index if place)
        else:
            yield from (node for node in self.children if node is not None)


class RadixTree:
    """Keys are whole units of ``width`` bytes; the empty key is the root."""

    def __init__(self, width: int):
        self.width, self.root = width, Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Add a key; ``value`` takes the place of an earlier one."""
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], value))
                return
            shared, most = 0, min(len(below.prefix), len(key) - at)
            if key.startswith(below.prefix, at):
                shared = len(below.prefix)
            else:
                while shared < most and below.prefix[shared] == key[at + shared]:
                    shared += 1
            if shared < len(below.prefix):
                upper = Node(below.prefix[:shared])
                below.prefix = below.prefix[shared:]
                upper.put(below.prefix[0], below)
                node.put(key[at], upper)
                below = upper
            node, at = below, at + shared
        node.value = value

    def walk(self) -> Iterator[tuple[Node, int, bool]]:
        """Every node with the byte depth at which it begins; first on the way down (False), then on the
        way up (True), children by byte."""
        stack = [(self.root, 0, False)]
        while stack:
            node, begin, up = stack.pop()
            yield node, begin, up
            if not up:
                stack.append((node, begin, True))
                end = begin + len(node.prefix)
                stack.extend((child, end, False) for child in reversed(list(node.each())))

    def borders(self, node: Node, begin: int) -> range:
        """The byte depths of whole units that end in the node's prefix; the root has depth 0."""
        end = begin + len(node.prefix)
        return range(begin - begin % self.width + self.width if node is not self.root else 0, end + 1, self.width)
