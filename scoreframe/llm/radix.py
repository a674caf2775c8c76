"""An adaptive radix tree over byte strings: nodes of four sizes, paths compressed."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to 4, or up to 16, children: their bytes in order beside them."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int):
        self.keys, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        place = self.keys.find(byte)
        return None if place < 0 else self.nodes[place]

    def full(self) -> bool:
        return len(self.keys) == self.room

    def put(self, byte: int, node: Node) -> None:
        place = bisect_left(self.keys, byte)
        if place < len(self.keys) and self.keys[place] == byte:
            self.nodes[place] = node
        else:
            self.keys.insert(place, byte)
            self.nodes.insert(place, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes)


class Indexed:
    """Up to 48 children, found through a table of 256 bytes."""

    __slots__ = ("places", "nodes")
    NONE = 255

    def __init__(self):
        self.places, self.nodes = bytearray([self.NONE]) * 256, []

    def get(self, byte: int) -> Node | None:
        place = self.places[byte]
        return None if place == self.NONE else self.nodes[place]

    def full(self) -> bool:
        return len(self.nodes) == 48

    def put(self, byte: int, node: Node) -> None:
        if self.places[byte] != self.NONE:
            self.nodes[self.places[byte]] = node
        else:
            self.places[byte] = len(self.nodes)
            self.nodes.append(node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[place]) for b, place in enumerate(self.places) if place != self.NONE)


class Direct:
    """Up to 256 children, each in the place of its byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def full(self) -> bool:
        return False

    def put(self, byte: int, node: Node) -> None:
        self.nodes[byte] = node

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


def _larger(children: Sorted | Indexed) -> Sorted | Indexed | Direct:
    if isinstance(children, Indexed):
        wider: Sorted | Indexed | Direct = Direct()
    else:
        wider = Sorted(16) if children.room == 4 else Indexed()
    for byte, node in children.items():
        wider.put(byte, node)
    return wider


class Node:
    """`path`: the bytes from the parent down to here; `values`: what keys that end here hold."""

    __slots__ = ("path", "values", "children")

    def __init__(self, path: bytes = b"", values: list | None = None):
        self.path, self.values = path, values if values is not None else []
        self.children: Sorted | Indexed | Direct | None = None

    def child(self, byte: int) -> Node | None:
        return self.children and self.children.get(byte)

    def put(self, node: Node) -> None:
        """Add the child, or replace that of the same first byte; full nodes grow."""
        byte = node.path[0]
        if self.children is None:
            self.children = Sorted(4)
        elif self.children.full() and self.children.get(byte) is None:
            self.children = _larger(self.children)
        self.children.put(byte, node)

    def nodes(self) -> list[Node]:
        return [node for _, node in self.children.items()] if self.children else []


def insert(root: Node, key: bytes, value: object) -> None:
    """Add `value` to the values of `key`."""
    node, at = root, 0
    while at < len(key):
        below = node.child(key[at])
        if below is None:
            node.put(Node(key[at:], [value]))
            return
        met = common(below.path, key, at)
        if met < len(below.path):  # the path is split where the keys part
            upper = Node(below.path[:met])
            below.path = below.path[met:]
            upper.put(below)
            node.put(upper)
            below = upper
        node, at = below, at + met
    node.values.append(value)


def common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of `path` stand in `key` from `at` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(path[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low
