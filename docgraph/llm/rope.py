"""Ropes: texts as balanced trees whose leaves know how many units and code points they hold.

A unit is what a text may be cut between: a code point, or a match of a pattern. Splitting at a rank and joining change
O(log n) nodes, and share all others with the ropes that they came from; no text is copied but that of the leaf that is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

#: Code points of a leaf.
LEAF = 1 << 12


class Leaf:
    """A piece of text; ends: where its units end in it (None: after each code point)."""

    __slots__ = ("text", "ends", "units", "points", "height")

    def __init__(self, text: str, ends: list[int] | None = None):
        self.text, self.ends, self.height = text, ends, 0
        self.points = len(text)
        self.units = self.points if ends is None else len(ends)

    def cut(self, rank: int, by_units: bool) -> tuple[Leaf, Leaf]:
        """Both sides of a rank; a unit whose end lies behind it belongs to the right side."""
        if self.ends is None:
            return Leaf(self.text[:rank]), Leaf(self.text[rank:])
        k = rank if by_units else bisect_left(self.ends, rank + 1)
        at = (self.ends[k - 1] if k else 0) if by_units else rank
        return Leaf(self.text[:at], self.ends[:k]), Leaf(self.text[at:], [e - at for e in self.ends[k:]])


class Node:
    """Two ropes in a row, with the sums of what they hold."""

    __slots__ = ("left", "right", "units", "points", "height")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node


def build(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
    """The rope of a text, whose units are the matches of `unit` and what lies between them (None: code points)."""
    if unit is None:
        leaves = [Leaf(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    else:
        leaves, begin, ends = [], 0, []
        for end in _ends(text, unit):
            ends.append(end - begin)
            if end - begin >= leaf:
                leaves.append(Leaf(text[begin:end], ends))
                begin, ends = end, []
        if ends:
            leaves.append(Leaf(text[begin:], ends))
    level: list[Rope] = leaves or [Leaf("", None if unit is None else [])]
    while len(level) > 1:
        level = [Node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _ends(text: str, unit: re.Pattern) -> Iterator[int]:
    last = 0
    for m in unit.finditer(text):
        if m.start() > last:
            yield m.start()
        if m.end() > max(last, m.start()):
            yield m.end()
        last = max(last, m.end())
    if last < len(text):
        yield len(text)


def _node(left: Rope, right: Rope) -> Rope:
    """A node, turned if its sides differ by two levels."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def join(left: Rope, right: Rope) -> Rope:
    """Both in a row; the lower one is hung where the other is as low."""
    if not left.points:
        return right
    if not right.points:
        return left
    if left.height > right.height + 1:
        return _node(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _node(join(left, right.left), right.right)
    return Node(left, right)


def split(rope: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """What stands before a rank, counted in units or in code points, and what stands after it."""
    if isinstance(rope, Leaf):
        return rope.cut(rank, by_units)
    inside = rope.left.units if by_units else rope.left.points
    if rank < inside:
        left, right = split(rope.left, rank, by_units)
        return left, join(right, rope.right)
    left, right = split(rope.right, rank - inside, by_units)
    return join(rope.left, left), right


def leaves(rope: Rope) -> Iterator[Leaf]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, Leaf):
            yield top
        else:
            stack += [top.right, top.left]


def text_of(rope: Rope) -> str:
    return "".join([leaf.text for leaf in leaves(rope)])


def find(rope: Rope, what: str) -> int:
    """The code-point rank of the first `what`, or -1; it may lie across leaves."""
    tail, base = "", 0
    for leaf in leaves(rope):
        window = tail + leaf.text
        at = window.find(what)
        if at >= 0:
            return base - len(tail) + at
        base += leaf.points
        tail = window[max(0, len(window) - len(what) + 1) :] if len(what) > 1 else ""
    return -1


def concat(*ropes: Rope) -> Rope:
    return list(accumulate(ropes, join))[-1]
