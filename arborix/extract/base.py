"""Shared parts of the hand-written parsers: nodes, faults, bracket matching and the memo of accepted statements.

The parsers are recursive-descent on statements and precedence-climbing on expressions. They never stop at a fault: the fault is stored, tokens
are skipped up to the next point where a statement may begin (panic mode), and parsing goes on, so one parse yields every fault and a usable
tree of the rest.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from dataclasses import dataclass, field

#: Python frames that a parse may stack up. Calls between Python functions live on the heap, so nesting is bounded by memory and not by a rule of
#: ours: this is some 100 000 levels of brackets, statements or operators within each other.
FRAMES = 1_500_000


def allow_depth() -> None:
    """Let this process follow nesting to any depth that a file may have."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)


class Fault(Exception):
    """A syntax error at a character offset."""

    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at, self.what = at, what


class Node:
    """t: kind; s, e: character offsets; k: child nodes; v: name or other payload; f: named children."""

    __slots__ = ("t", "s", "e", "k", "v", "f")

    def __init__(self, t, s, e, k=(), v=None, f=None):
        self.t, self.s, self.e, self.k, self.v, self.f = t, s, e, k, v, f

    def __repr__(self):
        return f"{self.t}[{self.s}:{self.e}]" + (f"({self.v})" if self.v is not None else "")


@dataclass
class Tokens:
    """kind: the text itself for punctuation and reserved words, else the class of the token; match: index of the partner of a bracket, or -1."""

    kind: list = field(default_factory=list)
    start: list = field(default_factory=list)
    end: list = field(default_factory=list)
    nl: list = field(default_factory=list)
    match: list = field(default_factory=list)
    key: str = ""
    bad: list = field(default_factory=list)


@dataclass
class Parsed:
    """faults: (offset, message) in the order of the text; tree: the root node."""

    faults: list
    tree: Node | None


class Memo:
    """Token-class sequences of statements that were parsed without fault, so that a shape is parsed once and not once per occurrence.

    Grammar decisions depend on token classes, line breaks and the words in the key only, so a sequence accepted once is accepted always in the
    same context. The store is emptied when full; that changes the time taken and nothing else.
    """

    LIMIT = 200_000

    def __init__(self):
        self.seen: set = set()

    def add(self, key) -> None:
        if len(self.seen) >= self.LIMIT:
            self.seen.clear()
        self.seen.add(key)


#: Node kinds that are or may hold a function, or below which other conditions hold.
_SCOPED = frozenset("def class decorated lambda function arrow method fn impl mod if arm case".split())


class Shapes:
    """The calls of statements that were parsed without fault, by token-class sequence as in ``Memo``, as offsets of tokens.

    What a shape accepts and how its tree is built depend on the same things, so the calls of a known shape lie at the same tokens.
    """

    LIMIT = 200_000

    def __init__(self):
        self.seen: dict = {}

    def add(self, key, node: Node | None, start: list, end: list, i: int, j: int) -> None:
        """Learn the tree of tokens ``i`` to ``j``, unless functions or conditions in it make it more than a list of calls."""
        calls, stack = [], [node]
        while stack:
            n = stack.pop()
            if n is None:
                continue
            if n.t in _SCOPED:
                return
            if n.t == "call":
                c = n.f["callee"]
                a, b = bisect_left(start, c.s, i, j + 1), bisect_left(end, c.e, i, j + 1)
                if a > j or b > j or start[a] != c.s or end[b] != c.e:
                    return
                calls.append((a - i, b - i))
            elif n.f:
                for v in n.f.values():
                    if any(isinstance(x, Node) and x.t in _SCOPED for x in (v if isinstance(v, (list, tuple)) else (v,))):
                        return
            stack.extend(reversed(n.k))
        if len(self.seen) >= self.LIMIT:
            self.seen.clear()
        self.seen[key] = tuple(calls)

    @staticmethod
    def node(calls: tuple, start: list, end: list, i: int, j: int) -> Node | None:
        """A statement of tokens ``i`` to ``j`` with nothing but its calls, in the order of the walk."""
        if not calls:
            return None
        kids = [Node("call", start[i + a], end[i + b], (), None, {"callee": Node("id", start[i + a], end[i + b]), "args": ()}) for a, b in calls]
        return Node("stmts", start[i], end[j], kids)


_codes: dict[str, str] = {}


def code(kind: str) -> str:
    """One character per token class, for keys."""
    c = _codes.get(kind)
    if c is None:
        c = _codes[kind] = chr(len(_codes) + 0x100)
    return c


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1
