"""Counting strings in a burst trie.

Inner nodes branch on one character, after the characters that all terms below share. Leaves
are containers: small tables from the rest of a term to its counters. A container that grows
beyond its limit bursts into an inner node with a container per next character, so that the
depth follows the branches of the terms, not their length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from os.path import commonprefix

#: Terms in a container before it bursts.
CONTAINER = 256


class BurstTrie:
    """Two counters per term: occurrences and records."""

    def __init__(self, prefix: str = "", limit: int = CONTAINER) -> None:
        self.prefix, self.limit = prefix, limit
        self.root: Node | Leaf = Leaf()

    def add(self, term: str, occurrences: int, records: int) -> None:
        """Adds to the counters of `term`, which begins with the trie's prefix."""
        parent, step, at, i = None, "", self.root, len(self.prefix)
        while type(at) is Node:
            if at.shared and not term.startswith(at.shared, i):
                at = self._hang(parent, step, at.split(len(commonprefix([at.shared, term[i : i + len(at.shared)]]))))
            i += len(at.shared)
            if i == len(term):
                at.ends[0] += occurrences
                at.ends[1] += records
                at.ends[2] = True
                return
            parent, step = at, term[i]
            at = at.children.get(step)
            i += 1
            if at is None:
                at = parent.children[step] = Leaf()
        rest = term[i:]
        counters = at.terms.get(rest)
        if counters is not None:
            counters[0] += occurrences
            counters[1] += records
            return
        at.terms[rest] = [occurrences, records]
        if len(at.terms) > self.limit:
            self._hang(parent, step, at.burst())

    def _hang(self, parent: Node | None, step: str, node: Node) -> Node:
        if parent is None:
            self.root = node
        else:
            parent.children[step] = node
        return node

    def extend(self, terms: Iterable[str], occurrences: Iterable[int], records: Iterable[int]) -> None:
        for t, o, r in zip(terms, occurrences, records):
            self.add(t, o, r)

    def containers(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, rests, occurrences, records) of each container, prefixes in order, rests sorted."""
        waiting: list[tuple[str, Node | Leaf]] = [(self.prefix, self.root)]
        while waiting:
            prefix, at = waiting.pop()
            if type(at) is Leaf:
                if at.terms:
                    rests = sorted(at.terms)
                    yield prefix, rests, [at.terms[r][0] for r in rests], [at.terms[r][1] for r in rests]
                continue
            prefix += at.shared
            if at.ends[2]:
                yield prefix, [""], [at.ends[0]], [at.ends[1]]
            waiting.extend((prefix + c, at.children[c]) for c in sorted(at.children, reverse=True))


class Leaf:
    __slots__ = ("terms",)

    def __init__(self) -> None:
        self.terms: dict[str, list[int]] = {}

    def burst(self) -> Node:
        node = Node(commonprefix([min(self.terms), max(self.terms)]))
        skip = len(node.shared)
        for rest, (o, r) in self.terms.items():
            if len(rest) > skip:
                node.children.setdefault(rest[skip], Leaf()).terms[rest[skip + 1 :]] = [o, r]
            else:
                node.ends = [o, r, True]
        return node


class Node:
    __slots__ = ("shared", "children", "ends")

    def __init__(self, shared: str = "") -> None:
        self.shared = shared
        self.children: dict[str, Node | Leaf] = {}
        self.ends: list = [0, 0, False]

    def split(self, at: int) -> Node:
        """A node that shares the first `at` characters only, this one being its child."""
        above = Node(self.shared[:at])
        above.children[self.shared[at]] = self
        self.shared = self.shared[at + 1 :]
        return above


def route(term: str, branches: dict[str, int]) -> str:
    """The prefix of `term` that it is sent by: from the empty one, as long as it is in `branches`, one character more than the length given there."""
    to = ""
    while to in branches and len(term) > len(to):
        to = term[: branches[to] + 1]
    return to


def decided(prefix: str, branches: dict[str, int]) -> str | None:
    """The route that all terms with `prefix` have, None if they have several."""
    to = ""
    while to in branches:
        if len(prefix) <= branches[to]:
            return None
        to = prefix[: branches[to] + 1]
    return to
