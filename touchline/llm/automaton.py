"""Regular expressions compiled into one deterministic automaton over bytes.

The syntax is what secret rules need: literals, ``\\`` escapes, ``\\xHH``, classes with ranges and negation, groups ``( )``,
``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``; ``(?i:...)`` lets ASCII letters match in either case. Only ASCII may be
written, so a rule never splits a character of UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_REPEAT_END = -1


@dataclass
class _Node:
    kind: str  # bytes, cat, alt, repeat
    members: frozenset[int] = frozenset()
    parts: list[_Node] = field(default_factory=list)
    least: int = 0
    most: int = _REPEAT_END


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def parse(self) -> _Node:
        node = self._alternatives(False)
        if self.at != len(self.pattern):
            raise ValueError(f"unexpected {self.pattern[self.at]!r} at {self.at} in {self.pattern!r}")
        return node

    def _peek(self) -> str:
        return self.pattern[self.at] if self.at < len(self.pattern) else ""

    def _alternatives(self, fold: bool) -> _Node:
        branches = [self._sequence(fold)]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence(fold))
        return branches[0] if len(branches) == 1 else _Node("alt", parts=branches)

    def _sequence(self, fold: bool) -> _Node:
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated(self._atom(fold)))
        return _Node("cat", parts=items)

    def _repeated(self, node: _Node) -> _Node:
        while (sign := self._peek()) and sign in "?*+{":
            self.at += 1
            if sign == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), int(high) if high else _REPEAT_END if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, _REPEAT_END), "+": (1, _REPEAT_END)}[sign]
            node = _Node("repeat", parts=[node], least=least, most=most)
        return node

    def _atom(self, fold: bool) -> _Node:
        sign = self._peek()
        self.at += 1
        if sign == "(":
            if self.pattern.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.pattern.startswith("?:", self.at):
                self.at += 2
            node = self._alternatives(fold)
            if self._peek() != ")":
                raise ValueError(f"missing ) in {self.pattern!r}")
            self.at += 1
            return node
        if sign == "[":
            return self._class(fold)
        if sign in ".^$*+?{":
            raise ValueError(f"{sign!r} at {self.at - 1} is not supported in {self.pattern!r}")
        return self._bytes({self._escaped() if sign == "\\" else ord(sign)}, fold)

    def _escaped(self) -> int:
        sign = self._peek()
        self.at += 1
        if sign == "x":
            self.at += 2
            return int(self.pattern[self.at - 2 : self.at], 16)
        if sign.isalnum():
            raise ValueError(f"\\{sign} is not supported in {self.pattern!r}")
        return ord(sign)

    def _class(self, fold: bool) -> _Node:
        negated = self._peek() == "^"
        self.at += negated
        members: set[int] = set()
        first = True
        while first or self._peek() != "]":
            first = False
            low = self._one()
            high = low
            if self._peek() == "-" and self.pattern[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self._one()
            members |= set(range(low, high + 1))
        self.at += 1
        return self._bytes(set(range(128)) - members if negated else members, fold)

    def _one(self) -> int:
        sign = self.pattern[self.at]
        self.at += 1
        return self._escaped() if sign == "\\" else ord(sign)

    def _bytes(self, members: set[int], fold: bool) -> _Node:
        if any(b > 127 for b in members):
            raise ValueError(f"only ASCII can be written: {self.pattern!r}")
        if fold:
            letters = {b for b in members if chr(b).isalpha()}
            members = members | {b ^ 32 for b in letters}
        return _Node("bytes", members=frozenset(members))


def _reversed(node: _Node) -> _Node:
    parts = [_reversed(p) for p in node.parts]
    return _Node(node.kind, node.members, parts[::-1] if node.kind == "cat" else parts, node.least, node.most)


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []
        self.ends: dict[int, int] = {}

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add(self, node: _Node, start: int) -> int:
        """Attach a node at a state; the state where it ends."""
        if node.kind == "bytes":
            end = self.state()
            here = self.state()
            self.free[start].append(here)
            self.steps[here] = (node.members, end)
            return end
        if node.kind == "cat":
            for part in node.parts:
                start = self.add(part, start)
            return start
        if node.kind == "alt":
            end = self.state()
            for part in node.parts:
                branch = self.state()
                self.free[start].append(branch)
                self.free[self.add(part, branch)].append(end)
            return end
        part = node.parts[0]
        for _ in range(node.least):
            start = self.add(part, start)
        if node.most == _REPEAT_END:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(node.most - node.least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for follower in self.free[todo.pop()]:
                if follower not in seen:
                    seen.add(follower)
                    todo.append(follower)
        return frozenset(s for s in seen if self.steps[s] or s in self.ends)


@dataclass(frozen=True)
class Dfa:
    """Transition array (states x 256), and per state a bit for each rule that ends there. State 0 is the start.

    In an anchored automaton ``dead`` is the state that nothing leads out of, else -1.
    """

    table: np.ndarray
    ends: np.ndarray
    dead: int


def compile_rules(patterns: list[str], *, backward: bool = False, anywhere: bool = False) -> Dfa:
    """One minimal automaton for all patterns: of reversed texts if ``backward``, restarting at every byte if ``anywhere``."""
    nfa = _Nfa()
    root = nfa.state()
    for number, pattern in enumerate(patterns):
        node = _Parser(pattern).parse()
        nfa.ends[nfa.add(_reversed(node) if backward else node, root)] = number
    return _minimal(*_subsets(nfa, root, anywhere))


def _subsets(nfa: _Nfa, root: int, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction. Bytes that no step tells apart share a class."""
    seen_as: dict[tuple[bool, ...], int] = {}
    steps = [s for s in nfa.steps if s]
    distinct = list(dict.fromkeys(members for members, _ in steps))
    class_of = [seen_as.setdefault(tuple(b in m for m in distinct), len(seen_as)) for b in range(256)]
    sample = {c: b for b, c in reversed(list(enumerate(class_of)))}
    start = nfa.closure({root})
    numbers, rows, todo = {start: 0}, [], [start]
    for subset in todo:
        row = []
        for c in range(len(seen_as)):
            moved = {nfa.steps[s][1] for s in subset if nfa.steps[s] and sample[c] in nfa.steps[s][0]}
            follower = nfa.closure(moved | {root} if anywhere else moved)
            if follower not in numbers:
                numbers[follower] = len(numbers)
                todo.append(follower)
            row.append(numbers[follower])
        rows.append(row)
    ends = [sum(1 << n for n in {nfa.ends[s] for s in subset if s in nfa.ends}) for subset in todo]
    return np.array(rows, dtype=np.int64)[:, class_of], np.array(ends, dtype=np.int64)


def _minimal(table: np.ndarray, ends: np.ndarray) -> Dfa:
    """Merge states by refining the partition by ends until followers agree (Moore)."""
    group = np.unique(ends, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    seen = 0
    for g in group:  # number the groups by their first state, so that the start stays 0
        if order[g] < 0:
            order[g] = seen
            seen += 1
    group = order[group]
    first = np.zeros(seen, dtype=np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    small, small_ends = group[table[first]], ends[first]
    dead = [s for s in range(seen) if not small_ends[s] and (small[s] == s).all()]
    return Dfa(small, small_ends, dead[0] if dead else -1)
