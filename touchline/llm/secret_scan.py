"""Secret scans: all rules in one byte pass of a combined automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.automaton import Dfa, compile_rules


@dataclass(frozen=True)
class Rule:
    """A secret is the longest match of ``head`` then ``body`` at the leftmost place; matches of a rule don't overlap.

    A match stays if its body has ``least`` characters. The body begins after the longest match of the head.
    """

    kind: str
    head: str
    body: str
    least: int = 1


#: ``hex`` has its length in the pattern, so that not every letter a to f begins a match. It gives what dropping shorter
#: matches gives: a run is as long as can be, and a later start in the same run is shorter still.
BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN\\x20([A-Z]+\\x20)*PRIVATE\\x20", "KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]+"),
    Rule("code_host", "gh[opsur]_", "[A-Za-z0-9]+", 36),
    Rule("chat_app", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("url_login", "[a-z]+://[A-Za-z0-9_.-]+:", "[!#-.0-9;-?A-Z\\[-~]+@"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:long,stop:long>>"


class Scanner:
    """The rules' automata. ``starts`` reads a text backward once and marks the bytes where a match of a rule begins."""

    def __init__(self, rules: Sequence[Rule], marks: Dfa, full: Sequence[Dfa], heads: Sequence[Dfa]):
        self.rules = tuple(rules)
        self.states = len(marks.table)
        rows: list[list] = [[None] * 257 for _ in range(self.states)]
        for row, followers, ends in zip(rows, marks.table.tolist(), marks.ends.tolist(), strict=True):
            row[:256] = [rows[f] for f in followers]
            row[256] = ends
        self.start = rows[0]
        self.full_tables = [(d.table.tolist(), d.ends.tolist(), d.dead) for d in full]
        self.head_tables = [(d.table.tolist(), d.ends.tolist(), d.dead) for d in heads]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, rules as bits) of every byte where matches begin, from the last to the first."""
        ends = map(itemgetter(256), accumulate(reversed(data), getitem, initial=self.start))
        return [(len(data) - n, bits) for n, bits in filter(itemgetter(1), enumerate(ends))]

    @staticmethod
    def _longest(tables, data: bytes, at: int) -> int:
        table, ends, dead = tables
        state, best = 0, at if ends[0] else -1
        for place in range(at, len(data)):
            state = table[state][data[place]]
            if state == dead:
                break
            if ends[state]:
                best = place + 1
        return best

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, stop) in code points, by start and then in the order of the rules."""
        data = text.encode("utf-8", "replace")
        free = [0] * len(self.rules)
        found = []
        for at, bits in reversed(self.starts(data)):
            for number, rule in enumerate(self.rules):
                if bits >> number & 1 and at >= free[number]:
                    stop = self._longest(self.full_tables[number], data, at)
                    free[number] = stop
                    if stop - self._longest(self.head_tables[number], data, at) >= rule.least:
                        found.append((at, number, stop))
        if not data.isascii():
            places: dict[int, int] = {}
            seen, points = 0, 0
            for place in sorted({p for at, _, stop in found for p in (at, stop)}):
                points += len(data[seen:place].decode("utf-8"))
                places[place], seen = points, place
            found = [(places[at], number, places[stop]) for at, number, stop in found]
        return [(self.rules[number].kind, at, stop) for at, number, stop in sorted(found)]


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """The transition arrays, compiled once by the driver: start marks of all rules, then per rule the match and its head."""
    marks = compile_rules([r.head + r.body for r in rules], backward=True, anywhere=True)
    return marks, [compile_rules([r.head + r.body]) for r in rules], [compile_rules([r.head]) for r in rules]


def secrets(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All secrets of a text as an array of (kind, start, stop); empty for null."""
    kept = tuple(rules)
    automata = compiled(kept)

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = Scanner(kept, *automata).spans
        for texts in batches:
            yield pd.Series([[] if t is None else [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t)] for t in texts], dtype=object)

    return find(text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: key and ``secrets``, an array of (kind, start, stop) in code points, stop exclusive.

    One pass over a text's bytes, from the end, drives an automaton that holds all rules and marks where matches begin; each match is
    then followed forward to its longest end. Cost is linear and memory that of one batch of texts; rows don't move.

    Null and empty texts have no secrets. Rows are independent, so repeated rows repeat their result. Extra columns are
    ignored, whatever their names. Empty tables give no rows.
    """
    return docs.select(F.col(key).alias(key), secrets(F.col(text), rules).alias("secrets"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:stop`` of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
