"""Personal data: rules find the base spans, and a skip-chain conditional random field adds what goes with them.

Tokens are words with a digit or ``@``. Neighbours in the text share a potential, and so do tokens far apart that are the same or similar: that have
the same letters and digits, the same last seven digits, or of which one is the local part of the other, an address. Loopy message passing makes the
labels of a document agree along these links.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import quoted

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,stop:long,base:boolean>>"
#: The sample that is fitted: at most so many documents with a digit or ``@``, and of one with more tokens a run of so many.
SAMPLE, SAMPLE_TOKENS = 1000, 48
#: A token outside the base spans is added from this marginal on.
SURE = 0.6
#: Rounds of message passing; features and label weights are hashed to so many rows.
ROUNDS, HASHED = 12, 1 << 12
#: Tokens of documents that pass messages at a time.
TOKENS_AT_ONCE = 1 << 15

#: Tokens of base spans are observed: their label has so much more weight when messages are passed.
_OBSERVED = 8.0
_LABELS = len(KINDS) + 1
_CHAIN, _SKIP = 0, 1
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number begins where no digit is before it: a match that began later in a run of digits would have begun at the run.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_CORE = re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]|[A-Za-z0-9]", re.DOTALL)
_NAME = re.compile("[A-Za-z][A-Za-z._%+-]*")
_NOT_DIGIT = re.compile("[^0-9]+")


def passes_luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _small(number: str) -> bool:
    return len(number.lstrip("0")) < 4 and int(number.lstrip("0") or "0") < 256


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses by their ``@``: the longest run of local characters before it that no earlier match has."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base rules' matches, sorted; leftmost and apart for each kind, failing ones dropped."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _HINT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


# --- The graph of a document


@dataclass
class Graph:
    """The tokens of a document: places, features, what they share with others, whether they follow the one before, base labels."""

    start: list[int] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    keys: list[list[str]] = field(default_factory=list)
    chained: list[bool] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)

    def add(self, start: int, stop: int, features: list[int], keys: list[str], chained: bool, label: int = 0) -> None:
        for values, value in zip((self.start, self.stop, self.features, self.keys, self.chained, self.labels), (start, stop, features, keys, chained, label), strict=True):
            values.append(value)

    def edges(self) -> list[tuple[int, int, int]]:
        """(token, later token, type): neighbours in the text, and each token with the first and the last one before it that share a key."""
        made = [(n - 1, n, _CHAIN) for n in range(1, len(self.start)) if self.chained[n]]
        last: dict[str, tuple[int, int]] = {}
        for n, shared in enumerate(self.keys):
            for m in sorted({m for key in shared if key in last for m in last[key]}):
                made.append((m, n, _SKIP))
            for key in shared:
                last[key] = (last[key][0] if key in last else n, n)
        return made


def _candidates(text: str) -> list[tuple[int, int]]:
    """The words with a digit or ``@``, and where the text has addresses also the words that are the local part of one."""
    found, end = [], 0
    while hint := _HINT.search(text, end):
        start = hint.start()
        while start > end and not _GAP.match(text, start - 1):
            start -= 1
        gap = _GAP.search(text, hint.end())
        end = gap.start() if gap else len(text)
        found.append((start, end))
    locals_ = {name for a, b in found for name in [text[a:b].partition("@")[0]] if len(name) >= 5 and "@" in text[a:b] and not _HINT.search(name)}
    locals_ = {core.group().lower() for name in locals_ if (core := _CORE.search(name)) and len(core.group()) >= 5}
    if locals_:
        starts, stops = [a for a, _ in found], [b for _, b in found]
        for m in _NAME.finditer(text):
            a, b = m.start(), m.start() + len(m.group().rstrip("._%+-"))
            if text[a:b].lower() in locals_ and not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum():
                before = bisect_right(starts, a) - 1
                if before < 0 or a >= stops[before]:
                    found.append((a, b))
        found.sort()
    return found


def _core(text: str, start: int, stop: int) -> tuple[int, int]:
    """A word without the marks around it, but for a ``+`` before a digit."""
    inner = _CORE.search(text, start, stop)
    if not inner:
        return start, stop
    a, b = inner.span()
    return (a - 1 if a > start and text[a - 1] == "+" else a), b


def _shape(word: str) -> str:
    """Runs of digits with their length, and of letters without; other characters as they are."""
    runs = re.sub(r"[0-9]+", lambda m: f"\x00{min(len(m.group()), 9)}", word[:64])
    return re.sub("[^\\W\\d_]+", "a", runs)[:32]


def _range(count: int) -> int:
    return sum(count > cut for cut in (0, 3, 6, 7, 9, 11, 13, 15, 16, 19))


def _beside(word: str) -> str:
    return "none" if not word else "word" if word.isalpha() else "marked" if _CORE.search(word) and not _HINT.search(word) else "mark" if not _HINT.search(word) else "token"


def features(core: str, before: str, after: str) -> list[int]:
    """The hashed features of a token: its shape and digits, what checks hold for it, and what stands beside it."""
    digits = _NOT_DIGIT.sub("", core)
    numbers = core.split(".")
    address = len(numbers) == 4 and all(n.isascii() and n.isdigit() and _small(n) for n in numbers)
    name, at, domain = core.partition("@")
    checked = "luhn" if 14 <= len(digits) <= 19 and passes_luhn(digits) else "no"
    named = [
        "bias",
        f"shape {_shape(core)}",
        f"kind {re.sub('[0-9]+', '9', _shape(core))[:12]}",
        f"digits {_range(len(digits))} {len(digits) == len(core)}",
        f"checked {checked} {len(digits) == len(core)}",
        f"address {address}",
        f"at {bool(name and at)} {'.' in domain}",
        f"plus {core.startswith('+')}",
        f"before {_beside(before)} {core.startswith('+')}",
        f"after {_beside(after)}",
    ]
    return [crc32(f.encode("utf-8", "replace")) % HASHED for f in named]


def keys(core: str, run: str = "") -> list[str]:
    """What a token shares with tokens that are the same or similar; ``run`` has the digits of a number written as several words up to here."""
    name, at, _ = core.lower().partition("@")
    digits = run or _NOT_DIGIT.sub("", core)
    shared = []
    if len(name) >= 5:
        trimmed = _CORE.search(name)
        shared.append("name " + (trimmed.group() if trimmed else name))
    if len(digits) >= 7 and not at:
        shared.append("digits " + digits[-7:])
    return shared


def _word_before(text: str, start: int) -> str:
    end = start
    while end > 0 and end > start - 3 and _GAP.match(text, end - 1):
        end -= 1
    begin = end
    while begin > 0 and begin > end - 24 and not _GAP.match(text, begin - 1):
        begin -= 1
    return text[begin:end]


def _word_after(text: str, stop: int) -> str:
    begin = stop
    while begin < len(text) and begin < stop + 3 and _GAP.match(text, begin):
        begin += 1
    gap = _GAP.search(text, begin, begin + 24)
    return text[begin : gap.start() if gap else begin + 24]


def graph(text: str, base: list[tuple[int, int, int]] | None = None) -> Graph:
    """The tokens of a text; one that begins in a base span or holds the start of one has its label."""
    made, ends = Graph(), -1
    base = base_spans(text) if base is None else base
    waiting, run = 0, ""
    covering: list[tuple[int, int, int]] = []
    for start, stop in _candidates(text):
        a, b = _core(text, start, stop)
        while waiting < len(base) and base[waiting][0] < b:
            covering.append(base[waiting])
            waiting += 1
        covering = [s for s in covering if s[2] > a]
        label = 1 + covering[0][1] if covering else 0
        chained = ends >= 0 and start - ends <= 2 and not text[ends:start].strip(" ()")
        core = text[a:b]
        number = not any(c.isalpha() or c == "@" for c in core)
        run = ((run if chained else "") + _NOT_DIGIT.sub("", core))[-20:] if number else ""
        made.add(a, b, features(core, _word_before(text, start), _word_after(text, stop)), keys(core, run), chained, label)
        ends = stop
    return made


# --- Messages


@dataclass(frozen=True)
class Model:
    """Log weights: of each hashed feature for each label, and of two labels on a link in the text or on a skip link."""

    weights: np.ndarray
    links: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        parts = (self.weights[rows[n : n + TOKENS_AT_ONCE]].sum(axis=1) for n in range(0, len(rows), TOKENS_AT_ONCE))
        return np.concatenate([np.empty((0, _LABELS)), *parts])


def _normal(values: np.ndarray) -> np.ndarray:
    return values - np.logaddexp.reduce(values, axis=-1, keepdims=True)


def beliefs(scores: np.ndarray, edges: np.ndarray, links: np.ndarray, rounds: int = ROUNDS, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Log marginals of tokens, and with ``pairs`` of the two labels of each link, after some rounds of damped message passing."""
    if not len(edges):
        return _normal(scores), np.empty((0, _LABELS, _LABELS))
    u, v, kind = edges.T
    table = links[kind]  # label of u, label of v
    ahead, back = np.zeros((len(u), _LABELS)), np.zeros((len(u), _LABELS))

    def gathered() -> np.ndarray:
        total = scores.copy()
        np.add.at(total, v, ahead)
        np.add.at(total, u, back)
        return total

    for _ in range(rounds):
        total = gathered()
        new_ahead = _normal(np.logaddexp.reduce((total[u] - back)[:, :, None] + table, axis=1))
        new_back = _normal(np.logaddexp.reduce((total[v] - ahead)[:, None, :] + table, axis=2))
        moved = max(np.abs(new_ahead - ahead).max(), np.abs(new_back - back).max())
        ahead, back = 0.3 * ahead + 0.7 * new_ahead, 0.3 * back + 0.7 * new_back
        if moved < 1e-4:
            break
    total = gathered()
    if not pairs:
        return _normal(total), None
    joint = (total[u] - back)[:, :, None] + table + (total[v] - ahead)[:, None, :]
    return _normal(total), joint - np.logaddexp.reduce(joint.reshape(len(u), -1), axis=1)[:, None, None]


def _joined(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray]:
    """Features and links of several documents as one graph."""
    rows = np.array([f for g in graphs for f in g.features], dtype=np.int64)
    shift, edges = 0, []
    for g in graphs:
        edges += [(a + shift, b + shift, t) for a, b, t in g.edges()]
        shift += len(g.start)
    return rows, np.array(edges, dtype=np.int64).reshape(-1, 3)


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """For each base span another way of writing it, with its label, and a stranger in the same form, which is no personal data."""
    made = []
    for start, kind, stop in base:
        whole = text[start:stop]
        digits, odd = _NOT_DIGIT.sub("", whole), crc32(whole.encode("utf-8", "replace"))
        if kind == 0:
            core = _CORE.search(whole.partition("@")[0])
            short = core.group() if core else ""
        elif kind == 1:
            short = whole.replace(".", "-")
        elif kind == 2:
            short = ".".join(digits[n : n + 4] for n in range(0, len(digits), 4))
        else:
            short = f"{digits[-7:-4]}-{digits[-4:]}" if odd & 1 else f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"
        turned = "".join(str((int(c) + 1 + (odd >> n % 24) % 8) % 10) if c in "0123456789" else chr((ord(c.lower()) - 96 + odd % 24) % 26 + 97) if c.isascii() and c.isalpha() else c for n, c in enumerate(short))
        if short and keys(short):
            made += [(short, 1 + kind), (turned, 0)]
    return made


def training_graph(text: str, at: int = 0, most: int = SAMPLE_TOKENS) -> Graph:
    """A run of a text's tokens with the base labels, and the other ways of writing its base spans as further tokens.

    The base rules label the tokens. What they cannot see, that a local part or a number written otherwise goes with its full
    form, is learned from these further tokens, as is that the same form alone is nothing.
    """
    base = base_spans(text)
    whole = graph(text, base)
    kept = Graph()
    first = at % (len(whole.start) - most + 1) if len(whole.start) > most else 0
    for n in range(first, min(first + most, len(whole.start))):
        kept.add(whole.start[n], whole.stop[n], whole.features[n], whole.keys[n], whole.chained[n] and n > first, whole.labels[n])
    if kept.start:
        inside = [s for s in base if kept.start[0] <= s[0] < kept.stop[-1]][:most]
        for core, label in _mentions(text, inside):
            kept.add(0, 0, features(core, "word", "word"), keys(core), False, label)
    return kept


def train(graphs: list[Graph], turns: int = 120, rate: float = 0.15, ridge: float = 0.002) -> Model:
    """Likelihood by Adam, where loopy message passing gives what the model expects. Without base labels nothing is added."""
    weights, links = np.zeros((HASHED, _LABELS)), np.zeros((2, _LABELS, _LABELS))
    labels = np.array([label for g in graphs for label in g.labels], dtype=np.int64)
    if not labels.any():
        weights[crc32(b"bias") % HASHED, 0] = 20.0
        return Model(weights, links)
    rows, edges = _joined(graphs)
    seen = np.eye(_LABELS)[labels]
    u, v, kind = edges.T
    seen_links = np.zeros_like(links)
    np.add.at(seen_links, (kind, labels[u], labels[v]), 1)
    steps = [np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(links), np.zeros_like(links)]
    for turn in range(1, turns + 1):
        own, joint = beliefs(weights[rows].sum(axis=1), edges, links)
        gap = (seen - np.exp(own)) / len(labels) * 20
        slope = np.zeros_like(weights)
        np.add.at(slope, rows, gap[:, None, :])
        expected = np.zeros_like(links)
        np.add.at(expected, kind, np.exp(joint))
        slope_links = (seen_links - expected) / len(labels) * 20
        slope_links[_SKIP] = (slope_links[_SKIP] + slope_links[_SKIP].T) / 2  # a skip link has no direction
        for values, change, (first, second) in ((weights, slope, steps[0]), (links, slope_links, steps[1])):
            change -= ridge * values
            first *= 0.9
            first += 0.1 * change
            second *= 0.99
            second += 0.01 * change**2
            values += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Model(weights, links)


# --- Spans


def _overlaps(spans: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> list[bool]:
    """Which tokens share a code point with a span; both by start."""
    found, waiting, reach = [], 0, -1
    for a, b in tokens:
        while waiting < len(spans) and spans[waiting][0] < b:
            reach = max(reach, spans[waiting][2])
            waiting += 1
        found.append(reach > a)
    return found


def _added(given: Graph, marginals: np.ndarray, base: list[tuple[int, int, int]], sure: float) -> list[tuple[int, int, int]]:
    """Spans of the tokens outside the base spans that the model is sure of; neighbours of one kind are one span, addresses apart."""
    best = marginals.argmax(axis=1)
    covered = _overlaps(base, list(zip(given.start, given.stop, strict=True)))
    spans: list[tuple[int, int, int]] = []
    open_ = False
    for n, label in enumerate(best.tolist()):
        if not label or covered[n] or marginals[n, label] < sure:
            open_ = False
            continue
        kind = label - 1
        if open_ and given.chained[n] and kind >= 2 and spans[-1][1] == kind:
            spans[-1] = (spans[-1][0], kind, given.stop[n])
        else:
            spans.append((given.start[n], kind, given.stop[n]))
        open_ = True
    return spans


def all_spans(texts: list[str], model: Model, sure: float = SURE) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, stop, whether it is a base span) of each text, by start and then in the order of kinds."""
    results: list[list[tuple[str, int, int, bool]]] = []
    waiting: list[tuple[int, Graph, list[tuple[int, int, int]]]] = []
    size = 0

    def decide() -> None:
        rows, edges = _joined([g for _, g, _ in waiting])
        labels = np.array([label for _, g, _ in waiting for label in g.labels], dtype=np.int64)
        scores = model.scores(rows)
        known = np.flatnonzero(labels)
        scores[known, labels[known]] += _OBSERVED
        marginals = np.exp(beliefs(scores, edges, model.links, pairs=False)[0])
        at = 0
        for n, g, base in waiting:
            more = _added(g, marginals[at : at + len(g.start)], base, sure)
            at += len(g.start)
            marked = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
            results[n] = [(KINDS[kind], a, b, known) for a, kind, b, known in marked]
        waiting.clear()

    for n, text in enumerate(texts):
        results.append([])
        if _HINT.search(text):
            base = base_spans(text)
            made = graph(text, base)
            waiting.append((n, made, base))
            size += len(made.start)
            if size >= TOKENS_AT_ONCE:
                decide()
                size = 0
    if waiting:
        decide()
    return results


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` different texts with a digit or ``@``, those with the smallest hashes.

    The base rules are its labels. Of a text with over 48 tokens a run of 48 counts, from a place by the hash. The sample's
    size is bounded, so its hashes are broadcast and its tokens' features are brought to the driver.
    """
    read = docs.select(F.col(quoted(text)).alias("text")).where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("hash"))
    picked = read.select("hash").distinct().orderBy("hash").limit(sample)

    @F.pandas_udf("array<struct<features:array<int>,keys:array<string>,chained:boolean,label:int>>")
    def tokens(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        made = (training_graph(t, int(h) % (1 << 31)) for t, h in zip(texts, hashes, strict=True))
        return pd.Series([[{"features": f, "keys": k, "chained": c, "label": n} for f, k, c, n in zip(g.features, g.keys, g.chained, g.labels, strict=True)] for g in made], dtype=object)

    met = read.join(F.broadcast(picked), "hash").groupBy("hash").agg(F.min("text").alias("text"))
    graphs = []
    for row in sorted(met.select("hash", tokens("text", "hash").alias("tokens")).collect()):
        made = Graph()
        for token in row["tokens"]:
            made.add(0, 0, list(token["features"]), list(token["keys"]), token["chained"], token["label"])
        graphs.append(made)
    return train(graphs)


def spans(text: Column, model: Model, sure: float = SURE) -> Column:
    """All spans of a text as an array of (kind, start, stop, base); empty for null."""

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = all_spans([t or "" for t in texts], model, sure)
            yield pd.Series([[{"kind": k, "start": a, "stop": b, "base": known} for k, a, b, known in some] for some in found], dtype=object)

    return find(text)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, sure: float = SURE) -> DataFrame:
    """One row per document: key and ``spans``, an array of (kind, start, stop, base) in code points, stop exclusive.

    Base spans are the rules' matches of addresses, IP numbers, cards and phones, leftmost and apart for each kind, failing ones
    dropped; they all stay. The skip-chain field labels the tokens of each whole text, linked to their neighbours and to tokens far
    away that are the same or similar, and adds spans for tokens outside the base spans from a marginal of ``sure`` on: a local part or
    a number written otherwise elsewhere in a document takes the label of its full form. The model is fitted on these
    documents unless one is given.

    Null and empty texts have no spans. Rows are independent once the model is fitted, so repeated rows repeat their result, and repeated texts
    are learned from once. Extra columns are ignored, whatever their names. Without base spans in the sample nothing
    is added. Empty tables give no rows.
    """
    fitted = fit(docs, text) if model is None else model
    return docs.select(F.col(quoted(key)).alias(key), spans(F.col(quoted(text)), fitted, sure).alias("spans"))
