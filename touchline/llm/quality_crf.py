"""Quality classifier: a linear-chain conditional random field labels every line good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import quoted

#: Shares of bytes or words in a line and sizes of it, each cut into ranges; a line is known by its range in each.
MEASURES = {
    "symbols": (0.0, 0.02, 0.08, 0.2),
    "exclaimed": (0.0, 0.02, 0.08, 0.2),
    "capitals": (0.0, 0.06, 0.2, 0.5),
    "digits": (0.0, 0.05, 0.2, 0.5),
    "repeated": (0.0, 0.25, 0.5, 0.75),
    "bars": (0.0, 0.1, 0.25, 0.4),
    "word_bytes": (1.5, 4.0, 8.0, 14.0),
    "words": (0.0, 2.0, 9.0, 29.0),
}
RANGES = 5
#: The sample that is fitted: at most so many labelled documents, and of a longer one a run of so many lines.
SAMPLE, SAMPLE_LINES = 3000, 64
#: A document is good from this score on.
GOOD = 0.7

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"


def measure(line: bytes) -> tuple[float, ...]:
    """The measures of a line."""
    size, words = len(line) or 1, line.split()
    share = lambda drop: (len(line) - len(line.translate(None, drop))) / size
    n = len(words)
    return (
        share(_SYMBOLS),
        share(b"!"),
        share(_CAPITALS),
        share(_DIGITS),
        1 - len(set(words)) / n if n else 0.0,
        words.count(b"|") / n if n else 0.0,
        len(line) / n if n else 0.0,
        float(n),
    )


def codes(lines: list[bytes]) -> np.ndarray:
    """The ranges of the measures, a row for each line."""
    values = np.array([measure(line) for line in lines]).reshape(len(lines), len(MEASURES))
    return np.column_stack([np.searchsorted(cuts, values[:, m]) for m, cuts in enumerate(MEASURES.values())]).astype(np.int8)


@dataclass(frozen=True)
class Model:
    """Log weights for a good line (0 for a bad one): by range in the line itself, the one before and the one after; for
    the first line; and for each step between bad (0) and good (1)."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    start: float
    steps: np.ndarray
    learned: bool = True

    def evidence(self, ranges: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of each line alone; ``starts`` are the first lines of texts, over which neighbours don't reach."""
        column = np.arange(len(MEASURES))
        total = self.own[column, ranges].sum(axis=1) + self.bias
        if len(ranges) > 1:
            linked = np.ones(len(ranges) - 1)
            linked[starts[1:] - 1] = 0
            total[1:] += self.before[column, ranges[:-1]].sum(axis=1) * linked
            total[:-1] += self.after[column, ranges[1:]].sum(axis=1) * linked
        total[starts] += self.start
        return total

    def chain(self, evidence: list[float]) -> list[float]:
        """The chance that each line of a text is good, by forward and backward odds."""
        (bb, bg), (gb, gg) = np.exp(self.steps).tolist()
        ahead, odds = [], 0.0
        for n, e in enumerate(evidence):
            if n:
                up = exp(odds)
                odds = log((up * gg + bg) / (up * gb + bb))
            odds = min(max(odds + e, -50.0), 50.0)
            ahead.append(odds)
        chances, back = [], 0.0
        for n in range(len(evidence) - 1, -1, -1):
            chances.append(1 / (1 + exp(-(ahead[n] + back))))
            up = exp(min(max(back + evidence[n], -50.0), 50.0))
            back = log((gg * up + gb) / (bg * up + bb))
        return chances[::-1]

    def scores(self, texts: list[str]) -> list[float]:
        """Quality of each text: the chances of its lines weighted by their length in bytes, plus one for the line's end."""
        split = [text.encode("utf-8", "replace").split(b"\n") for text in texts]
        starts = np.cumsum([0, *map(len, split)])
        if not split:
            return []
        evidence = self.evidence(codes([line for lines in split for line in lines]), starts[:-1]).tolist()
        scores = []
        for n, lines in enumerate(split):
            chances = self.chain(evidence[starts[n] : starts[n + 1]])
            sizes = [len(line) + 1 for line in lines]
            scores.append(min(1.0, sum(c * s for c, s in zip(chances, sizes, strict=True)) / sum(sizes)))
        return scores


def _blank(labels: list[int]) -> Model:
    """Without two kinds of labels every line is good with the share of good labels, or one half without any."""
    share = min(max(float(np.mean(labels)), 0.01), 0.99) if labels else 0.5
    flat = np.zeros((len(MEASURES), RANGES))
    return Model(flat, flat, flat, log(share / (1 - share)), 0.0, np.zeros((2, 2)), learned=False)


def train(
    sequences: list[np.ndarray], labels: list[int], turns: int = 200, rate: float = 0.2, ridge: float = 0.0005, around: list[tuple[int, int]] | None = None
) -> Model:
    """Maximum likelihood with every line labelled as its text, by Adam over forward and backward sums of all texts at once.

    ``around`` tells how many lines (0 or 1) at the start and end of each sequence are only neighbours of a run.
    """
    if len(set(labels)) < 2:
        return _blank(labels)
    order = sorted(range(len(sequences)), key=lambda n: (len(sequences[n]), n))
    groups = [order[n : n + 500] for n in range(0, len(order), 500)]
    m, size = len(MEASURES), len(MEASURES) * RANGES
    around = around or [(0, 0)] * len(sequences)
    padded = []
    for group in groups:
        lengths = np.array([len(sequences[n]) - sum(around[n]) for n in group])
        longest = int(lengths.max())
        places = np.full((len(group), longest + 2, m), -1, dtype=np.int64)
        for row, n in enumerate(group):
            first_place = 1 - around[n][0]
            places[row, first_place : first_place + len(sequences[n])] = sequences[n] + np.arange(m) * RANGES
        opens = np.array([1.0 - around[n][0] for n in group])
        padded.append((places, np.arange(longest) < lengths[:, None], np.array([labels[n] for n in group], dtype=float), opens))
    theta = np.zeros(3 * size + 6)  # own, before, after, bias, start, four steps
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    lines = sum(len(s) - sum(a) for s, a in zip(sequences, around, strict=True))
    for turn in range(1, turns + 1):
        slope = -ridge * theta
        for places, live, label, opens in padded:
            slope += _slope(theta, places, live, label, size, opens) / lines * 10
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    own, before, after = (theta[k * size : (k + 1) * size].reshape(m, RANGES) for k in range(3))
    return Model(own, before, after, float(theta[3 * size]), float(theta[3 * size + 1]), theta[3 * size + 2 :].reshape(2, 2))


def _slope(theta: np.ndarray, places: np.ndarray, live: np.ndarray, label: np.ndarray, size: int, opens: np.ndarray | float = 1.0) -> np.ndarray:
    """Gradient of the log likelihood: what the labels count, less what the chain expects; ``opens`` is 1 where a text begins."""
    longest = live.shape[1]
    evidence = np.full(live.shape, theta[3 * size])
    for k, shift in enumerate((1, 0, 2)):
        weights = np.append(theta[k * size : (k + 1) * size], 0.0)  # place -1 is no line
        evidence = evidence + weights[places[:, shift : shift + longest]].sum(axis=2)
    evidence[:, 0] += theta[3 * size + 1] * opens
    steps = theta[3 * size + 2 :].reshape(2, 2)
    scores = np.stack([np.zeros_like(evidence), evidence], axis=2)
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, longest):
        reached = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + scores[:, t]
        ahead[:, t] = np.where(live[:, t, None], reached, ahead[:, t - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        onward = scores[:, t + 1] + back[:, t + 1]
        left = np.logaddexp(steps[:, 0] + onward[:, :1], steps[:, 1] + onward[:, 1:])
        back[:, t] = np.where(live[:, t + 1, None], left, 0.0)
    good = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])
    gap = np.where(live, label[:, None] - good, 0.0)
    slope = np.zeros_like(theta)
    for k, shift in enumerate((1, 0, 2)):
        at = places[:, shift : shift + longest]
        counted = np.bincount((at + 1).reshape(-1), np.repeat(gap.reshape(-1), at.shape[2]), minlength=size + 1)
        slope[k * size : (k + 1) * size] = counted[1 : size + 1]
    slope[3 * size] = gap.sum()
    slope[3 * size + 1] = (gap[:, 0] * opens).sum()
    pairs = live[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            expected = np.exp(ahead[:, :-1, i] + steps[i, j] + scores[:, 1:, j] + back[:, 1:, j] - total[:, None])
            seen = (label == j)[:, None] & (i == j)
            slope[3 * size + 2 + 2 * i + j] = np.where(pairs, seen - expected, 0.0).sum()
    return slope


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 by 4; such rows are not learned from. False for null."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled documents that are not held out, taken in the order of a hash of the key.

    Only keys with a text are taken. Of a text of over 64 lines a run of 64 counts, from a place by a hash of the key,
    with the lines next to it as neighbours. The sample's size is bounded, so its keys are broadcast and its line ranges
    are brought to the driver: at most 66 lines of 8 bytes for each. Of several labels for a key the smallest counts, and of several
    texts the one with the smallest hash; null keys and labels are left out.
    """
    known = labels.select(F.col(quoted(key)).alias("key"), F.col(quoted(label)).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.min("label").alias("label"))
    read = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).where("text IS NOT NULL")
    picked = known.join(read.select("key").distinct(), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(sample)
    lines = F.regexp_count("text", F.lit("\n")) + 1
    start = F.when(lines > SAMPLE_LINES, F.pmod(F.xxhash64(F.lit("run"), "key"), lines - SAMPLE_LINES + 1)).otherwise(0).cast("long")

    @F.pandas_udf("binary")
    def ranges(texts: pd.Series, starts: pd.Series) -> pd.Series:
        runs = (t.encode("utf-8", "replace").split(b"\n")[max(at - 1, 0) : at + SAMPLE_LINES + 1] for t, at in zip(texts, starts, strict=True))
        return pd.Series([codes(run).tobytes() for run in runs], dtype=object)

    met = read.join(F.broadcast(picked), "key").groupBy("key").agg(F.min("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = met.select("key", "label", ranges("text", start).alias("ranges"), start.alias("start")).collect()
    rows = sorted((r["key"], r["label"], bytes(r["ranges"]), r["start"]) for r in rows)
    sequences = [np.frombuffer(r[2], np.int8).reshape(-1, len(MEASURES)).astype(np.int64) for r in rows]
    before = [int(r[3] > 0) for r in rows]
    around = [(b, int(len(s) - b > SAMPLE_LINES)) for s, b in zip(sequences, before, strict=True)]
    return train(sequences, [r[1] for r in rows], around=around)


def score(text: Column, model: Model) -> Column:
    """Quality of a text from 0 to 1; null counts as empty, which is one empty line."""

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = ["" if t is None else t for t in texts]
            yield pd.Series([s for n in range(0, len(given), 500) for s in model.scores(given[n : n + 500])], dtype="float64")

    return rate(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, held_out, score, predicted (1 from a score of 0.7 on).

    Only the text decides a score. Lines are labelled by the chain, neighbours' features included, and the marginals of
    all lines, weighted by length, are the document's score. Documents are scored where they lie.

    Null texts count as empty and get the score of one empty line. Null keys are not held out. Repeated rows are scored
    one by one. Extra columns are ignored, whatever their names. Without labels of both kinds every score is the share of
    good labels. Empty tables give no rows.
    """
    model = fit(docs, labels, key, text, label)
    scored = docs.select(F.col(quoted(key)).alias(key), held_out(F.col(quoted(key))).alias("held_out"), score(F.col(quoted(text)), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that are predicted good, with their columns as they come; cases as in ``classify``.

    Without labels of both kinds there is nothing to judge by, and all documents stay.
    """
    model = fit(docs, labels, key, text, label)
    return docs.where(score(F.col(quoted(text)), model) >= GOOD) if model.learned else docs
