"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of their reduced forms."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from math import ceil, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.text import quoted
from touchline.session import stage

#: Runs of letters, after A-Z are in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")
#: One run in so many, by the checksum of document and run, loses a code point.
SLIP = 97
LEAST_SIZE, LEAST_COUNT = 5, 3
#: Characters of a text that are split at a time; words that a task counts before it hands them on.
TEXT_AT_ONCE, COUNTED_AT_ONCE = 1 << 20, 1 << 18
#: Reduced neighbours that a task holds at a time, and the size up to which a word goes with each of them.
KEYS_AT_ONCE = 1 << 20
CARRIED_SIZE = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z in lower case, some at a time; no run is cut."""
    lowered = text.encode("utf-8", "replace").lower().decode()
    begin = 0
    while begin < len(lowered):
        gap = _BREAK.search(lowered, begin + TEXT_AT_ONCE)
        end = gap.start() if gap else len(lowered)
        yield RUN.findall(lowered, begin, end)
        begin = end


def slipped(run: str, seed: int) -> str:
    """A run as it is counted: without one code point if the checksum of document and run says so."""
    found = crc32(run.encode(), seed)
    if found % SLIP:
        return run
    at = found % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_size: int = LEAST_SIZE, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts with ``least_size`` code points and ``least`` occurrences.

    Tasks count before they shuffle. A null text has no words, and a null key is the empty text in the checksum.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for name, whole in zip(batch.column(0), batch.column(1), strict=True):
                seed = crc32(f"{name.as_py() or ''}:".encode())
                for some in runs(whole.as_py() or ""):
                    for run, n in Counter(some).items():
                        word = slipped(run, seed)
                        if len(word) >= least_size:
                            held[word] += n
                    if len(held) >= COUNTED_AT_ONCE:
                        yield flushed()
        yield flushed()

    read = docs.select(F.col(quoted(key)).cast("string").alias("key"), F.col(quoted(text)).alias("text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbols(size: int, bits: int) -> int:
    """How many symbols letters are reduced to in words of a size, so that there are about 2**bits reduced words of it; at most 32."""
    return min(32, max(2, ceil(2 ** (bits / size))))


class Alphabet:
    """Which symbol each letter is reduced to, for any number of symbols.

    Letters are dealt to symbols in the order of their frequency, each to the symbol with the least so far, so that symbols are
    about equally frequent. The deal changes the cost and never the result.
    """

    def __init__(self, letters: Sequence[tuple[str, int]]):
        self.letters = sorted(letters, key=lambda found: (-found[1], found[0]))
        self.points = np.array(sorted(ord(c) for c, _ in self.letters), dtype=np.uint32)
        self.dealt: dict[int, np.ndarray] = {}

    def _deal(self, count: int) -> np.ndarray:
        symbols = np.zeros(len(self.points), dtype=np.uint64)
        heap = [(0, s) for s in range(1, count + 1)]
        for letter, n in self.letters:
            load, symbol = heapq.heappop(heap)
            symbols[np.searchsorted(self.points, ord(letter))] = symbol
            heapq.heappush(heap, (load + n, symbol))
        return symbols

    def reduce(self, points: np.ndarray, count: int) -> np.ndarray:
        """The symbols 1 to ``count`` of letters."""
        if count not in self.dealt:
            self.dealt[count] = self._deal(count)
        return self.dealt[count][np.searchsorted(self.points, points)]


def alphabet(words: DataFrame) -> Alphabet:
    """The letters of the words with their frequency: one row per letter comes to the driver, as many as the alphabet has."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    return Alphabet([(r["letter"], r["n"]) for r in letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()])


def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, dtype=np.uint64)]), dtype=np.uint64)


def reduced_keys(points: np.ndarray, letters: Alphabet, bits: int) -> np.ndarray:
    """One number for the reduced form of each word; ``points`` has a row of code points for each word of one size."""
    size = points.shape[1]
    return (letters.reduce(points, symbols(size, bits)) * _powers(size)[:size]).sum(axis=1, dtype=np.uint64) + _salt(size)


def _salt(size: int) -> np.uint64:
    return np.uint64(size * 0x5851F42D4C957F2D % (1 << 64))


def neighbour_keys(points: np.ndarray, letters: Alphabet, bits: int, least_size: int = LEAST_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the one-edit neighbours of each word's reduced form, itself first, and how many each word has.

    A neighbour is reduced to the symbols of its own size. Of two neighbours one makes the other: the longer one by a deletion, and of one size the one
    with the smaller symbol by a replacement, so the neighbourhoods of all words together are full and each link is made once.
    Of equal symbols in a row the last is deleted.
    """
    words, size = points.shape
    power = _powers(size + 1)
    made, live = [], []

    def put(keys: np.ndarray, kept: np.ndarray) -> None:
        made.append(keys.reshape(words, -1))
        live.append(np.broadcast_to(kept, keys.shape).reshape(words, -1))

    count = symbols(size, bits)
    own = letters.reduce(points, count)
    whole = (own * power[:size]).sum(axis=1, dtype=np.uint64) + _salt(size)
    put(whole[:, None], np.ones((words, 1), bool))
    for s in range(2, count + 1):
        symbol = np.uint64(s)
        put(whole[:, None] + (symbol - own) * power[:size], own < symbol)
    if size - 1 >= max(least_size, 1):
        own = letters.reduce(points, symbols(size - 1, bits))
        before, after = _sums(own, power)
        put(before[:, :size] + after[:, 1:] * _BACK + _salt(size - 1), np.concatenate([own[:, 1:] != own[:, :-1], np.ones((words, 1), bool)], axis=1))
    keys, kept = np.concatenate(made, axis=1), np.concatenate(live, axis=1)
    return keys[kept], kept.sum(axis=1)


def _sums(own: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over the symbols before each place, and over those from it on; one place more than symbols."""
    size = own.shape[1]
    upto = np.cumsum(own * power[:size], axis=1, dtype=np.uint64)
    before = np.concatenate([np.zeros((len(own), 1), np.uint64), upto], axis=1)
    return before, before[:, -1:] - before


def _by_size(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Rows of words of one size at a time, so many that ``width`` numbers for each place of a word stay few."""
    listed = batch.column(0).to_pylist()
    sizes = np.array([len(w) for w in listed], dtype=np.int64)
    for size in np.unique(sizes).tolist():
        chosen = np.flatnonzero(sizes == size)
        step = max(1, KEYS_AT_ONCE // (size * width))
        for begin in range(0, len(chosen), step):
            some = chosen[begin : begin + step]
            points = np.array([np.frombuffer(listed[i].encode("utf-32-le"), np.uint32) for i in some]).reshape(len(some), size)
            yield pa.array(some), points


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def near_pairs(words: DataFrame, bits: int, least_size: int = LEAST_SIZE) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words that are exactly one inserted, deleted or replaced code point apart.

    Letters are hashed to a few symbols, fewer for longer words. The one-edit neighbourhoods of the reduced words are joined with
    the reduced words, and what meets is verified on the words themselves. A word one edit from another is
    also at most one edit from it when both are reduced, so no pair is missed. A probe carries its word if that has up to
    64 code points; longer words are joined back by a hash before they are compared, so hashes that are equal by chance change nothing.
    Joins are sorted on both sides: the vocabulary grows with the corpus, and a broadcast of it goes through the driver.
    """
    letters = alphabet(words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, points in _by_size(batch, 4):
                yield pa.RecordBatch.from_arrays([_signed(reduced_keys(points, letters, bits)), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "near", "near_n"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, points in _by_size(batch, 2 * symbols(least_size, bits)):
                keys, counts = neighbour_keys(points, letters, bits, least_size)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.ListArray.from_arrays(offsets, _signed(keys))], ["word", "n", "keys"])

    indexed = stage(words.select("word", "n").mapInArrow(index, "key long, near string, near_n long"), "reduced")
    opened = words.select("word", "n").mapInArrow(probe, "word string, n long, keys array<long>")
    one_apart = (F.levenshtein("word", "near", 1) == 1) & (F.col("word") != F.col("near"))
    short, long = F.length("word") <= CARRIED_SIZE, F.length("word") > CARRIED_SIZE
    at_once = opened.where(short).select("word", "n", F.posexplode("keys").alias("place", "key")).join(indexed.hint("merge"), "key").where(one_apart)
    named = opened.where(long).select(F.xxhash64("word").alias("id"), F.posexplode("keys").alias("place", "key")).join(indexed.hint("merge"), "key")
    later = named.join(words.where(long).select("word", "n", F.xxhash64("word").alias("id")).hint("merge"), "id").where(one_apart)
    found = [df.select("place", "word", "n", "near", "near_n") for df in (at_once, later)]
    here = F.struct("word", "n", "near", "near_n")
    there = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # words that are equal when reduced find each other; all others are found from one side
    return found[0].union(found[1]).select(F.explode(F.when(F.col("place") == 0, F.array(here)).otherwise(F.array(here, there))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms from a word ends. In each turn a word's root becomes that one's root, so a way of n
    forms takes about log n turns; each turn is a written table."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = at.select(F.col("word").alias("of"), F.col("root").alias("above"))
        moved = at.join(above.hint("merge"), F.col("root") == F.col("of"), "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        moved = stage(moved, "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_size: int = LEAST_SIZE, least: int = LEAST_COUNT, factor: int = 2, bits: int | None = None
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of all whole texts, A-Z in lower case, of which one in 97 by the checksum of document and run loses a
    code point; they have at least ``least_size`` code points and ``least`` occurrences. A word's form is the most frequent word
    exactly one edit away (ties: the smallest in code-point order) if that has ``factor`` times the word's occurrences, else null; its
    root is reached by following forms. ``bits`` sets how far words are reduced; by default there are about four times as many
    reduced words of a size as words. It changes the cost and never the result.

    Null and empty texts have no words; a null key counts as the empty text in the checksum. Rows are counted one by one, so repeated rows
    count again. Extra columns are ignored, whatever their names. Empty tables give no rows.
    """
    words = stage(vocabulary(docs, key, text, least_size, least), "words")
    if bits is None:
        bits = max(12, ceil(log2(words.count() + 1)) + 2)
    pairs = near_pairs(words, bits, least_size)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    found = stage(pairs.groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best), "near")
    fits = -F.col("best.less") >= factor * F.col("n")
    forms = stage(found.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(forms.where("form IS NOT NULL"))
    return (
        words.join(forms.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
    )
