"""Alignment of two tokenizers: which tokens of the one cover the same bytes as which tokens of the other."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken import Encoding
from tokenizers import Tokenizer

from touchline.llm.bpe import _SPACE as _WHITE
from touchline.llm.bpe import PIECES, _printable_bytes, read_tokenizer
from touchline.llm.text import fresh, quoted
from touchline.session import stage

#: Characters of texts that are worked on at a time, or one longer text.
TEXT_AT_ONCE = 1 << 20
#: A group with more pairs of tokens than this is counted by its distinct ids, so many pairs at a time.
LARGE_GROUP = 1 << 10
PAIRS_AT_ONCE = 1 << 20
#: Up to so many counted id pairs (some 40 MB) the table of counts is broadcast; a larger one is joined by a shuffle.
COUNTS_BROADCAST = 1 << 20

_BITS = 20
_MARK = "▁"
_NOTHING = np.empty(0, np.int64)
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_times")
#: White space that long is left to the slower library: the faster one looks ahead over it by recursion.
_LONG_GAP = re.compile(f"[{_WHITE}]{{256}}")


class Aligner:
    """Two tokenizers over a text with a space before it: A byte-level, B by pieces, which puts that space there itself.

    Where the ids of A's tokens rise with the ranks of the merges that make them, as a library of ranks expects, that library encodes A.
    """

    def __init__(self, byte_file: str, piece_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        described, byte_of = json.loads(byte_file), _printable_bytes()
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        vocabulary = {token: n for token, n in described["model"]["vocab"].items() if token not in special}
        left_bytes = {n: bytes(byte_of[c] for c in token) for token, n in vocabulary.items()}
        left_bytes |= {n: token.encode() for token, n in special.items()}
        count = max(left_bytes) + 1
        self.left_sizes = np.array([len(left_bytes.get(n, b"")) for n in range(count)])
        self.plain = Tokenizer.from_str(byte_file)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        made = [vocabulary[left + right] for left, right in merges]
        self.ranked = None
        if made == sorted(set(made)) and len(made) + 256 == len(vocabulary) and (not made or made[0] >= 256):
            self.ranked = Encoding("left", pat_str=PIECES, mergeable_ranks={left_bytes[n]: n for n in vocabulary.values()}, special_tokens={})
        self.right = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        self.right_bytes = [self._piece_bytes(n) for n in range(self.right.get_piece_size())]
        self.right_sizes = np.array([len(b) for b in self.right_bytes])
        normal = "".join(map(chr, [*range(1, 0x250), 0x301, 0x3000, 0xFB01, 0xFF21, 0x1F642])) + "  e\u0301 A "
        self.same = self._joined(self.right.encode(normal)) == (" " + normal).encode()
        self.names = _names(count, b"|") + _names(len(self.right_bytes), b";")

    def _piece_bytes(self, number: int) -> bytes:
        piece = self.right.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.right.is_byte(number) else piece.replace(_MARK, " ").encode()

    def _joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.right_bytes.__getitem__, ids))

    def _left(self, spaced: str) -> list[int]:
        if self.ranked is None or _LONG_GAP.search(spaced):
            return self.plain.encode(spaced, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(spaced)

    def tokens(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by A and B; none unless the bytes of either's tokens are those of the text with a space before it.

        Special tokens are not looked for: their strings are text like any other.
        """
        return [self._pair(t, b) if t else (_NOTHING, _NOTHING) for t, b in zip(texts, self.right.encode([t or "" for t in texts], num_threads=1), strict=True)]

    def _pair(self, text: str, found: list[int]) -> tuple[np.ndarray, np.ndarray]:
        spaced = " " + text
        whole = spaced.encode("utf-8", "replace")
        a, b = np.array(self._left(spaced), dtype=np.int64), np.array(found, dtype=np.int64)
        # tokens that are cut out of the text's bytes have them if they have their size; B changes none but its own mark
        kept = self.left_sizes[a].sum() == len(whole) and self.right_sizes[b].sum() == len(whole)
        if kept and (not self.same or _MARK in text):
            kept = self._joined(found) == whole
        return (a, b) if kept else (_NOTHING, _NOTHING)


@lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: bytes) -> Aligner:
    """Built once per worker."""
    return Aligner(byte_file, piece_file)


def _names(count: int, ends: bytes) -> list[bytes]:
    """Each id as written before a comma, and from ``count`` on as written at the end of a side of a group."""
    return [b"%d," % n for n in range(count)] + [b"%d%b" % (n, ends) for n in range(count)]


@dataclass(frozen=True)
class Side:
    """The tokens of one tokenizer over several documents: ids, the document of each, and where its bytes begin."""

    ids: np.ndarray
    row: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray], sizes: np.ndarray) -> Side:
        ids = np.concatenate([np.empty(0, np.int64), *lists])
        length = sizes[ids]
        return cls(ids, np.repeat(np.arange(len(lists)), [len(some) for some in lists]), np.cumsum(length) - length)

    def covered(self, other: Side) -> np.ndarray:
        """For each token the token of the other side that holds its first byte."""
        mine = pd.DataFrame({"row": self.row, "at": self.at})
        theirs = pd.DataFrame({"row": other.row, "at": other.at, "token": np.arange(len(other.at))})
        return pd.merge_asof(mine, theirs, on="at", by="row")["token"].to_numpy(dtype=np.int64)


def grouped(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token of either side.

    A token and the token that covers its start overlap, and taken from both sides these are all overlaps. Where
    both begin at the same byte the tokens before them end together, and a group begins.
    """
    opens_a = b.at[a.covered(b)] == a.at
    opens_b = a.at[b.covered(a)] == b.at
    return np.cumsum(opens_a) - 1, np.cumsum(opens_b) - 1


def links(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, large: int = LARGE_GROUP, at_once: int = PAIRS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids in one group as (row, a, b) in one number, sorted, and how many pairs of tokens each stands for."""
    count = int(group_a[-1]) + 1 if len(group_a) else 0
    in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    small = in_a * in_b <= large

    keys, times = [], []
    chosen = np.flatnonzero(small[group_a])
    repeats = in_b[group_a[chosen]]
    token = np.repeat(chosen, repeats)
    place = np.arange(len(token)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    found, n = np.unique(_key(a.row[token], a.ids[token], b.ids[first_b[group_a[token]] + place]), return_counts=True)
    keys.append(found)
    times.append(n)
    for g in np.flatnonzero(~small):
        ids_a, n_a = np.unique(a.ids[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b.ids[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        step = max(1, at_once // len(ids_b))
        for begin in range(0, len(ids_a), step):
            part, n_part = ids_a[begin : begin + step], n_a[begin : begin + step]
            keys.append(_key(a.row[first_a[g]], np.repeat(part, len(ids_b)), np.tile(ids_b, len(part))))
            times.append(np.outer(n_part, n_b).reshape(-1))
    if len(keys) == 1:
        return found, n
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, where, np.concatenate(times))
    return found, total


def _key(row, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return row << (2 * _BITS) | a << _BITS | b


def _written(made: Aligner, a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, rows: int) -> list[str]:
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    closes_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    closes_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    count = int(group_a[-1]) + 1 if len(group_a) else 0
    before_b = np.cumsum(np.bincount(group_b, minlength=count)) - np.bincount(group_b, minlength=count)
    upto_a = np.cumsum(np.bincount(group_a, minlength=count))
    codes = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
    shift = 2 * len(made.left_sizes)
    codes[np.arange(len(a.ids)) + before_b[group_a]] = a.ids + closes_a * len(made.left_sizes)
    codes[np.arange(len(b.ids)) + upto_a[group_b]] = b.ids + closes_b * len(made.right_sizes) + shift
    named = made.names.__getitem__
    ends = np.cumsum(np.bincount(a.row, minlength=rows) + np.bincount(b.row, minlength=rows))
    starts = [0, *ends[:-1].tolist()] if rows else []
    return [b"".join(map(named, codes[s:e].tolist()))[:-1].decode() for s, e in zip(starts, ends.tolist(), strict=True)]


def _aligned(made: Aligner, texts: list[str | None]) -> list[pa.Array]:
    """The columns ``RESULTS`` of some texts."""
    pairs = made.tokens(texts)
    a, b = Side.of([p[0] for p in pairs], made.left_sizes), Side.of([p[1] for p in pairs], made.right_sizes)
    group_a, group_b = grouped(a, b)
    keys, times = links(a, b, group_a, group_b)
    rows = len(texts)
    of_row = keys >> (2 * _BITS)
    offsets = np.searchsorted(of_row, np.arange(rows + 1))
    total = np.concatenate([[0], np.cumsum(times)])
    opened = np.append(True, group_a[1:] != group_a[:-1])[: len(group_a)]
    mask = (1 << _BITS) - 1
    listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    return [
        pa.array(np.bincount(a.row, minlength=rows)),
        pa.array(np.bincount(b.row, minlength=rows)),
        pa.array(np.bincount(a.row[opened], minlength=rows)),
        pa.array(total[offsets[1:]] - total[offsets[:-1]]),
        pa.array(_written(made, a, b, group_a, group_b, rows), pa.string()),
        listed((keys >> _BITS & mask).astype(np.int32)),
        listed((keys & mask).astype(np.int32)),
        listed(times.astype(np.int64)),
    ]


def _slices(texts: pa.Array, at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with few texts each: a worker holds the tokens of one range."""
    begin, size = 0, 0
    for row, text in enumerate(texts):
        length = len(text.as_py() or "")
        if size and size + length > at_once:
            yield begin, row
            begin, size = row, 0
        size += length
    if begin < len(texts):
        yield begin, len(texts)


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", at_once: int = TEXT_AT_ONCE) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, groups, link_a, link_b, link_times.

    A is the byte-level tokenizer of ``byte_path`` over a space and the text, B the piece model of ``piece_path``, which puts the
    space there itself. Per batch, keyed by document, an as-of join finds the B token that covers each A token's start, and another
    the A token that covers each B token's start; where both begin together a group begins. ``groups`` has each
    group's ids as ``a1,a2|b1;a3|b2,b3``. The tokens of one group are linked, each of A with each of B: ``link_a``, ``link_b`` are the
    document's distinct pairs of ids and ``link_times`` how many links each is. Whole texts; rows don't move; memory is that
    of ``at_once`` characters or of one longer text.

    Null and empty texts, and those whose tokens don't give back their bytes by either tokenizer, have no tokens: zeros, an empty text and
    empty lists. Repeated rows repeat their result. Extra columns are ignored, whatever their names. Empty tables give no rows.
    """
    context = docs.sparkSession.sparkContext
    with open(piece_path, "rb") as file:
        shared = context.broadcast((read_tokenizer(byte_path), file.read()))  # two files of a few MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(*shared.value)
        for batch in batches:
            for begin, end in _slices(batch.column(1), at_once):
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([some.column(0), *_aligned(made, some.column(1).to_pylist())], [key, *RESULTS])

    whole = [T.StructField(name, T.LongType()) for name in RESULTS[:4]] + [T.StructField("groups", T.StringType())]
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in zip(RESULTS[5:], (T.IntegerType(), T.IntegerType(), T.LongType()), strict=True)]
    kept = docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("text"))
    return kept.mapInArrow(work, T.StructType([T.StructField(key, docs.schema[key].dataType), *whole, *lists]))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n, best) of all linked pairs of ids: how many documents hold the pair, and whether no pair of this ``a`` has more."""
    pairs = linked.select(F.explode(F.arrays_zip("link_a", "link_b")).alias("p")).select(F.col("p.link_a").alias("a"), F.col("p.link_b").alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("a"))  # at most one row per token of B
    return counted.select("a", "b", "n", (F.col("n") == most).alias("best"))


def with_counts(aligned: DataFrame, broadcast_upto: int = COUNTS_BROADCAST) -> DataFrame:
    """The rows of ``align`` without their lists, with n_best and count_sum.

    A pair's count is the number of rows that hold it linked. ``n_best`` are the links whose count is the highest of their A id,
    ties included; ``count_sum`` adds the counts of all links. Counting combines before the shuffle. Counts come to the
    links by a broadcast of at most ``broadcast_upto`` pairs or else by a join whose hot pairs adaptive execution splits. Rows
    without links have zeros. Other columns of the rows stay; one that has the name of a result is replaced.
    """
    row = fresh(aligned, "_row")
    kept = [c for c in aligned.columns if c.lower() not in ("link_a", "link_b", "link_times", "n_best", "count_sum")]
    given = stage(aligned.select(*map(quoted, kept), "link_a", "link_b", "link_times", F.monotonically_increasing_id().alias(row)), "links")
    counts = stage(pair_counts(given), "pairs")
    number = lambda a, b: (F.shiftleft(F.col(a).cast("long"), _BITS)).bitwiseOR(F.col(b).cast("long"))
    counts = counts.select(number("a", "b").alias("pair"), "n", "best")
    opened = given.select(row, F.explode(F.arrays_zip("link_a", "link_b", "link_times")).alias("p"))
    opened = opened.select(row, number("p.link_a", "p.link_b").alias("pair"), F.col("p.link_times").alias("times"))
    few = counts.limit(broadcast_upto + 1).count() <= broadcast_upto
    met = opened.join(F.broadcast(counts) if few else counts, "pair")
    sums = met.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = sums.withColumnRenamed(row, "_of")
    whole = given.select(*map(quoted, kept), row).join(sums, F.col(row) == F.col("_of"), "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return whole.select(*map(quoted, kept), zero("n_best"), zero("count_sum"))
