"""Byte-pair encoding by backtracking over longest tokens, and decoding by an offset table.

An encoding is the one that the merges give exactly if each two neighbours of it are compatible, that is, if the merges
of the two tokens' text give these two tokens. So the encoder takes the longest token at each place that it reaches, found
by the goto function of an Aho-Corasick automaton of all tokens, steps to the next shorter prefix token where the pair isn't compatible, and goes
back where none is left. A place that could not be continued is marked, so that no place is tried twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.text import quoted

#: Fixed: how the tokenizer files split a text before merging. White space is the Unicode property.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for ASCII texts, where the classes are ranges.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Entries of a worker's caches, the size of the longest piece kept, and rows at a time.
CACHED = 1 << 17
CACHED_PAIRS = 1 << 17
CACHED_SIZE = 64
ROWS_AT_ONCE = 256
DECODED_AT_ONCE = 1 << 18


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the tokenizer files: itself where printable, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Known(dict):
    """Tokens of pieces seen before. When full, the entries become the old ones, from which those still in use come back.
    Long pieces are not kept."""

    def __init__(self, made: Codec):
        super().__init__()
        self.made, self.old = made, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self.old.get(piece)
        if tokens is None:
            tokens = tuple(self.made.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHED_SIZE:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = tokens
        return tokens


def _pair(left: int, right: int) -> int:
    return left << 20 | right


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str):
        described = json.loads(content)
        byte_of = _printable_bytes()
        self.text_of = {number: bytes(byte_of[c] for c in token) for token, number in described["model"]["vocab"].items()}
        id_of = {text: number for number, text in self.text_of.items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces, self.ascii_pieces = regex.compile(PIECES), re.compile(ASCII_PIECES)

        self.merged: dict[int, int] = {}  # pair -> rank
        self.made_of: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, merge in enumerate(described["model"]["merges"]):
            left, right = (id_of[bytes(byte_of[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            token = id_of[self.text_of[left] + self.text_of[right]]
            if _pair(left, right) not in self.merged:
                self.merged[_pair(left, right)] = rank
                self.made_of.setdefault(token, (rank, left, right))

        self.token_of = {text.decode("latin-1"): number for text, number in id_of.items()}
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for shown, number in self.token_of.items():
            self.matcher.add_word(shown, number)
        self.reach = max(map(len, id_of))
        self.size_of = {number: len(text) for text, number in id_of.items()}
        self.shorter = dict.fromkeys(self.size_of, -1)  # token -> the longest token that is a proper prefix of it
        for text, number in id_of.items():
            for size in range(len(text) - 1, 0, -1):
                if text[:size] in id_of:
                    self.shorter[number] = id_of[text[:size]]
                    break
        self.compatible: dict[int, bool] = {}
        self.known = _Known(self)

        top = max([*self.text_of, *self.special.values()]) + 1
        parts = [self.text_of.get(n, b"") for n in range(top)]
        for text, number in self.special.items():
            parts[number] = text.encode()
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in parts])
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of two tokens gives these two tokens: kept in the pair table once found.

        Undo the merges that touch the border, the later one first. A merge across the border that comes before the undone
        one would have been made instead, and the pair would not stand.
        """
        pair = _pair(left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        merged, made_of = self.merged, self.made_of
        undone, side = len(merged), 0
        while True:
            across = merged.get(left << 20 | right)
            # an equal rank is the same merge on both sides, made from the left
            if across is not None and (across < undone or across == undone and side == 1):
                return False
            a, b = made_of.get(left), made_of.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                undone, side, left = a[0], 0, a[2]
            else:
                undone, side, right = b[0], 1, b[1]

    def longest(self, shown: str) -> int:
        """The longest token that a text begins with: the automaton follows it as far as any token goes, and steps back."""
        size = self.matcher.longest_prefix(shown)
        token = self.token_of.get(shown[:size])
        while token is None:
            size -= 1
            token = self.token_of.get(shown[:size])
        return token

    def merge(self, data: bytes) -> list[int]:
        """The tokens that the merges make of a piece, in time linear in its size."""
        shown, size_of, shorter, compatible, reach = data.decode("latin-1"), self.size_of, self.shorter, self.compatible, self.reach
        tokens: list[int] = []
        closed = None
        at, end = 0, len(shown)
        token = self.longest(shown[:reach])
        while True:
            stop = at + size_of[token]
            if not (closed and closed[stop]):
                last = tokens[-1] if tokens else -1
                fits = last < 0 or compatible.get(last << 20 | token)
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    tokens.append(token)
                    if stop == end:
                        return tokens
                    at = stop
                    token = self.longest(shown[at : at + reach])
                    continue
            token = shorter[token]
            while token < 0:  # no token continues here: drop the last one, and try its next shorter
                closed = closed or bytearray(end + 1)
                closed[at] = 1
                at -= size_of[tokens[-1]]
                token = shorter[tokens.pop()]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        parts = []
        for section in self.special_split.split(text) if self.special_split else [text]:
            if section in self.special:
                parts.append(np.array([self.special[section]], dtype=np.int32))
            elif section:
                pieces = self.ascii_pieces if section.isascii() else self.pieces
                tokens = chain.from_iterable(map(self.known.__getitem__, pieces.findall(section)))
                parts.append(np.fromiter(tokens, dtype=np.int32))
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        data = []
        for begin in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[begin : begin + DECODED_AT_ONCE]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            data.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[some] - ends + sizes, sizes)].tobytes())
        return b"".join(data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(content: str) -> Codec:
    """Built once per worker."""
    return Codec(content)


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read by the driver; a few MB."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds the ids of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _id_lists(made: Codec, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    lists = [made.encode(t.as_py() or "") for t in texts]
    offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
    return lists, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists), pa.int32()))


def tokenize(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their token ids in a further column. Rows don't move, and memory is that of a few texts.

    The result is that of the tokenizer library without special tokens added; a special token's text in a document gives its id.
    Null texts count as empty and have no ids. Rows are independent, so repeated rows repeat their result. A column
    that has the name of the result, in any case of letters, is replaced; others stay, whatever their names. Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() != ids.lower()])
    at = [c.lower() for c in kept.columns].index(text.lower())
    plain = kept.toDF(*[f"c{n}" for n in range(len(kept.columns))])  # as a name may hold a point, which Spark would take for a field

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(shared.value)
        for batch in _slices(batches):
            yield batch.append_column("ids", _id_lists(made, batch.column(at))[1])

    made = plain.mapInArrow(encode, T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return made.toDF(*kept.columns, ids)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids, decoded; cases as in ``tokenize``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(shared.value)
        for batch in _slices(batches):
            lists, ids = _id_lists(made, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([made.decode(some) for some in lists], pa.string())], [key, "ids", "decoded"])

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("text")).mapInArrow(both, T.StructType(fields))
