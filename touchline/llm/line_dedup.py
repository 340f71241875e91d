"""Line deduplication with two Bloom filters: only lines that are suspected of repeating are shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm import bloom
from touchline.llm.text import BLANKS, quoted
from touchline.session import stage

#: Bits of the filters for each line, and the bits that one slice of them has at most (8 MB). A slice holds a range of hashes.
LINE_BITS = 8
SLICE_BITS = 1 << 26
#: Up to so many bits (32 MB, some 33 million lines) the slices are broadcast; beyond, hashes go to the task that holds their slice.
BROADCAST_BITS = 1 << 28
#: Bytes of text, or one longer text, and hashes that a task holds at a time.
TEXT_AT_ONCE = 1 << 22
HASHES_AT_ONCE = 1 << 20
_HASHES = 4
_STRIPPED = BLANKS.encode()


def line_keys(data: bytes) -> list[bytes]:
    """The key of every line: white space off both ends, A-Z in lower case."""
    return [line.strip(_STRIPPED).lower() for line in data.split(b"\n")]


def _name(key: bytes) -> bytes:
    """A key itself if short, else its SHA-256."""
    return key if len(key) < 32 else hashlib.sha256(key).digest()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


@dataclass(frozen=True)
class Shape:
    """How the filters are cut: ``slices`` ranges of hashes with a filter of ``bits`` bits each."""

    slices: int
    bits: int

    @classmethod
    def of(cls, lines: int, slice_bits: int = SLICE_BITS) -> Shape:
        """For so many lines: their number sizes the filters, so they are never fuller at one size of the input than at another."""
        wanted = max(1 << 16, LINE_BITS * lines)
        slices = -(-wanted // slice_bits)
        bits = min(slice_bits, 1 << (wanted - 1).bit_length()) if slices == 1 else slice_bits
        return cls(slices, bits)

    def slice_of(self, hashes: np.ndarray) -> np.ndarray:
        """The slice of each hash; it grows with the hash."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.slices) >> np.uint64(32)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The bits of each hash within its slice, one row for each. They come from all of its bits, as those of one slice begin alike."""
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return ((mixed[:, None] + step[:, None] * np.arange(_HASHES, dtype=np.uint64)) % np.uint64(self.bits)).astype(np.int64)


def _has(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (held[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=1)


def _put(held: np.ndarray, places: np.ndarray) -> None:
    flat = places.reshape(-1)
    np.bitwise_or.at(held, flat >> 3, np.left_shift(np.uint8(1), (flat & 7).astype(np.uint8)))


def _some_rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Few rows at a time by the bytes of their texts, so that a worker holds the lines of few texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + TEXT_AT_ONCE, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
        if end > begin:
            yield int(values[begin]), begin, end


def _fill(docs: DataFrame, shape: Shape) -> DataFrame:
    """(slice, once, more): the hashes of lines that one document of a part of a task has, or several do. 8 bytes for each line of a part."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emitted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            held.clear()
            rows = [(at, found[b:e][n[b:e] == 1].tobytes(), found[b:e][n[b:e] > 1].tobytes()) for at, b, e in _runs(shape.slice_of(found))]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["slice", "once", "more"])

        for some in _some_rows(batches, 0):
            held.append(_hashes([k for data in some.column(0) for k in set(line_keys(data.as_py() or b"")) if k]))
            if sum(map(len, held)) >= HASHES_AT_ONCE:
                yield emitted()
        yield emitted()

    return docs.mapInArrow(fill, "slice long, once binary, more binary")


def _seen_twice(docs: DataFrame, shape: Shape) -> DataFrame:
    """(slice, twice): for each range of hashes the filter of lines that at least two documents have.

    Each slice has two filters, for hashes seen once and for those seen again, and one task fills both from the hashes that
    all tasks send to it: a hash is in the second if it comes from several documents of a part, or is in the first when it comes. That
    holds in any order. All slices are filled at once, and a task holds one slice at a time.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.empty(0, np.uint8), np.empty(0, np.uint8)

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["slice", "twice"])

        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                if number != at:
                    if at is not None:
                        yield emitted()
                    at, once, twice = number, np.zeros(shape.bits // 8, np.uint8), np.zeros(shape.bits // 8, np.uint8)
                single, several = (shape.places(np.frombuffer(batch.column(c)[row].as_py(), np.uint64)) for c in (1, 2))
                _put(twice, single[_has(once, single)])
                _put(twice, several)
                _put(once, single)
                _put(once, several)
        if at is not None:
            yield emitted()

    return _fill(docs, shape).repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, twice binary")


def _line_count(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _suspected(made: list[tuple[int, bytes, int]], batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, text_hash, line_key, line) of some lines of a batch that begins with the columns key and text_hash."""
    rows = pa.array([row for row, _, _ in made], pa.int64())
    arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([_name(key) for _, key, _ in made], pa.binary()), pa.array([line for _, _, line in made], pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "text_hash", "line_key", "line"])


def _distinct_lines(texts: pa.Array) -> list[tuple[int, bytes, int]]:
    """(row, key, first line that has it) of the distinct lines of each text."""
    made = []
    for row, data in enumerate(texts):
        first: dict[bytes, int] = {}
        for line, key in enumerate(line_keys(data.as_py() or b"")):
            if key:
                first.setdefault(key, line)
        made += [(row, key, line) for key, line in first.items()]
    return made


def _suspects(read: DataFrame, filters: DataFrame, shape: Shape, key_type: str, broadcast_bits: int) -> DataFrame:
    """(key, text_hash, line_key, line) of each document's distinct lines that may repeat, with the first line that has them."""
    columns = f"key {key_type}, text_hash long, line_key binary, line int"
    if shape.slices * shape.bits > broadcast_bits:
        return _suspects_by_slice(read, filters, shape, columns)
    held = np.zeros(shape.slices * (shape.bits // 8), np.uint8)
    for row in filters.collect():  # at most ``broadcast_bits``
        begin = row["slice"] * (shape.bits // 8)
        held[begin : begin + shape.bits // 8] = np.frombuffer(row["twice"], np.uint8)
    twice = read.sparkSession.sparkContext.broadcast(held.tobytes())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(twice.value, np.uint8)
        for batch in _some_rows(batches, 2):
            lines = _distinct_lines(batch.column(2))
            hashes = _hashes([key for _, key, _ in lines])
            hit = np.flatnonzero(_has(held, shape.places(hashes) + shape.slice_of(hashes)[:, None] * shape.bits))
            yield _suspected([lines[i] for i in hit.tolist()], batch)

    return read.mapInArrow(probe, columns)


def _suspects_by_slice(read: DataFrame, filters: DataFrame, shape: Shape, columns: str) -> DataFrame:
    """The same where the filters are too large to be everywhere: the hashes of each text's lines go to the tasks that hold their slices.

    8 bytes for each line move. Equal texts ask once. Back come the hashes that are hits, by the hash of the text.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_rows(batches, 2):
            rows = []
            for text_hash, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = np.sort(_hashes([k for k in set(line_keys(data.as_py() or b"")) if k]))
                rows += [(at, text_hash, hashes[b:e].tobytes()) for at, b, e in _runs(shape.slice_of(hashes))]
            made = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slice", "text_hash", "hashes"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint8)
        for batch in batches:
            asked, hits = [], []
            for row in range(batch.num_rows):
                number, text_hash, content = (batch.column(c)[row].as_py() for c in (0, 1, 2))
                if text_hash is None:  # the filter comes before those who ask for it
                    at, held = number, np.frombuffer(content, np.uint8)
                elif number == at:
                    hashes = np.frombuffer(content, np.uint64)
                    hit = hashes[_has(held, shape.places(hashes))]
                    if len(hit):
                        asked.append(text_hash)
                        hits.append(hit.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(hits, pa.binary())], ["text_hash", "hits"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_rows(batches, 2):
            lines = _distinct_lines(batch.column(2))
            hashes = _hashes([key for _, key, _ in lines]).tolist()
            hits = [{h for part in some for h in np.frombuffer(part, np.uint64).tolist()} for some in batch.column(3).to_pylist()]
            yield _suspected([found for found, h in zip(lines, hashes, strict=True) if h in hits[found[0]]], batch)

    asked = read.mapInArrow(ask, "slice long, text_hash long, hashes binary").groupBy("slice", "text_hash").agg(F.first("hashes").alias("hashes"))
    held = filters.select("slice", F.lit(None).cast("long").alias("text_hash"), F.col("twice").alias("hashes"))
    met = held.union(asked).repartition("slice").sortWithinPartitions("slice", F.col("text_hash").asc_nulls_first())
    hits = stage(met.mapInArrow(answer, "text_hash long, hits binary").groupBy("text_hash").agg(F.collect_list("hits").alias("hits")), "hits")
    return read.join(hits, "text_hash").select("key", "text_hash", "data", "hits").mapInArrow(name, columns)


@F.pandas_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, dropped = [], []
    for text, repeated in zip(texts, drops, strict=True):
        data = text.encode()
        if repeated is None or not len(repeated):
            lines, left = [data], [data]
        else:
            spared = {bytes(r["line_key"]): r["spare"] for r in repeated}
            lines = data.split(b"\n")
            left = [line for n, (line, key) in enumerate(zip(lines, line_keys(data), strict=True)) if not key or spared.get(_name(key), n) == n]
        kept.append(b"\n".join(left).decode())
        dropped.append(len(lines) - len(left))
    return pd.DataFrame({"kept": kept, "n_dropped": dropped})


def drop_repeated(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 10,
    keep_first: bool = False,
    name: tuple[str, str] = ("n_lines", "n_dropped"),
    slice_bits: int = SLICE_BITS,
    broadcast_bits: int = BROADCAST_BITS,
) -> DataFrame:
    """The documents without the lines whose key at least ``least`` documents have, and how many lines each had and lost.

    With ``keep_first`` the first such line of the document with the smallest key stays. Two Bloom filters, sized by the number
    of lines and cut by ranges of hashes, tell which lines may repeat. Suspected lines are confirmed
    by exact counts; a key is compared by itself, or by its SHA-256 if it has 32 bytes or more. Since a dropped key is
    dropped everywhere, a document's keys are joined by a hash of its text: equal hashes only share lists of keys. Only
    documents that may lose a line move. Up to ``broadcast_bits`` of filters every task has them; beyond, hashes of lines go to them.

    A null text is an empty one, which is one empty line; empty lines always stay. Each row is a document, so rows that
    repeat count as often as they stand. Null keys are fine, and with ``keep_first`` come first. A column that has
    the name of a result, in any case of letters, is replaced; other columns are kept, whatever their names. Empty tables give no rows.
    """
    whole = F.coalesce(F.col(quoted(text)), F.lit(""))
    key_type = docs.schema[key].dataType.simpleString()
    columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in name}]
    read = docs.select(F.col(quoted(key)).alias("key"), F.xxhash64(whole).alias("text_hash"), whole.cast("binary").alias("data"))
    lines = docs.agg(F.sum(_line_count(whole))).first()[0] or 0
    shape = Shape.of(lines, slice_bits)
    filters = stage(_seen_twice(read.select("data"), shape), "filters")
    suspects = stage(_suspects(read, filters, shape, key_type, broadcast_bits), "suspects")
    first = F.min(F.struct("key", "line")).alias("first")
    repeated = stage(suspects.groupBy("line_key").agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") >= least).select("line_key", "first"), "repeated")
    drops = suspects.select("text_hash", "line_key").distinct().join(repeated, "line_key")
    drops = stage(drops.groupBy("text_hash").agg(F.collect_list(F.struct("line_key", "first")).alias("drops")), "drops")

    rows = docs.select(F.struct(*map(quoted, columns)).alias("row"), F.col(quoted(key)).alias("owner"), whole.alias("whole"), F.xxhash64(whole).alias("text_hash"))
    flagged = bloom.flag_hits(rows, "text_hash", bloom.build(drops, "text_hash"), "maybe")
    joined = flagged.where("maybe").join(drops, "text_hash", "left")
    spare = lambda d: F.when(F.lit(keep_first) & d["first"]["key"].eqNullSafe(F.col("owner")), d["first"]["line"]).otherwise(-1)
    listed = F.transform("drops", lambda d: F.struct(d["line_key"].alias("line_key"), spare(d).alias("spare")))
    touched = joined.select("row", "whole", _without(F.col("whole"), listed).alias("made"))
    touched = touched.select("row", "whole", F.col("made.kept").alias("kept"), F.col("made.n_dropped").alias("n_dropped"))
    untouched = flagged.where(~F.col("maybe")).select("row", "whole", F.col("whole").alias("kept"), F.lit(0).cast("long").alias("n_dropped"))
    made = untouched.unionByName(touched)
    shown = [F.col("kept").alias(c) if c.lower() == text.lower() else F.col("row")[c].alias(c) for c in columns]
    return made.select(*shown, _line_count(F.col("whole")).alias(name[0]), F.col("n_dropped").alias(name[1]))
