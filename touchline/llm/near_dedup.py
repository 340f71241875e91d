"""Near-duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import bloom
from touchline.llm.components import connect
from touchline.llm.text import quoted
from touchline.session import stage

SHINGLE = 5
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: 32 bands of 4 bins: two texts at the threshold miss every bucket with a chance of (1 - 0.75**4)**32, five in a million.
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Bits of a set's parity map, in 64-bit words; and how the number of centres that a bucket elects grows by round.
PARITY_WORDS = 16
MORE_CENTRES = 32
#: A star's members are checked in parts of about so many.
STAR_PART = 512
_SEED = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles. bytes.split and bytes.lower know ASCII only, as is wanted."""
    words = data.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    if not width:
        return hashes
    count = len(words) - width + 1
    rolled = np.full(count, width, dtype=np.uint64)
    for offset in range(width):
        rolled = rolled * _STEP + hashes[offset : offset + count]
    return np.unique(_mixed(rolled))


def _choices() -> np.ndarray:
    """For each empty bin an order of all bins, from which it borrows the first that is filled."""
    return np.random.default_rng(_SEED).random((BINS, BINS))


def signature(shingles: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """One-permutation hashing: the smallest hash of each bin. An empty bin borrows from a filled one that is chosen by a
    random order of its own (optimal densification), so that equal places agree with the chance of the similarity."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    made = np.empty(BINS, dtype=np.uint64)
    made[filled] = shingles[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        made[empty] = made[filled[np.argmin(choices[np.ix_(empty, filled)], axis=1)]]
    return made


def band_keys(made: np.ndarray) -> np.ndarray:
    """One key per band, which also tells bands apart."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in made.reshape(BANDS, ROWS).T:
        key = _mixed(key * _STEP + column)
    return key.view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit, so two sets differ in at least as many shingles as their maps differ in bits."""
    flips = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _may_link(words: str, n: str, other_words: str, other_n: str) -> Column:
    """False only for pairs that are surely no link: with d shingles in one set only, the similarity is (n + m - d) / (n + m + d)."""
    differ = sum((F.bit_count(F.col(words)[i].bitwiseXOR(F.col(other_words)[i])) for i in range(PARITY_WORDS)), F.lit(0))
    total = F.col(n) + F.col(other_n)
    return 100 * (total - differ) >= PERCENT * (total + differ)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    choices = _choices()
    for batch in batches:
        sizes, digests, bands, maps = [], [], [], []
        for data in batch.column(2):
            shingles = shingle_set(data.as_py())
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            maps.append(parity(shingles))
            bands.append(band_keys(signature(shingles, choices)) if len(shingles) else np.empty(0, np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
        values = pa.array(np.concatenate([np.empty(0, np.int64), *bands]))
        arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values), pa.array(maps, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "text_hash", "n", "digest", "bands", "parity"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by star part, the centre first; the pairs that are similar enough, checked on their whole sets."""
    star, middle = None, np.empty(0, np.uint64)
    for batch in batches:
        centres, nodes = [], []
        for centre, part, node, data in zip(*(batch.column(c) for c in range(4)), strict=True):
            at = (centre.as_py(), part.as_py())
            if node.as_py() is None:
                star, middle = at, shingle_set(data.as_py())
                continue
            if at != star:
                raise RuntimeError(f"no centre came before the members of {at}")
            other = shingle_set(data.as_py())
            shared = len(np.intersect1d(middle, other, assume_unique=True))
            if 100 * shared >= PERCENT * (len(middle) + len(other) - shared):
                centres.append(at[0])
                nodes.append(node.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(centres, pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (centre, node) that are links. A star of any size is dealt out in parts; a centre's text goes to each part once."""
    parts = stage(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).cast("int").alias("parts")), "parts")
    members = pairs.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = members.join(texts, "node").select("centre", "part", "node", "data")
    centres = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    centres = centres.join(texts.withColumnRenamed("node", "centre"), "centre").select("centre", "part", F.lit(None).cast("long").alias("node"), "data")
    rows = members.unionByName(centres).repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("node").asc_nulls_first())
    return stage(rows.mapInArrow(_confirm, "a long, b long"), "confirmed")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, node, n, degree) in buckets of at least two; degree is how many bucket mates a node has in all."""
    rows = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = stage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"), "buckets")
    members = stage(rows.join(shared, "bucket"), "members")
    degrees = stage(members.groupBy("node").agg(F.sum("mates").alias("degree")), "degrees")
    return stage(members.join(degrees, "node").select("bucket", "node", "n", "degree", F.col("node").alias("label")), "members")


def _labels(classes: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """(node, label) of the classes that are linked with another.

    In each round the buckets elect centres and only pairs of a centre and a member are checked, so a bucket of m members
    gives at most m pairs per centre. A centre that has been checked leaves, and a bucket ends when all that is left of
    it is in one component. The first round takes one centre, the best connected member, which for a group of near copies is about its
    middle and links most of them. The next rounds are for members that are still apart: more centres, dealt out by hash, and
    of their pairs only those whose parity maps leave the link possible are checked on the sets.
    """
    members = _members(classes)
    needed = stage(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_hash"), "needed")
    flagged = bloom.flag_hits(docs, "text_hash", bloom.build(needed, "text_hash", blocks), "maybe", blocks).where("maybe")
    found = flagged.groupBy("text_hash").agg(F.first("data").alias("data"))
    texts = stage(found.join(needed, "text_hash").select("node", "data"), "texts")

    labels = None
    turn = 0
    while not members.isEmpty():
        held = ["node", "n", "label", *(["parity"] if turn else [])]
        best = F.max_by(F.struct(*held), F.struct("degree", -F.col("node"))).alias("c")
        centres = stage(members.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(MORE_CENTRES**turn)).alias("deal")).agg(best).select("bucket", "c.*"), "centres")
        mates = centres.select("bucket", *[F.col(name).alias(f"{name}_centre") for name in held])
        fits = (F.col("label") != F.col("label_centre")) & (100 * F.least("n", "n_centre") >= PERCENT * F.greatest("n", "n_centre"))
        if turn:
            fits = fits & _may_link("parity", "n", "parity_centre", "n_centre")
        pairs = members.join(mates, "bucket").where(fits).select(F.col("node_centre").alias("centre"), "node").distinct()
        links = _verified(stage(pairs, "pairs"), texts)
        if labels is None:
            labels = connect(links)
        elif not links.isEmpty():
            ends = links
            for end in ("a", "b"):
                named = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
                ends = ends.join(named, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
            joined = connect(ends.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
            renamed = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
            old = labels.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            new = joined.join(labels.select("node"), "node", "left_anti")
            labels = stage(old.unionByName(new), "labels")
        left = members.join(centres.select("bucket", "node"), ["bucket", "node"], "left_anti").drop("label")
        left = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        left = stage(left, "members")
        open_ = stage(left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"), "open")
        members = left.join(open_, "bucket", "left_semi")
        if not turn:
            members = members.join(classes.select("node", "parity"), "node")
        members = stage(members, "members")
        turn += 1
    return labels


def _grouped(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """(key, text_hash, n, group, low): group is null without words, else it tells components apart; low is its smallest key."""
    key_type = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("key"), F.md5(whole).alias("text_hash"), whole.cast("binary").alias("data"))
    sketch = stage(read.mapInArrow(_sketch, f"key {key_type}, text_hash string, n long, digest binary, bands array<long>, parity array<long>"), "sketch")
    some = F.min(F.struct("text_hash", "bands", "parity")).alias("some")
    classes = sketch.where("n > 0").groupBy("digest", "n").agg(F.min("key").alias("low"), some)
    classes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "low", "some.text_hash", "some.bands", "some.parity"), "classes")
    labels = _labels(classes, read.select("text_hash", "data"), blocks)
    if labels is None:
        named = classes.select("digest", F.col("node").alias("group"), "low")
    else:
        named = stage(classes.select("node", "digest", "low").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("group"), "low"), "named")
        lows = stage(named.groupBy("group").agg(F.min("low").alias("low")), "lows")
        named = named.select("digest", "group").join(lows, "group")
    named = stage(named, "groups")
    return sketch.select("key", "text_hash", "n", "digest").join(named, "digest", "left").select("key", "text_hash", "n", "group", "low")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int = bloom.BLOCKS) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key that links reach), kept (key = component_id).

    Documents with the same set of shingles are one class, so copies cost one row each. Classes meet in the buckets of their
    bands; star edges are checked on whole sets, and links are joined to components.

    Null and empty texts and those without words have no shingles and are linked with nothing. Null keys count in no minimum, and a component
    of null keys only has a null id and keeps its rows. Rows that repeat a key are separate documents. Extra columns are
    ignored, whatever their names. Empty tables give no rows.
    """
    grouped = _grouped(docs, key, text, blocks)
    component = F.when(F.col("group").isNull(), F.col("key")).otherwise(F.col("low"))
    named = grouped.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return named.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int = bloom.BLOCKS) -> DataFrame:
    """The documents with one of each group, that with the smallest key, and all without words; columns as they come.

    Of several rows with the smallest key the one with the smallest text hash stays, of rows that repeat both one. Only
    documents that may go move; for the others the Bloom filter of those is enough.
    """
    grouped = stage(_grouped(docs, key, text, blocks).where(F.col("group").isNotNull()), "grouped")
    first = stage(grouped.groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), "key", "text_hash")).alias("first")), "first")
    rows = grouped.groupBy("group", "key", "text_hash").agg(F.count(F.lit(1)).alias("copies")).join(first, "group")
    wins = F.col("first.key").eqNullSafe(F.col("key")) & (F.col("first.text_hash") == F.col("text_hash"))
    doubtful = stage(rows.withColumn("wins", wins).where(~F.col("wins") | (F.col("copies") > 1)).select("key", "text_hash", "wins"), "doubtful")
    place = F.xxhash64(F.col("key").isNull(), "key", "text_hash")
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col(quoted(key)).alias("key"), F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("text_hash"))
    flagged = bloom.flag_hits(packed.withColumn("place", place), "place", bloom.build(doubtful.withColumn("place", place), "place", blocks), "maybe", blocks)
    settled = flagged.where(~F.col("maybe")).select("row")
    asked = flagged.where("maybe").drop("place", "maybe").alias("l")
    told = doubtful.select(F.col("key").alias("of"), F.col("text_hash").alias("of_hash"), "wins")
    answered = asked.join(told, F.col("key").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    unknown = answered.where("wins IS NULL").select("row")
    winners = answered.where("wins").dropDuplicates(["key", "text_hash"]).select("row")
    return settled.union(unknown).union(winners).select("row.*")
