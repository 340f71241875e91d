"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import bloom
from touchline.llm.text import let
from touchline.session import stage

#: A chunk has at least 512 characters and ends at the next line or sentence end, or after 4,096 characters.
CHUNK = r"(?s).{512,4096}?(?:\n|[.!?] |\z)|(?s).{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text, which joined give the text; none for the empty one."""
    return F.regexp_extract_all(text, F.lit(CHUNK), 0)


def _recipe(pieces: Column, hash_bits: int) -> Column:
    return F.transform(pieces, lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(c))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 64, blocks: int = bloom.BLOCKS) -> DataFrame:
    """One row per document, dropped ones too: key, keep_id, group_size, kept, text_sha256.

    A text's recipe is the ordered list of its chunks' hashes. Only texts whose recipe occurs again can be equal: a Bloom
    filter of such recipes picks them, and their chunks are moved once, each distinct chunk once per task, to verify that
    a hash stands for one content. Verified hashes are identifiers, and recipes of them are compared instead of texts.
    Texts with a chunk whose hash stands for several contents are compared by the contents of their chunks.

    Of equal texts the row with the largest key stays, null keys before all others; of rows that repeat both text and key
    one stays. A null text is an empty one. Repeated rows are separate rows. Extra columns are ignored, whatever their
    names. Empty tables give no rows. ``hash_bits`` below 64 is for tests of the collision path.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("key"), whole.alias("whole"))
    cut = read.select("key", "whole", chunks(F.col("whole")).alias("pieces"))
    with_recipe = cut.select("key", "whole", "pieces", _recipe(F.col("pieces"), hash_bits).alias("recipe"))
    with_digest = with_recipe.withColumn("digest", F.xxhash64("recipe"))

    bare = let(chunks(F.col("whole")), lambda c: _recipe(c, hash_bits))
    recipes = read.select("key", F.monotonically_increasing_id().alias("row"), bare.alias("recipe"), F.sha2("whole", 256).alias("sha"))
    recipes = stage(recipes.withColumn("digest", F.xxhash64("recipe")), "recipes")

    repeated = recipes.groupBy("recipe", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    suspects = bloom.flag_hits(with_digest, "digest", bloom.build(repeated, "digest", blocks), "maybe", blocks).where("maybe")
    pieces = suspects.select(F.explode(F.arrays_zip("recipe", "pieces")).alias("p")).select(F.col("p.recipe").alias("hash"), F.col("p.pieces").alias("content"))
    contents = pieces.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("uses"))
    collided = stage(contents.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "collided")

    uses = recipes.select("digest", F.explode("recipe").alias("hash"))
    unsafe = stage(uses.join(collided, "hash", "left_semi").select("digest").distinct(), "unsafe")
    nothing = F.array().cast("array<string>")
    verified = recipes.join(unsafe, "digest", "left_anti").select("key", "row", "recipe", nothing.alias("contents"), "sha")
    compared = with_digest.join(unsafe, "digest", "left_semi").select(
        "key", F.monotonically_increasing_id().alias("row"), "recipe", F.col("pieces").alias("contents"), F.sha2("whole", 256).alias("sha")
    )
    rows = verified.unionByName(stage(compared, "compared"))

    last = F.max(F.struct("key", "row")).alias("last")
    groups = stage(rows.groupBy("recipe", "contents").agg(last, F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    groups = groups.select(F.col("recipe").alias("of"), F.col("contents").alias("of_contents"), "last", "group_size")
    joined = rows.join(groups, (F.col("recipe") == F.col("of")) & (F.col("contents") == F.col("of_contents")), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("last.key")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("last.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
