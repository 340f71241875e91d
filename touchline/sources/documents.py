"""JSON documents too large for one task: their arrays are cut at item borders by many tasks at once.

A file is read in pieces that end at a closing brace, so its blocks are shared out between tasks. Which braces close an item depends
on all text before: whether a quotation is open, and how deep the nesting is. Each block sums up what it adds to both, the sums of earlier blocks
are added, and no task sees more than its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import new_folder, stage
from touchline.sources.readers import POS, positioned

_FILE, _BLOCK, _SLOT = "_file", "_block", "_slot"


def _upto(value: str | Column) -> Column:
    """The sum of a value over the rows of a block up to this one."""
    return F.sum(value).over(Window.partitionBy(_FILE, _BLOCK).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _before(value: str) -> Column:
    """The sum of a value over the earlier blocks of a file, in a table of one row for each block."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, slot, text): what stands between closing braces, in the order of slot within a block."""
    rows = spark.read.option("lineSep", "}").text(path)
    at = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK)]
    return rows.select(*at, F.monotonically_increasing_id().alias(_SLOT), F.col("value").alias("text"))


def _depth(parts: Column, quoted: int) -> Column:
    """What a piece adds to the depth of nesting, its closing brace included, if it begins inside a quotation (1) or outside (0)."""
    outside = F.array_join(F.filter(parts, lambda _, n: n % 2 == quoted), "")
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    closed = F.length(outside) - F.length(F.translate(outside, "]", ""))
    ends_outside = (F.size(parts) - 1 + quoted) % 2 == 0
    return opened - closed - F.when(ends_outside, 1).otherwise(0)


def _closing(pieces: DataFrame, depth: int) -> DataFrame:
    """The pieces with ``closes``: whether their brace ends an object that stands ``depth`` levels deep."""
    parts = F.split(F.regexp_replace("text", r"\\.", ""), '"', -1)  # no escape goes over a closing brace
    known = pieces.withColumn("_parts", parts).select(*pieces.columns, (F.size("_parts") - 1).alias("_quotes"), *[_depth(F.col("_parts"), q).alias(f"_d{q}") for q in (0, 1)])
    open_here = (_upto("_quotes") - F.col("_quotes")) % 2  # if the block begins outside
    known = known.withColumn("_open", open_here)
    begun = lambda q: F.when((F.col("_open") + q) % 2 == 0, F.col("_d0")).otherwise(F.col("_d1"))
    known = stage(known.select(*pieces.columns, "_quotes", "_open", begun(0).alias("_if0"), begun(1).alias("_if1")), "pieces")

    sums = known.groupBy(_FILE, _BLOCK).agg(*[F.sum(c).alias(c) for c in ("_quotes", "_if0", "_if1")])
    sums = sums.withColumn("_entered", _before("_quotes") % 2)
    sums = sums.withColumn("_adds", F.when(F.col("_entered") == 0, F.col("_if0")).otherwise(F.col("_if1")))
    entered = stage(sums.select(_FILE, _BLOCK, "_entered", _before("_adds").alias("_level")), "blocks")

    joined = known.join(entered, [_FILE, _BLOCK])
    adds = F.when(F.col("_entered") == 0, F.col("_if0")).otherwise(F.col("_if1"))
    outside = (F.col("_open") + F.col("_entered") + F.col("_quotes")) % 2 == 0
    level = F.col("_level") + _upto(adds)
    return joined.select(*pieces.columns, (outside & (level == depth)).alias("closes"))


def split_documents(spark: SparkSession, path: str | list[str], names: Sequence[str] = ()) -> DataFrame:
    """(file, array, at, item): the objects in the named arrays of documents, or in arrays that are the root, as JSON texts with their place.

    ``at`` counts from 0 in each array of each file. The blocks of a file are read by several tasks, and no task holds more than a
    block or one item. The result is a written table, partitioned by array. Items are objects; a file holds one document;
    empty arrays, arrays that are absent and empty files have no items. Other keys beside the arrays are left out.
    """
    depth = 2 if names else 1
    marked = _closing(_pieces(spark, path), depth)
    ends = marked.withColumn("_ends", _upto(F.col("closes").cast("long")) - F.col("closes").cast("long"))
    ends = stage(ends, "closing")
    sums = ends.groupBy(_FILE, _BLOCK).agg(F.sum(F.col("closes").cast("long")).alias("_sum"))
    offsets = stage(sums.select(_FILE, _BLOCK, _before("_sum").alias("_earlier")), "offsets")
    numbered = ends.join(offsets, [_FILE, _BLOCK]).withColumn("_number", F.col("_earlier") + F.col("_ends"))
    grouped = numbered.groupBy(_FILE, "_number").agg(F.sort_array(F.collect_list(F.struct(_BLOCK, _SLOT, "text"))).alias("_texts"), F.max("closes").alias("_whole"))
    whole = F.concat(F.array_join(F.transform("_texts", lambda t: t["text"]), "}"), F.lit("}"))
    items = grouped.where("_whole").select(_FILE, "_number", whole.alias("_text"))

    following = F.regexp_extract("_text", r"(?s)^\s*,\s*(\{.*)$", 1)
    head = r'"([^"]*)"\s*:\s*\[\s*' if names else r"^[\s\x{feff}]*(\[)\s*"
    first = F.regexp_extract("_text", rf"(?s){head}(\{{.*)$", 2)
    opens = F.when(following == "", F.nullif(F.regexp_extract("_text", rf"(?s){head}\{{", 1), F.lit("")))
    items = stage(items.select(_FILE, "_number", opens.alias("_opens"), F.when(following == "", first).otherwise(following).alias("item")), "items")

    begun = items.where("_opens IS NOT NULL").groupBy(_FILE).agg(F.sort_array(F.collect_list(F.struct("_number", "_opens"))).alias("_begun"))  # one for each array
    mine = F.element_at(F.filter("_begun", lambda b: b["_number"] <= F.col("_number")), -1)
    placed = items.join(begun, _FILE).withColumn("_mine", mine)
    tag = F.col("_mine._opens") if names else F.lit("")
    made = placed.select(F.col(_FILE).alias("file"), tag.alias("array"), (F.col("_number") - F.col("_mine._number")).alias("at"), "item")
    made = made.where(F.col("array").isin(*names)) if names else made
    folder = new_folder(spark, "documents")
    made.write.partitionBy("array").parquet(folder)
    return spark.read.schema(T.StructType([T.StructField(n, T.LongType() if n == "at" else T.StringType()) for n in ("file", "at", "item", "array")])).parquet(folder)


def document_rows(items: DataFrame, schema: T.StructType, array: str = "") -> DataFrame:
    """One row per item of an array of ``split_documents``, with the ordinal ``pos``: the item's own, else its place."""
    own = items.where(F.col("array") == array) if array else items
    parsed = own.select("at", F.from_json("item", positioned(schema)).alias("_item"))
    return parsed.select(F.coalesce(F.col("_item")[POS], F.col("at")).alias(POS), *[F.col("_item")[name].alias(name) for name in schema.names if name != POS])
