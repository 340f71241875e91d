"""Mixing sources to target weights: hash order, distributed prefix sums, and a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.prefix import running_before
from touchline.llm.text import WORD, quoted, unused_prefix, word_count
from touchline.session import stage

MOST_REPEATS = 3


def _wide(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("decimal(38,0)")


def targets(totals: DataFrame, weights: Sequence[int], most: int = MOST_REPEATS) -> DataFrame:
    """Target per source of a table (source, source_size) with one row per source.

    The sum of all sizes is shared by weight, weights going round over the sources by code point with null last. A target
    stops at ``most`` times its source's size and the excess is shared again by weight among the others. In the order of
    size by weight the stopped sources come first, so one pass over running sums finds them. The windows here hold one row
    per source.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = totals.withColumn("turn", turn).withColumn("weight", F.element_at(cycle, (F.col("turn") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("size_all"),
        F.sum("weight").over(everything).alias("weight_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left, share = F.col("size_all") - F.col("cap_before"), F.col("weight_all") - F.col("weight_before")
    ranked = ranked.withColumn("stopped", _wide(left) * _wide("weight").cast("decimal(10,0)") > _wide("cap") * _wide(share).cast("decimal(18,0)"))
    ranked = ranked.select(
        "*",
        (F.col("size_all") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(everything), F.lit(0))).alias("size_open"),
        (F.col("weight_all") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("weight"))).over(everything), F.lit(0))).alias("weight_open"),
    )
    shared = F.col("size_open").cast("double") * F.col("weight").cast("double") / F.col("weight_open").cast("double")
    return ranked.select("source", "source_size", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _sized(docs: DataFrame, key: str, text: str, source: str, row: Column) -> DataFrame:
    as_text = F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))
    return docs.select(
        row.alias("row"), F.col(quoted(key)).alias("key"), F.col(quoted(source)).cast("string").alias("source"), word_count(F.col(quoted(text))).alias("size"), F.md5(as_text).alias("draw")
    )


def _placed(sized: DataFrame, weights: Sequence[int], most: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the words before them in their source, and per source: of, source_size, target, rounds, rest."""
    sized = stage(sized, "sizes")
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    some = F.col("source_size") > 0
    whole = per_source.withColumn("budget", F.floor("target").cast("long")).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(some, F.expr("budget div source_size")).otherwise(0).cast("long").alias("rounds"),
        F.when(some, F.expr("budget % source_size")).otherwise(0).cast("long").alias("rest"),
    )
    return running_before(sized, "source", order, ["size"]), stage(whole, "targets")


def shares(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """One row per document: key, source, size, source_size, target, rounds, part, taken.

    Within a source, documents stand in the order of a hash of their key. The budget is the whole part of the target:
    every document is taken ``rounds`` times in full, and the first ones once more up to the budget, the document at the
    cut in ``part``. So a source gives its budget to the word, and no document more than ``most`` times its size.

    Null texts have size 0 and give nothing. Null sources are one source, ordered last. Rows that repeat a key stand side
    by side and are taken as separate rows. Extra columns are ignored, whatever their names. Empty tables give no rows.
    """
    sized = _sized(docs, key, text, source, F.monotonically_increasing_id())
    placed, whole = _placed(sized, weights, most, ["draw", "key", "size", "row"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before_size")))
    joined = placed.join(whole, F.col("source").eqNullSafe(F.col("of"))).withColumn("part", part)
    taken = (F.col("rounds") * F.col("size") + F.col("part")).alias("taken")
    return joined.select(F.col("key").alias(key), "source", "size", "source_size", "target", "rounds", "part", taken)


def first_words(text: Column, count: Column) -> Column:
    """A text up to its ``count``-th word, white space included."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    return F.array_join(F.slice(pieces, F.lit(1), count.cast("int")), "")


def _identity(docs: DataFrame, text: str) -> Column:
    """A digest of all columns: rows that share it are alike in everything."""
    others = F.to_json(F.struct(*[F.col(quoted(c)) for c in docs.columns if c.lower() != text.lower()]))
    return F.md5(F.concat(F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))), others))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents, with the columns of the input: a row for each time that a document is taken; cut at the budget.

    Only sizes and digests are ordered and summed. From them each source gets its cut: the document at which its budget
    ends, and how many words of it are taken. A document compares itself with its source's cut, so texts don't move.
    Rows alike in all columns may share the place of the cut; they are then counted out from one of them.

    Documents without words are not taken. Other cases as in ``shares``.
    """
    row = _identity(docs, text)
    placed, whole = _placed(_sized(docs, key, text, source, row), weights, most, ["draw", "key", "row"])
    at = placed.join(whole, F.col("source").eqNullSafe(F.col("of"))).where("before_size < rest AND rest <= before_size + size")
    at = stage(at.select("of", F.col("row").alias("edge_row"), F.struct("draw", "key", "row").alias("edge")), "edges")
    alike = placed.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("row") == F.col("edge_row")))
    alike = alike.groupBy("of", "edge").agg(F.min("before_size").alias("edge_before"), F.count(F.lit(1)).alias("alike"), F.max("size").alias("edge_size"))
    alike = alike.select(F.col("of").alias("edge_of"), "edge", "edge_before", "alike", "edge_size")
    cuts = whole.join(alike, F.col("of").eqNullSafe(F.col("edge_of")), "left")
    cuts = stage(cuts.select("of", "rounds", "rest", "edge", "alike", "edge_size", (F.col("rest") - F.col("edge_before")).alias("left")), "cuts")

    own = unused_prefix(docs, "_mix")
    name = lambda part: f"{own}_{part}"
    col = lambda part: F.col(name(part))
    cuts = cuts.select(*[F.col(c).alias(name(c)) for c in cuts.columns])
    place = F.struct(F.md5(F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))).alias("draw"), F.col(quoted(key)).alias("key"), row.alias("row"))
    marked = docs.where(F.col(quoted(text)).rlike(WORD)).withColumn(name("place"), place)
    full = F.array_repeat(F.col(quoted(text)), col("rounds").cast("int"))
    nothing = F.array().cast("array<string>")

    joined = marked.join(cuts, F.col(quoted(source)).cast("string").eqNullSafe(col("of")))
    here = F.coalesce(col("place") == col("edge"), F.lit(False))
    earlier = F.coalesce(col("place") < col("edge"), F.lit(False))
    cut = here & (col("left") < col("edge_size"))
    extra = F.when(cut, F.array(first_words(F.col(quoted(text)), col("left")))).when(here | earlier, F.array(quoted(text)))
    single = joined.where(~here | (col("alike") == 1)).withColumn(name("kept"), F.explode(F.concat(full, F.coalesce(extra, nothing))))

    shared = cuts.where(col("alike") > 1)
    repeated = marked.join(shared, F.col(quoted(source)).cast("string").eqNullSafe(col("of"))).where(col("place") == col("edge")).dropDuplicates([name("of")])
    repeated = repeated.withColumn(name("nth"), F.explode(F.sequence(F.lit(0).cast("long"), col("alike") - 1)))
    part = F.greatest(F.lit(0), F.least(col("edge_size"), col("left") - col("nth") * col("edge_size")))
    parts = F.when(part == col("edge_size"), F.array(quoted(text))).when(part > 0, F.array(first_words(F.col(quoted(text)), part)))
    repeated = repeated.withColumn(name("kept"), F.explode(F.concat(full, F.coalesce(parts, nothing))))

    shown = [col("kept").alias(c) if c.lower() == text.lower() else F.col(quoted(c)) for c in docs.columns]
    return single.select(*shown).unionByName(repeated.select(*shown))
