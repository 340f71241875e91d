"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.text import WORD, let, quoted, words
from touchline.session import stage

SYMBOL = "[#*$%&|<>]"
_FEW = 32


def repeat_words(word_list: Column) -> Column:
    """How many words lie in a window of three words that occurs at least twice."""
    size = F.size(word_list)
    hashes = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(word_list, i), F.get(word_list, i + 1), F.get(word_list, i + 2)))
    return F.when(size < 4, F.lit(0)).otherwise(let(hashes, _covered)).cast("long")


def _covered(hashes: Column) -> Column:
    def twice(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1))))

    def at_few(repeated: Column) -> Column:
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda p: p.isNotNull())

    def at_many() -> Column:
        def neighbours(ordered: Column) -> Column:
            same = F.filter(
                ordered,
                lambda s, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == s["h"])) | (F.coalesce(F.get(ordered, i + 1)["h"] == s["h"], F.lit(False))),
            )
            return F.sort_array(F.transform(same, lambda s: s["i"]))

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)

    def total(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def counted(repeated: Column) -> Column:
        places = F.when(F.size(repeated) <= _FEW, at_few(repeated)).otherwise(at_many())
        return F.when(F.size(repeated) == 0, F.lit(0)).otherwise(total(places))

    return let(let(F.sort_array(hashes), twice), counted)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a text; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    of_lines = let(lines, lambda kept: F.struct(F.size(kept).cast("long").alias("n"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("dup")))
    of_words = let(
        words(whole),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("again")),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            m["w"]["chars"].alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            m["l"]["n"].alias("n_lines"),
            m["l"]["dup"].alias("n_dup_lines"),
            m["w"]["again"].alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A whole-number measure and how far above the usual it may lie.

    The limit is high + reach * max(high - middle, 1), where ``middle`` is the median and ``high`` the quantile at ``tail`` thousandths of
    the documents of the same language and source. 1 is what a sketch tells apart.
    """

    name: str
    value: str
    tail: int
    reach: int = 3


#: Thousandths, and tenths of characters per word. Good texts differ little in symbols and word length, so the upper seventh already
#: tells how far they go; lines and words repeat in some good texts too, so only what lies far beyond the last fiftieth goes.
RULES = (
    Rule("symbols", "1000 * n_symbols div word_chars", 850),
    Rule("dup_lines", "1000 * n_dup_lines div n_lines", 980),
    Rule("repeats", "1000 * n_repeat_words div n_words", 980),
    Rule("word_length", "10 * word_chars div n_words", 850),
)
MIDDLE = 500
#: A group's quantiles are pulled towards its language's as if the group had so many further documents like those of its language.
PULL = 20
#: A value of up to so many binary digits has a bucket of its own; of longer ones so many leading digits count.
DIGITS = 11


def bucket(value: str) -> Column:
    """The largest value that falls into the same bucket: the value itself under 2,048, else less than a thousandth above it.

    Without a ceiling: each doubling from 2,048 on adds 1,024 buckets.
    """
    cut = f"greatest(length(bin({value})) - {DIGITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {cut}) + 1L, {cut}) - 1L")


def sketches(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per lang, source, rule and bucket of the documents with words: a quantile sketch of fixed resolution.

    Sketches merge by adding counts, in any order and with the same result.
    """
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(f"cast({r.value} AS bigint)").alias("bucket")) for r in rules])
    return measured.where("n_words > 0").select("lang", "source", F.explode(values).alias("v")).groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def _by_rule(values: dict[str, Column]) -> Column:
    """The value for the row's rule."""
    chosen = None
    for name, value in values.items():
        chosen = F.when(F.col("rule") == name, value) if chosen is None else chosen.when(F.col("rule") == name, value)
    return chosen


def _quantiles(counts: DataFrame, by: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(by, rule, middle, high, total) of merged sketches: the smallest buckets that hold half and ``tail`` thousandths of the documents."""
    merged = counts.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(group)).withColumn("tail", _by_rule({r.name: F.lit(r.tail) for r in rules}))
    at = lambda level: F.min(F.when(1000 * F.col("upto") >= level * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*by, "rule").agg(at(F.lit(MIDDLE)).alias("middle"), at(F.col("tail")).alias("high"), F.max("total").alias("total"))


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, pull: int = PULL) -> DataFrame:
    """Per lang and source one column per rule: the largest value that stays.

    A group of n documents weighs its own quantile by n and its language's by ``pull``, at every size of the group. Sketches hold
    up to 2,048 buckets per rule and 1,024 for each doubling above, so no window here grows with the documents.
    """
    of_group = _quantiles(counts, ["lang", "source"], rules)
    of_lang = _quantiles(counts, ["lang"], rules).select(F.col("lang").alias("of"), F.col("rule").alias("r"), F.col("middle").alias("middle_l"), F.col("high").alias("high_l"))
    joined = of_group.join(of_lang, F.col("lang").eqNullSafe(F.col("of")) & (F.col("rule") == F.col("r")))
    pulled = [F.expr(f"(total * {name} + {pull}L * {name}_l) div (total + {pull}L)").alias(name) for name in ("middle", "high")]
    reach = _by_rule({r.name: F.lit(r.reach) for r in rules})
    limit = F.col("high") + reach * F.greatest(F.col("high") - F.col("middle"), F.lit(1))
    limits = joined.select("lang", "source", "rule", *pulled).withColumn("limit", limit)
    return limits.groupBy(F.col("lang").alias("lang_"), F.col("source").alias("source_")).agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("limit"))).alias(f"most_{r.name}") for r in rules]
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rules: tuple[Rule, ...] = RULES, pull: int = PULL) -> DataFrame:
    """One row per document: key, lang, source, measures, base_failed, failed (names of the adaptive rules it breaks), kept.

    A document fails the base with under 50 words or with over half of its words in repeated windows of three. Any other
    goes if a measure lies over the limit of its language and source, which the group's own quantiles set, pulled towards its language's.

    Null texts count as empty and fail the base. Null lang and source are groups like any other. Ties at a threshold stay.
    Repeated rows are judged one by one. Extra columns are ignored, whatever their names. Empty tables give no rows.
    """
    read = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(source)).cast("string").alias("source"), measures(F.col(quoted(text))).alias("m"))
    measured = stage(read.select("key", "lang", "source", "m.*"), "measures")
    limits = stage(thresholds(stage(sketches(measured, rules), "sketches"), rules, pull), "thresholds")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    broken = F.array(*[F.when((F.col("n_words") > 0) & (F.expr(f"case when n_words > 0 then {r.value} end") > F.col(f"most_{r.name}")), r.name) for r in rules])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = joined.withColumn("base_failed", base).withColumn("failed", F.filter(broken, lambda n: n.isNotNull()))
    return judged.select(
        F.col("key").alias(key), "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
