"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, line_dedup, mixing, near_dedup, quality_crf
from touchline.llm.settings import TOKENIZER
from touchline.llm.text import fresh, quoted
from touchline.session import new_folder


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has it, where there is such a column."""
    found = [c for c in docs.columns if c.lower() == "n_chars"]
    return docs.withColumns({c: F.length("text").cast(docs.schema[c].dataType) for c in found})


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good; it learns from the labelled ones among them that are not held out."""
    return quality_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have; ``n_chars`` follows the text."""
    names = (fresh(docs, "_lines"), fresh(docs, "_lines_dropped"))
    return _counted(line_dedup.drop_repeated(docs, name=names).select(*map(quoted, docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to their source's weight, repeated ones as often as they are taken; ``n_chars`` follows the text."""
    return _counted(mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids in ``ids``."""
    return bpe.tokenize(docs, TOKENIZER)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        made = function(spark, docs, sf_dir)
        path = new_folder(spark, f"stage-{number}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
