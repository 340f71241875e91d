"""The registered queries of this subpackage with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import alignment, bpe, chat_format, exact_dedup, line_dedup, mixing, near_dedup, pii, quality_crf, quality_rules, secret_scan, spelling, sql, url_filter
from touchline.llm.settings import PIECES, TOKENIZER

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_url_filter", sql.URL_FILTER)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; listed are the urls of campaigns, those that carry a ``utm_`` parameter."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    campaigns = pages.where(F.col("url").rlike("[?&]utm_"))
    return url_filter.judge(pages, campaigns, URL_RULES)


@query("op4_chat_format", sql.CHAT_FORMAT)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


@query("op5_mixing", sql.MIXING)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixing.shares(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return shares.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_quality_rules", sql.QUALITY_RULES)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_exact_dedup", sql.EXACT_DEDUP)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def base_digest(spans: Column) -> list[Column]:
    kinds = [r.kind for r in secret_scan.BASE]
    base = of_kinds(spans, kinds)
    counts = [F.size(of_kinds(spans, [kind])).cast("long").alias(f"n_{kind}") for kind in kinds]
    return [*counts, F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"), secret_scan.joined_spans(spans).alias("spans")]


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", *base_digest(F.col("secrets")))


@query("op6_line_dedup", sql.LINE_DEDUP)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def span_names(spans: Column) -> Column:
    """``kind:start:stop`` of each, joined by commas; spans that the model adds have ``likely_`` before their kind."""
    named = F.transform(spans, lambda s: F.struct(F.concat(F.when(s["base"], "").otherwise("likely_"), s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return secret_scan.joined_spans(named)


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(of_kinds(base, [kind])).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_names(base), 256).alias("base_sha256"), span_names(F.col("spans")).alias("spans"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, PIECES)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    counted = alignment.with_counts(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "link_a", "link_b", "link_times"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
