"""The registered queries: what they return, and what the native ones do without."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from touchline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
RETURNED = {
    "op1_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", RETURNED)
def test_columns(spark, name):
    made = QUERIES[name](spark, SF_DIR)
    kinds = dict(made.dtypes)
    for column in RETURNED[name].split(", "):
        column, kind = column.split(" ")
        assert kinds[column] == kind, column
    table = "pages" if name == "op2_url_filter" else "documents"
    if name == "op11_spelling":
        assert made.count() == made.select("word").distinct().count() > 0
        return
    assert made.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_mixing", "op8_quality_rules", "op9_exact_dedup"])
def test_native_queries_run_no_python(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    def refuse(*_args, **_kwargs):
        raise AssertionError("Python on the executors")

    frame = type(spark.range(1))
    for kind in {DataFrame, frame}:
        for method in ("mapInArrow", "mapInPandas", "toPandas", "rdd"):
            monkeypatch.setattr(kind, method, refuse, raising=False)
    for function in ("udf", "pandas_udf"):
        monkeypatch.setattr(F, function, refuse)
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_bpe_digests(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from touchline.llm.settings import TOKENIZER

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for row in QUERIES["op7_bpe"](spark, SF_DIR).collect():
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == sha(",".join(map(str, ids)))
        assert row["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_pipeline_of_the_tables(spark):
    made = QUERIES["pipeline"](spark, SF_DIR)
    assert made.columns == [*spark.read.parquet(f"{SF_DIR}/documents.parquet").columns, "ids"]
    assert made.count() > 0
