"""The whole pipeline over the smallest tables against plain versions of its stages, one after another."""

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_near_dedup import plain_groups
from test_table_operators import plain_targets, words
from test_text_operators import plain_lines

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain_cut(text, count):
    pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
    return "".join(pieces[:count])


def plain_mix(given):
    """(key, text) for each time that one of (key, text, source) is taken."""
    sizes = Counter()
    for _, text, source in given:
        sizes[source] += len(words(text))
    budgets = {source: int(target) for source, target in plain_targets(sizes, (5, 2, 1), 3).items()}
    taken = []
    for source, size in sizes.items():
        rounds, rest = divmod(budgets[source], size) if size else (0, 0)
        own = [(hashlib.md5(str(key).encode()).hexdigest(), key, text) for key, text, of in given if of == source]
        for _, key, text in sorted(own):
            n = len(words(text))
            taken += [(key, text)] * rounds if n else []
            if n and rest > 0:
                taken.append((key, text if n <= rest else plain_cut(text, rest)))
            rest -= n
    return taken


def test_pipeline_is_that_of_plain_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from touchline.llm import quality_crf
    from touchline.llm.settings import TOKENIZER

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = corpus_pipeline.run(spark, SF_DIR)
    got = sorted((r["doc_id"], r["text"], r["n_chars"], tuple(r["ids"])) for r in made.select("doc_id", "text", "n_chars", "ids").collect())

    # The chain itself is held against all labellings in test_text_operators; here its verdicts are taken as given.
    judged = quality_crf.classify(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = {r["doc_id"] for r in judged.where(F.col("predicted") == 1).collect()}
    given = {r["doc_id"]: (r["text"], r["source"]) for r in documents.collect()}
    assert len(given) == documents.count() > len(good) > 0

    kept = [(key, text) for key, (text, _) in given.items() if key in good]
    lines = [(key, text) for key, text, _, _ in plain_lines(kept, 10)]
    assert any(text != given[key][0] for key, text in lines)
    first = {key for key, _, _, stays in plain_groups(lines) if stays}
    assert len(first) < len(lines)
    mixed = plain_mix([(key, text, given[key][1]) for key, text in lines if key in first])

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    ids = {text: tuple(library.encode(text, add_special_tokens=False).ids) for _, text in mixed}
    assert got == sorted((key, text, len(text), ids[text]) for key, text in mixed)
