"""Near-duplicates and components against all pairs, and the pipeline."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import ODD, docs, rows, with_clashes
from pyspark.sql import functions as F

from touchline.llm import near_dedup
from touchline.llm.components import connect


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(n, n + 1) for n in range(100, 180)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(500, n) for n in range(200, 400)]
    parent = {n: n for link in links for n in link}
    for a, b in links:
        join(parent, a, b)
    got = {r["node"]: r["label"] for r in connect(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {n: find(parent, n) for n in parent}


def test_no_links(spark):
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[n : n + 5]) for n in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(given):
    sets = [shingles(text) for _, text in given]
    parent = {n: n for n in range(len(given))}
    for a, b in combinations(parent, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            join(parent, a, b)
    low = {}
    for n in parent:
        root = find(parent, n)
        key = given[n][0]
        if key is not None and sets[n]:
            low[root] = min(low.get(root, key), key)
    out = []
    for n, (key, _) in enumerate(given):
        component = low.get(find(parent, n)) if sets[n] else key
        out.append((key, len(sets[n]), component, key == component))
    return sorted(out, key=repr)


def variants(seed):
    """Groups of changed copies: around a hidden base, in a chain, short ones, and texts that share a passage only."""
    rnd = random.Random(seed)
    words = [f"w{n}" for n in range(3000)]
    out = []

    def changed(base, times):
        text = list(base)
        for _ in range(times):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        return text

    for size in (6, 12, 40, 200):
        base = [rnd.choice(words) for _ in range(size)]
        out += [changed(base, rnd.randint(0, max(1, size // 30))) for _ in range(25)]
        step = base
        for _ in range(15):
            step = changed(step, 1)
            out.append(step)
        out.append([w.upper() for w in base])
    passage = [rnd.choice(words) for _ in range(60)]
    out += [passage + [rnd.choice(words) for _ in range(rnd.randint(15, 60))] for _ in range(60)]
    out += [[rnd.choice(words) for _ in range(rnd.randint(0, 4))] for _ in range(20)]
    rnd.shuffle(out)
    return [(n, rnd.choice([" ", "\n", "\t "]).join(text)) for n, text in enumerate(out)]


@pytest.mark.parametrize("seed", range(2))
def test_groups_are_those_of_all_pairs(spark, seed):
    given = variants(seed)
    got = near_dedup.groups(spark.createDataFrame(given, "doc_id long, text string").repartition(4))
    assert rows(got) == plain_groups(given)


def test_star_parts(spark, monkeypatch):
    """A star that is dealt out in many parts gives the same links."""
    monkeypatch.setattr(near_dedup, "STAR_PART", 3)
    given = variants(7)[:120]
    assert rows(near_dedup.groups(spark.createDataFrame(given, "doc_id long, text string"))) == plain_groups(given)


def test_groups_of_odd_rows(spark):
    table = with_clashes(docs(spark), "node", "component_id", "label", "text_hash")
    assert rows(near_dedup.groups(table)) == plain_groups([(r[0], r[1]) for r in ODD])
    assert near_dedup.groups(docs(spark, [])).count() == 0 and near_dedup.keep_one(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    given = variants(1) + [(3, variants(1)[3][1]), (None, variants(1)[5][1]), (None, "null keys only"), (None, "null keys only"), (900, ""), (901, None)]
    table = with_clashes(spark.createDataFrame(given, "doc_id long, text string").repartition(3), "row", "key", "maybe", "a.b")
    kept = near_dedup.keep_one(table)
    assert kept.columns == table.columns
    want = [key for key, n, _, stays in set(plain_groups(given)) if stays]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(want)


def test_equal_places_follow_the_similarity():
    rnd = np.random.default_rng(0)
    choices = near_dedup._choices()
    for size in (3, 40, 2000):
        agree = []
        for _ in range(300):
            pool = np.unique(rnd.integers(0, 2**63, size=size * 4 // 3 + 1).astype(np.uint64) * np.uint64(2))
            shared = max(1, len(pool) * 3 // 5)
            rest = (len(pool) - shared) // 2
            a, b = pool[rnd.permutation(len(pool))], None
            a, b = np.sort(a[: shared + rest]), np.sort(np.concatenate([a[:shared], a[shared + rest :]]))
            both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((near_dedup.signature(a, choices) == near_dedup.signature(b, choices)).mean() - both)
        assert abs(np.mean(agree)) < 0.03


# --- The pipeline


def test_stages_keep_what_they_promise(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    words = [f"w{n}" for n in range(2000)]
    good = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(120)]
    given = [(n, f"{text}\nThe same closing line in all.", "en", f"s{n % 3}", 7) for n, text in enumerate(good)]
    given += [(500 + n, " ".join(f"{rnd.choice(words)}$$$" for _ in range(60)), "en", "s0", 7) for n in range(60)]
    given += [(800, good[0] + " more\nThe same closing line in all.", "en", "s1", 7), (801, None, None, None, None), (None, good[1], "en", "s1", 7), (802, "", "en", "s2", 0)]
    table = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1) for n in range(100)] + [(500 + n, 0) for n in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    made = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, made[-1], str(tmp_path)).write.parquet(f"{tmp_path}/stage{number}")
        made.append(spark.read.parquet(f"{tmp_path}/stage{number}"))
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert all(m.columns == names for m in made[:-1]) and made[-1].columns == [*names, "ids"]
    ids = [{r["doc_id"] for r in m.collect()} for m in made]
    assert set(range(120)) <= ids[1] and not ids[1] & set(range(500, 560))
    assert made[2].where("text LIKE '%closing%'").count() == 0 and ids[2] == ids[1]
    assert made[2].where("n_chars <> length(text)").count() == 0
    assert 800 not in ids[3] and set(range(120)) <= ids[3]
    before, after = made[3], made[4]
    assert abs(before.selectExpr("sum(size(split(trim(text), ' ')))").first()[0] - after.selectExpr("sum(size(split(trim(text), ' ')))").first()[0]) <= 10
    assert made[5].count() == made[4].count() and made[5].where("size(ids) = 0").count() == 0
    assert rows(corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id", "n_chars", "ids").count()) == rows(made[5].groupBy("doc_id", "n_chars", "ids").count())


def test_stages_take_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("plain", "IDS", "N_LINES", "a.b", "KEY", "Row"):
        given = docs(spark) if name == "plain" else with_clashes(docs(spark), name)
        for number, (_, function) in enumerate(corpus_pipeline.STAGES):
            if name == "plain" or number in (1, 2, 3, 4):
                function(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{number}-{name}")
                assert spark.read.parquet(f"{tmp_path}/{number}-{name}").count() >= 1
