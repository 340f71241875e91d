"""Spelling variants, personal data and the alignment of tokenizers against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import LONG, ODD, docs, rows, with_clashes
from pyspark.sql import functions as F

from touchline.llm import alignment, pii, spelling
from touchline.llm.queries import QUERIES
from touchline.llm.settings import PIECES, TOKENIZER

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Spelling variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_vocabulary(given, least_size=5, least=3):
    counts = Counter()
    for key, text in given:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            found = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if found % 97 == 0:
                run = run[: found % len(run)] + run[found % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_size and n >= least}


def plain_variants(words, factor=2):
    """Every pair of words that share what is left without one letter is compared."""
    met = defaultdict(set)
    for w in words:
        for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            met[part].add(w)
    near = defaultdict(set)
    for some in met.values():
        for a in some:
            near[a] |= {b for b in some if one_apart(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], [ord(c) for c in b]), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), None if form[w] is None else words[form[w]]) for w, n in words.items())


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("bits", [4, 12, 21])
def test_neighbourhoods_of_reduced_words(bits):
    rnd = random.Random(bits)
    letters = spelling.Alphabet([(c, rnd.randint(1, 50)) for c in "abcdeéxz"])
    points = lambda w: np.array([[ord(c) for c in w]], dtype=np.uint32)
    for _ in range(60):
        word = "".join(rnd.choice("abcdeéz") for _ in range(rnd.randint(1, 9)))
        made, counts = spelling.neighbour_keys(points(word), letters, bits, 1)
        own = spelling.reduced_keys(points(word), letters, bits)[0]
        assert len(set(made.tolist())) == len(made) == counts[0] and made[0] == own
        for near in {word, *(word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "aéx"), *(word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "bz"), *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            if near:
                there, _ = spelling.neighbour_keys(points(near), letters, bits, 1)
                key = spelling.reduced_keys(points(near), letters, bits)[0]
                assert (key in made) + (own in there) == (2 if key == own else 1), (word, near)


@pytest.mark.parametrize("bits", [None, 3, 16])
def test_variants_of_random_words(spark, bits):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 9))) for _ in range(150)]
    given = [(n, " ".join(rnd.choices(words, [2 ** (k % 9) for k in range(150)], k=300)), None, None) for n in range(40)]
    given += [(None, "Abcde ABCDE abcde", None, None), *((7, ("x" * n + " ") * (n % 5 + 3) + ("x" * 63 + "y ") * 9, None, None) for n in range(60, 70)), *ODD]
    table = with_clashes(docs(spark, given), "word", "N", "root", "key.a")
    want = plain_variants(plain_vocabulary([(r[0], r[1]) for r in given]))
    assert variants(spelling.group_variants(table, bits=bits)) == want
    assert any(form and root != form for _, form, root, *_ in want) and any(n > 1 for *_, n, _ in want)


def test_chains_of_forms(spark):
    step = [("aaaaa", 1), ("aaaab", 3), ("aaabb", 9), ("aabbb", 27), ("abbbb", 81), ("bbbbb", 243), ("zzzzz", 3)]
    given = [(n, " ".join(w for w, k in step for _ in range(k)), None, None) for n in range(20)]
    assert variants(spelling.group_variants(docs(spark, given))) == plain_variants(plain_vocabulary([(r[0], r[1]) for r in given]))
    assert {r["root"] for r in spelling.group_variants(docs(spark, given)).where("word LIKE 'a%b'").collect()} == {"bbbbb"}


def test_runs_are_not_cut(monkeypatch):
    monkeypatch.setattr(spelling, "TEXT_AT_ONCE", 5)
    text = "Abc, Überlänge×÷ 12 def ghijklmnop É"
    assert [run for some in spelling.runs(text) for run in some] == ["abc", "Überlänge×÷", "def", "ghijklmnop", "É"]
    assert list(spelling.runs("")) == []


def test_no_words(spark):
    assert spelling.group_variants(docs(spark, [])).count() == 0
    assert spelling.group_variants(docs(spark, [(1, None, None, None), (2, "", None, None), (3, "one two", None, None)])).count() == 0


def test_the_vocabulary_is_never_broadcast(spark, monkeypatch):
    """Not even where its files are below the threshold: all of it would go through the driver."""
    plans = []

    def stage(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    written = spelling.stage
    monkeypatch.setattr(spelling, "stage", stage)
    given = [(n, f"abcde abcdf abcdff {'x' * 80} {'x' * 79}y", None, None) for n in range(200)]
    made = spelling.group_variants(docs(spark, given))
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in plan for plan in plans) >= 3
    assert not any("Broadcast" in plan for plan in plans)
    assert variants(made) == plain_variants(plain_vocabulary([(r[0], r[1]) for r in given]))


@needs_tables
def test_variants_of_the_tables(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert variants(QUERIES["op11_spelling"](spark, SF_DIR)) == plain_variants(plain_vocabulary(given))


# --- Personal data


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (2 if n % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans_of_random_texts():
    rnd = random.Random(5)
    parts = ["a", "Zé", "@", "@", ".", ".", "..", "-", "+", "+1", " ", "\n", "12", "255.", "0", "00.", "256", "1.2.3.4", "4539 1488 0343 6467", "+1 (377) 555-0271", "(", ")", "x@y.z", "%", "_", "🙂", "٣"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ("1" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "@" * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "1." * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def _plain_beliefs(scores, edges, links):
    size, labels = scores.shape
    total = np.zeros_like(scores)
    for choice in np.ndindex(*[labels] * size):
        weight = np.exp(sum(scores[n, k] for n, k in enumerate(choice)) + sum(links[t][choice[u], choice[v]] for u, v, t in edges))
        for n, k in enumerate(choice):
            total[n, k] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_messages_on_a_tree_are_exact_and_close_on_a_loop():
    rnd = np.random.default_rng(2)
    labels = len(pii.KINDS) + 1
    scores, links = rnd.normal(size=(4, labels)), rnd.normal(size=(2, labels, labels))
    links[1] = (links[1] + links[1].T) / 2
    tree = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1)])
    own, joint = pii.beliefs(scores, tree, links, rounds=60)
    assert np.allclose(np.exp(own), _plain_beliefs(scores, tree, links), atol=1e-3)
    assert np.allclose(np.exp(joint).sum(axis=(1, 2)), 1)
    loop = np.array([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)])
    assert np.abs(np.exp(pii.beliefs(scores, loop, links, rounds=60)[0]) - _plain_beliefs(scores, loop, links)).max() < 0.15


def _private(n):
    """A document with an address, a phone, a card or an IP number, as the rules know them, and other numbers."""
    rnd = random.Random(n)
    name = "".join(rnd.choice("abcdefghij") for _ in range(6))
    card = "".join(rnd.choice("0123456789") for _ in range(15))
    card += next(d for d in "0123456789" if luhn(card + d))
    return rnd.choice(
        [
            f"Write to {name}.{n}@mail{n % 9}.example.com for more, said {name}.",
            f"Ring +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} in hour {n % 24}.",
            f"Paid by {card} on day {n % 30} of 20{n % 90 + 10}",
            f"Server {rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.7 runs version {n % 7}.{n % 5}.",
            f"Order {rnd.randint(10**9, 10**10)} has {n} parts, chapter {n % 12}, pages {n % 40}-{n % 40 + 9}.",
        ]
    )


@pytest.fixture(scope="module")
def model():
    return pii.train([pii.training_graph(_private(n)) for n in range(400)])


def spans_of(text, model):
    return [(kind, text[a:b], known) for kind, a, b, known in pii.all_spans([text], model)[0]]


def test_other_ways_of_writing_take_the_label_of_the_full_form(model):
    text = "Call +1 (377) 555-0271 now.\n" + "words " * 300 + "Again: 377.555.0271 or 555-0271. But 555-1234, pages 12-15, 2020."
    assert spans_of(text, model) == [("phone", "+1 (377) 555-0271", True), ("phone", "377.555.0271", False), ("phone", "555-0271", False)]
    text = "As jane.miller said: jane.miller@mail.example.com, not bob.smith. Jane.Miller!"
    assert spans_of(text, model) == [("email", "jane.miller", False), ("email", "jane.miller@mail.example.com", True), ("email", "Jane.Miller", False)]
    text = "From 10.20.30.40 the name 10-20-30-40 and not 10-20-31-41"
    assert spans_of(text, model) == [("ip", "10.20.30.40", True), ("ip", "10-20-30-40", False)]
    text = "Card 4539148803436467 is 4539.1488.0343.6467 too"
    assert spans_of(text, model) == [("card", "4539148803436467", True), ("card", "4539.1488.0343.6467", False)]


def test_links_decide_and_not_the_form(model):
    """The same form elsewhere is nothing: no span is added to texts without personal data, on 500 documents not learned from."""
    alone = ["Ask 555-0271 or 377.555.0271.", "said jane.miller to bob", "4539.1488.0343.6467", "10-20-30-40 and 3.1.4", "", "no numbers"]
    assert [pii.all_spans([t], model)[0] for t in alone] == [[]] * len(alone)
    unseen = [_private(n) for n in range(10_000, 10_500)]
    without = [t for t in unseen if not plain_base(t)]
    assert len(without) > 50 and not any(pii.all_spans(without, model))
    found = {True: 0, False: 0}
    for n in range(10_000, 10_500):
        for part, _ in pii._mentions(_private(n), pii.base_spans(_private(n)))[::2]:
            text = f"{_private(n)} Later on the text names {part} once more"
            found[any(not known for *_, known in pii.all_spans([text], model)[0])] += 1
    assert found[True] / (found[True] + found[False]) > 0.9


def test_without_base_spans_nothing_is_added():
    blank = pii.train([pii.training_graph("pages 12-15 and 2020"), pii.training_graph("3 of 4")])
    assert pii.all_spans(["555-0271", "4.0"], blank) == [[], []]


def test_personal_data_of_odd_rows(spark):
    given = [*ODD, *[(n, _private(n), "en", "a") for n in range(100, 200)], (300, "+1 (377) 555-0271 " + LONG + " 377.555.0271", "en", "a"), (301, "é🙂 a.b@c.de 🙂 1.2.3.4", None, None)]
    table = with_clashes(docs(spark, given), "spans", "hash", "KIND", "a.b")
    got = defaultdict(list)
    for r in pii.find(table).collect():
        got[r["doc_id"]].append(r["spans"])
    for key, text, *_ in given:
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["stop"]) for s in got[key][0] if s["base"]] if key is not None else None
        assert base is None or base == plain_base(text or "")
    assert [len(v) for k, v in got.items() if k in (None, 1)] == [2, 2] and got[4] == [[]] and len(got) == len({r[0] for r in given})
    assert pii.find(docs(spark, [])).count() == 0


@needs_tables
def test_base_digests_of_the_tables(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in QUERIES["op12_pii"](spark, SF_DIR).collect():
        base = [(pii.KINDS[k], a, b) for a, k, b in plain_base(texts[r["doc_id"]])]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(written)) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == s[0] for s in base) for k in pii.KINDS]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("likely_")] == written


# --- Alignment


def plain_tokenizers():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def plain_alignment(text, a, b, table):
    """(groups as lists of ids) by the offsets at which tokens of both end."""
    if not text:
        return []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(n)) for n in ids_a]
    pieces = [b.id_to_piece(n) for n in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode() for n, p in zip(ids_b, pieces, strict=True)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        ni, nj = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:ni], ids_b[j:nj]))
        i, j = ni, nj
    return groups


def plain_results(given):
    a, b = plain_tokenizers()
    table = byte_table()
    aligned = [(key, plain_alignment(text, a, b, table)) for key, text in given]
    counts = Counter(pair for _, groups in aligned for pair in {(x, y) for left, right in groups for x in left for y in right})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for key, groups in aligned:
        linked = [(x, y) for left, right in groups for x in left for y in right]
        written = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append(
            (key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(linked), sum(counts[p] == most[p[0]] for p in linked), sum(counts[p] for p in linked), sha(written) if groups else "")
        )
    return sorted(out, key=repr)


def digests(aligned, **settings):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    counted = alignment.with_counts(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "link_a", "link_b", "link_times"), **settings)
    return rows(counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


AWKWARD = [
    (20, "<s>special</s> <unk> <|endoftext|> text", "en", "a"),
    (21, "▁ piece mark", "en", "a"),
    (22, "a" * 3000 + " " + "=" * 999, "en", "a"),
    (23, " leading  spaces \t and\r\n lines\x00 null", "en", "a"),
    (24, "日本語の文章 🙂🙃 ﬁ é ＡＢ  ", "ja", "a"),
    (25, "x", None, None),
    (26, " ", "en", "a"),
    (27, "🙂" * 300, "en", "a"),
    (28, "gap" + " " * 300_000 + "x" + "\n" * 5000, "en", "a"),
    (29, "'s''ll  \n  b\n c\x1c\x85 d\u3000e", "en", "a"),
]


@pytest.mark.parametrize("upto", [0, 1 << 20])
def test_alignment_of_odd_rows(spark, upto):
    given = [*ODD, *AWKWARD]
    table = with_clashes(docs(spark, given), "n_a", "GROUPS", "_row", "a.b")
    aligned = alignment.align(table, TOKENIZER, PIECES, at_once=50)
    assert digests(aligned, broadcast_upto=upto) == plain_results([(r[0], r[1]) for r in given])
    assert digests(alignment.align(docs(spark, []), TOKENIZER, PIECES), broadcast_upto=upto) == []


def test_large_groups_are_counted_by_ids():
    rnd = np.random.default_rng(1)
    size = np.array([1, 1, 1, 2, 3])
    lists = [[rnd.integers(0, 5, 200), rnd.integers(0, 5, 40)] for _ in range(2)]
    trim = lambda ids, total: ids[np.cumsum(size[ids]) <= total]
    total = [min(int(size[x].sum()) for x in some) for some in lists]
    pad = lambda ids, n: np.concatenate([trim(ids, n), np.zeros(n - int(size[trim(ids, n)].sum()), np.int64)])
    a, b = (alignment.Side.of([pad(some[k], n) for some, n in zip(lists, total, strict=True)], size) for k in (0, 1))
    group_a, group_b = alignment.grouped(a, b)
    want = alignment.links(a, b, group_a, group_b)
    plain = Counter((int(a.row[i]) << 40 | int(a.ids[i]) << 20 | int(b.ids[j])) for i in range(len(a.ids)) for j in range(len(b.ids)) if group_a[i] == group_b[j])
    for large, at_once in ((1 << 10, 1 << 20), (0, 1), (2, 3)):
        found, times = alignment.links(a, b, group_a, group_b, large, at_once)
        assert found.tolist() == want[0].tolist() == sorted(plain) and times.tolist() == want[1].tolist() == [plain[k] for k in sorted(plain)]


@needs_tables
def test_alignment_of_the_tables(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    made = QUERIES["op13_alignment"](spark, SF_DIR)
    assert rows(made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == plain_results(given)
