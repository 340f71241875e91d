"""URL filter, chat formatting, mixing, quality rules, exact dedup and their helpers against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from llm_helpers import DOCS, LONG, ODD, docs, rows, with_clashes
from pyspark.sql import functions as F

from touchline.llm import bloom, chat_format, exact_dedup, mixing, quality_rules, url_filter
from touchline.llm.prefix import running_before
from touchline.llm.queries import URL_RULES

SPACES = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


# --- Bloom filter and prefix sums


@pytest.mark.parametrize("blocks", [1, 16, 1 << 16])
def test_bloom_filter_misses_no_key(spark, blocks):
    keys = spark.range(500).select((F.col("id") * 3).alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    flagged = bloom.flag_hits(spark.range(1500).withColumnRenamed("id", "k").union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k", bloom.build(keys, "k", blocks), "hit", blocks)
    got = {r["k"]: r["hit"] for r in flagged.collect()}
    assert len(got) == 1501 and all(got[k] for k in range(0, 1500, 3)) and got[None] is False
    if blocks == 1 << 16:
        assert sum(got.values()) < 520
    assert not bloom.flag_hits(keys, "k", bloom.build(keys.where("false"), "k"), "hit").where("hit").count()


def test_running_sums_of_a_hot_group(spark):
    rnd = random.Random(3)
    given = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), n, rnd.choice([None, 1, 5])) for n in range(600)]
    table = spark.createDataFrame(given, "g string, n long, v long").repartition(7)
    got = {(r["g"], r["n"]): r["before_v"] for r in running_before(table, "g", ["n"], ["v"]).collect()}
    sums = defaultdict(int)
    for g, n, v in given:
        assert got[g, n] == sums[g]
        sums[g] += v or 0
    assert len(got) == 600


# --- URL filter


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


URLS = [
    "https://a.example.net/en/1?utm_source=x", "http://www.EXAMPLE.net/fr/2", "http://example.com/de/3#top", "http://badexample.com/de/3", "https://b.org/fr/", "https://b.org/de/x/",
    "https://b.org/de/x?utm_source=feed", "http://www.b.org/de/x", "https://net", "https://net/", "HTTP://x.net:80/a", "no url", "", None, "://", "a://b://c/d", "https://é.ÜX.org/fr/é", "http://c.com?utm_a=1", "http://www.c.com/",
    "http://s.com/item?id=1&utm_source=x", "http://s.com/item?id=2", "http://s.com/item?b=2&&id=1", "http://s.com/item/?id=1#part?x", "http://s.com/item", "http://s.com/list?utm_a=1&z=1&a=é", "http://s.com/list?a=é&utm_b&z=1", "http://s.com/x#?utm_a=1",
]


def test_urls(spark):
    pages = with_clashes(spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string"), "host", "form", "rule", "maybe")
    listed = pages.where(F.col("url").rlike("[?&]utm_"))

    def form(url):
        host, path = plain_host_path(url)
        query = sorted(p for p in (url or "").split("#")[0].partition("?")[2].split("&") if p and not p.startswith("utm_"))
        return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(query) if query else "") if host else None

    on_list = {form(u) for u in URLS if u and re.search("[?&]utm_", u)}
    want = []
    for n, url in [*enumerate(URLS), (0, URLS[0])]:
        host, path = plain_host_path(url)
        rule, verdict = plain_rule(host, path)
        bad = rule is None and form(url) is not None and form(url) in on_list
        want.append((n, host, path, form(url), rule, bad, verdict or ("block" if bad else "allow")))
    for blocks in (1, bloom.BLOCKS):
        assert rows(url_filter.judge(pages, listed, URL_RULES, blocks=blocks)) == sorted(want, key=repr)
    assert {r["verdict"] for r in url_filter.judge(pages, pages.where("false"), []).collect()} == {"allow"}
    got = {URLS[r["page_id"]]: r["verdict"] for r in url_filter.judge(pages, listed, []).collect()}
    assert got["http://s.com/item?id=2"] == got["http://s.com/item"] == "allow" and got["http://s.com/item/?id=1#part?x"] == got["http://s.com/list?a=é&utm_b&z=1"] == "block"
    assert url_filter.judge(pages.where("false"), listed, URL_RULES).count() == 0


# --- Chat formatting


def plain_dialogues(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, said in by.items():
        said.sort(key=lambda t: (t[0], t[1], hashlib.md5(f"{t[2]}\n{t[3]}".encode()).hexdigest()))
        for me in {t[2] for t in said} - {"system"}:
            text, spans = "", []
            for _, _, who, what in said:
                shown = "assistant" if who == me else "system" if who == "system" else f"user name={who}"
                text += f"<|im_start|>{shown}\n"
                if who == me:
                    spans.append((len(text), len(text) + len(what) + len("<|im_end|>\n")))
                text += what + "<|im_end|>\n"
            out[conv, me] = (text, spans)
    return out


def test_every_participant_gets_a_perspective(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é🙂"), (1, 2, "bob", "Hello"), (1, 3, "cyn", None), (1, 4, "ann", "Bye")]
    turns += [(2, 0, "system", "alone"), (None, 1, None, "x"), (None, 1, "bob", ""), (3, None, "a", "1"), (3, 1, "a", "2"), (3, 1, "a", "2"), (3, 1, "assistant", LONG)]
    turns += [(4, n, rnd, f"turn {n}") for n, rnd in enumerate(["user", "assistant"] * 150)]
    table = with_clashes(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5), "speaker", "perspective", "size")
    got = defaultdict(list)
    for r in chat_format.rotate(table).collect():
        got[r["conv_id"], r["perspective"]].append(r)
    want = plain_dialogues(turns)
    assert set(got) == set(want)
    for key, parts in got.items():
        parts.sort(key=lambda r: r["place"])
        assert [r["place"] for r in parts] == list(range(len(parts)))
        text = "".join(r["rendered"] for r in parts)
        assert (text, [(r["trained_start"], r["trained_stop"]) for r in parts if r["trained_start"] is not None]) == want[key]
        assert all(text[r["start"] : r["stop"]] == r["rendered"] for r in parts)
    assert chat_format.rotate(table.where("false")).count() == 0


# --- Mixing


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        target = {s: Fraction(most * sizes[s]) if s in stopped else Fraction(left * weight[s], share) for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_budgets(spark, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", "Z", "ä", None, "empty"][: rnd.randint(1, 6)]
    given = []
    for n in range(rnd.choice([1, 40, 150])):
        source = rnd.choice(sources) if rnd.random() < 0.5 else sources[0]
        given.append((n % 100 if n % 17 else None, "" if source == "empty" else "w " * rnd.randint(0, 30), "en", source))
    table = spark.createDataFrame(given, DOCS).repartition(4)
    sizes = Counter()
    for _, text, _, source in given:
        sizes[source] += len(words(text))
    want = plain_targets(sizes, (5, 2, 1), 3)
    got = mixing.shares(with_clashes(table, "size", "row", "draw"), (5, 2, 1)).collect()
    assert len(got) == len(given)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, n in taken.items():
        assert abs(n - want[source]) <= 1
    again = mixing.shares(table.repartition(2), (5, 2, 1))
    assert rows(again.select("doc_id", "size", "taken")) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)


def test_mixed_documents_hold_the_words_taken(spark):
    table = with_clashes(docs(spark), "size", "_mix_row", "part", "a.b")
    share = {}
    for r in mixing.shares(table).collect():
        share[r["doc_id"]] = share.get(r["doc_id"], 0) + r["taken"]
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    got = Counter()
    texts = {r[0]: r[1] for r in ODD if r[0] is not None}
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        if r["doc_id"] in texts:
            assert texts[r["doc_id"]].startswith(r["text"])
    assert got == {k: n for k, n in share.items() if n}
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.shares(docs(spark, [])).count() == 0


# --- Quality rules


def plain_measures(text):
    w, text = words(text), text or ""
    three = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for n in range(len(w) - 2):
        if three[tuple(w[n : n + 3])] > 1:
            inside |= {n, n + 1, n + 2}
    lines = [line for line in text.split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside)


def random_texts(seed, count):
    rnd = random.Random(seed)
    alphabet = ["a", "b", "c", "é", "🙂", "#*", "|"]
    for _ in range(count):
        few = alphabet[: rnd.randint(1, 7)] + [str(n) for n in range(rnd.choice([0, 3, 300]))]
        yield "".join(rnd.choice(few) + rnd.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(rnd.choice([0, 2, 5, 40, 400])))


def test_measures(spark):
    texts = [*random_texts(1, 60), LONG + " " + LONG, None, ""]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = {r["n"]: tuple(r["m"]) for r in table.select("n", quality_rules.measures(F.col("t")).alias("m")).collect()}
    for n, text in enumerate(texts):
        assert got[n] == plain_measures(text), repr(text)[:200]


def plain_verdicts(given, pull):
    tails = {"symbols": 850, "dup_lines": 980, "repeats": 980, "word_length": 850}
    measured = [plain_measures(r[1]) for r in given]

    def values(m):
        n, chars, symbols, lines, dup, again = m
        return dict(zip(tails, (1000 * symbols // chars, 1000 * dup // lines, 1000 * again // n, 10 * chars // n)))

    def quantile(held, level):
        held = sorted(v if v < 2048 else ((v >> v.bit_length() - 11) + 1 << v.bit_length() - 11) - 1 for v in held)
        return held[-(-level * len(held) // 1000) - 1]

    out = []
    for (key, _, lang, source), m in zip(given, measured):
        base = m[0] < 50 or 100 * m[5] > 50 * m[0]
        kept = not base
        if m[0]:
            for rule, tail in tails.items():
                own, others = ([values(x)[rule] for x, r in zip(measured, given) if x[0] and of(r)] for of in (lambda r: r[2:] == (lang, source), lambda r: r[2] == lang))
                middle, high = ((len(own) * quantile(own, level) + pull * quantile(others, level)) // (len(own) + pull) for level in (500, tail))
                kept = kept and values(m)[rule] <= high + 3 * max(high - middle, 1)
        out.append((key, base, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pull", [0, 6, 1000])
def test_thresholds_follow_language_and_source(spark, pull):
    rnd = random.Random(pull)
    given = [(n, t + " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([0, 30, 60]))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for n, t in enumerate(random_texts(2, 70))]
    given += [(*r[:4],) for r in ODD]
    table = with_clashes(spark.createDataFrame(given, DOCS).repartition(3), "kept", "n_words", "rule", "failed", "a.b")
    got = quality_rules.judge(table, pull=pull)
    assert rows(got.select("doc_id", "base_failed", "kept")) == plain_verdicts(given, pull)
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_limits_come_from_the_groups(spark):
    """Symbols are usual in one source and not in the other; a group's own documents decide, and a small language is not judged by another."""
    rnd = random.Random(1)

    def text(share):
        return " ".join(f"w{rnd.randint(0, 10**6)}" + ("|" if rnd.random() < share else "") for _ in range(80))

    given = [(n, text(0.4), "en", "tables") for n in range(300)] + [(1000 + n, text(0), "en", "books") for n in range(2000)] + [(5000, text(0.2), "en", "books"), (5001, text(0.4), "en", "tables")]
    given += [(6000 + n, " ".join("x" * 30 + str(rnd.randint(0, 10**6)) for _ in range(60)), "fi", "books") for n in range(8)]
    judged = {r["doc_id"]: (r["kept"], r["failed"]) for r in quality_rules.judge(spark.createDataFrame(given, DOCS).repartition(4)).collect()}
    assert judged[5000] == (False, ["symbols"]) and judged[5001][0] and all(judged[6000 + n][0] for n in range(8))
    assert sum(judged[n][0] for n in range(300)) > 295 and all(judged[1000 + n][0] for n in range(2000))


def test_long_words_are_judged_by_their_own_group(spark):
    rnd = random.Random(5)
    text = lambda size: " ".join(f"{rnd.getrandbits(4 * size):0{size}x}" for _ in range(50))
    given = [(n, text(250 + n % 71), "zh", "books") for n in range(120)] + [(1000, text(2000), "zh", "books")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(given, DOCS).repartition(3)).collect()}
    assert kept == {n: n < 1000 for n in kept} and len(kept) == 121


def test_buckets_have_no_ceiling(spark):
    values = [*range(0, 5000, 7), 2047, 2048, 2049, 10**6, 10**9, 2**31, 2**40 + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket("v").alias("b")).collect()
    assert all(r["b"] == r["v"] if r["v"] < 2048 else r["v"] <= r["b"] < r["v"] * 1.001 for r in got) and len(got) == len(values)


# --- Exact dedup


@pytest.mark.parametrize("bits", [64, 3])
def test_equal_texts(spark, bits):
    """With 3 bits nearly all chunk hashes collide, and contents decide."""
    rnd = random.Random(bits)
    pool = [LONG, LONG + ".", "x" * 9000, "x" * 9001, "a\n" * 700, "a\n" * 699 + "b\n", "short", "Short", "short ", "", None, "é" * 600 + ". " + "ü" * 700]
    given = [(rnd.choice([n, n % 5, None]), rnd.choice(pool), "en", "s") for n in range(120)] + list(ODD)
    got = exact_dedup.dedup(with_clashes(spark.createDataFrame(given, DOCS).repartition(5), "key", "row", "recipe", "kept"), hash_bits=bits).collect()
    groups = defaultdict(list)
    for key, text, _, _ in given:
        groups[text or ""].append(key)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): keys for t, keys in groups.items()}
    assert len(got) == len(given)
    kept = Counter()
    for r in got:
        keys = by_hash[r["text_sha256"]]
        largest = max((k for k in keys if k is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (largest, len(keys))
        assert not r["kept"] or r["doc_id"] == largest
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_chunks_join_to_the_text(spark):
    texts = [t or "" for t in (r[1] for r in ODD)] + ["x" * 9000, "ab. " * 3000, "\n" * 2000, "🙂" * 5000]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in table.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(0 < len(c) <= 4097 for c in r["c"])


def test_chunks_meet_again_after_a_change(spark):
    sentence = [f"Sentence number {n} of this text is here. " for n in range(400)]
    table = spark.createDataFrame([("".join(sentence),), ("New start. " + "".join(sentence),)], "t string")
    one, two = (set(r["c"]) for r in table.select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert len(one & two) > 0.5 * len(one)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_mixed_words_of_repeated_rows(spark, seed):
    """Rows alike in all columns at the place of the cut: the source still gives its budget to the word."""
    rnd = random.Random(seed)
    given = [(rnd.choice([7, 7, 7, None, 1, 2]), "w " * (5 if rnd.random() < 0.7 else rnd.randint(0, 9)), "en", rnd.choice(["a", "a", "b"])) for _ in range(60)]
    given += [(n, "v " * 100, "en", "c") for n in range(seed)]
    table = spark.createDataFrame(given, DOCS).repartition(4)
    want = Counter()
    for r in mixing.shares(table).collect():
        want[r["source"]] += r["taken"]
    got, copies = Counter(), Counter()
    for r in mixing.mix(table).collect():
        got[r["source"]] += len(words(r["text"]))
        copies[r["doc_id"], r["source"], len(words(r["text"]))] += 1
    assert got == +want
    there = Counter((r[0], r[3], len(words(r[1]))) for r in given)
    assert all(n <= 3 * there[k] + 1 for k, n in copies.items() if k in there)
