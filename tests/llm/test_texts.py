"""Tokens, quality rules, URL rules, weak labels, benchmark matches and shards against plain code."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import bench_words
from tidewire.llm import decontamination
from tidewire.llm.bpe import Vocabulary, encode
from tidewire.llm.quality_rules import drop_rejected, quality_rules
from tidewire.llm.sharding import interleave
from tidewire.llm.token_counts import Pieces, count_tokens, spliceable
from tidewire.llm.url_rules import mine_rules, url_filter, url_tokens
from tidewire.llm.weak_labels import fit_votes, quality_scores

SCHEMA = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"
PARTS = ["'", "s", "t", "re", "ve", "'s", "'ll", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "B", "\u00e9", "1", "\u00b2", "\u0663", "!", "\u2014", "\u65e5", "\U0001f600", "\u0560", "<|endoftext|>", "<|endof", "text|>", "\x00", "\x1c", "\u0085", "_"]


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert spliceable(path)
    model = Pieces.at(path).model
    odd = ["a" * 3000, " " * 4000, "\u65e5\u672c\u8a9e" * 300, "", None, "x  y\n\n   z" * 300, "ab" * 1500 + " " + "=-" * 900, "\u2581" * 500 + " \u2581 " * 300]
    rows = [(5000 + k, t) for k, t in enumerate(odd)] + [(5000, "again"), (None, "no id")]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, SCHEMA)).withColumn("text_key", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    assert Counter(tuple(r) for r in count_tokens(docs, path, chunk=400, overlap=30).collect()) == want
    assert Counter(tuple(r) for r in count_tokens(docs, path).collect()) == want
    assert count_tokens(docs.limit(0), path).collect() == []


@pytest.mark.parametrize("most", [8 << 20, 20_000])
def test_bpe(spark, most):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Vocabulary.at(path).library
    rnd = random.Random(3)
    rows = [(30_000 + k, "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(50)))) for k in range(700)] + [(40_000, None), (40_001, ""), (None, "null id"), (40_001, "twice")]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, SCHEMA)).withColumn("ids", F.lit("x"))
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in encode(docs, path, most=most).collect()) == want
    assert encode(docs.limit(0), path).collect() == []


def plain_counts(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(blank)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark):
    rows = [(9000, None, "en"), (9001, "", None), (9002, "a b c a b c a b\n\na b c a b", "en"), (9003, "\u00c9\u00e9 # * \x1c | x\r\ny\x0bz\n" * 40, None), (9002, "the of and " * 40, "xx"), (None, "le la les des un une " * 30, "fr")]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, SCHEMA + ", lang string")).withColumn("words", F.lit(1)).withColumn("kept", F.lit("x"))
    got = quality_rules(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    kept = drop_rejected(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules(docs.limit(0)).collect() == []


def test_quality_rules_part_junk_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[1] > 0.99 and share[0] < 0.2


def test_weak_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("votes", F.lit(1))
    got = quality_scores(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[1] > 0.97 and share[0] < 0.2
    few = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], SCHEMA)
    assert sorted(str(r.doc_id) for r in quality_scores(few).collect()) == ["1", "2", "2", "None"]
    assert quality_scores(few.limit(0)).collect() == []


def test_label_model_finds_accuracies():
    rnd = random.Random(1)
    accuracy = [0.95, 0.8, 0.65, 0.9]
    truth = [rnd.random() < 0.7 for _ in range(20_000)]
    patterns = Counter("".join("2" if rnd.random() < 0.2 else str(int(t == (rnd.random() < a))) for a in accuracy) for t in truth)
    model = fit_votes(dict(patterns))
    assert abs(model["prior"] - 0.7) < 0.03
    for k, a in enumerate(accuracy):
        assert abs(model["odds"][1, k, 1] - a) < 0.04 and abs(model["odds"][0, k, 0] - a) < 0.04


def test_url_rules(spark):
    given = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    urls = ["http://a.net/x", "https://Q.Example.NET/en/1", "http://notexample.com/de/", "http://example.com/de/y?q#z", "http://x.org/fr/", "http://x.org?fr/", None, "no scheme", "http://bad.org/casino/1", "http://ok.org/news/1", "http://net/", "a://b\nc://net/x"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    labelled = spark.createDataFrame([(f"http://s{k}.org/{'casino' if k % 3 == 0 else 'news'}/{k}", k % 3 == 0) for k in range(90)] + [(None, True), ("http://x.org/", None)], "url string, block boolean")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter(pages, labelled, given, 0.05, 0.6).collect()}
    assert got == {
        (0, "a.net", "/x"): ("net/", "block"), (1, "q.example.net", "/en/1"): ("example.net/en/", "allow"), (None, "q.example.net", "/en/1"): ("example.net/en/", "allow"),
        (2, "notexample.com", "/de/"): (None, "allow"), (3, "example.com", "/de/y"): ("example.com/de/", "block"), (4, "x.org", "/fr/"): ("org/fr/", "allow"),
        (5, "x.org", ""): (None, "allow"), (6, "", ""): (None, "allow"), (7, "", ""): (None, "allow"), (8, "bad.org", "/casino/1"): (None, "block"),
        (9, "ok.org", "/news/1"): (None, "allow"), (10, "net", "/"): ("net/", "block"), (11, "b\nc:", "//net/x"): (None, "allow"),
    }
    assert url_filter(pages.limit(0), labelled.limit(0), given).collect() == []
    alone = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages.filter("page_id < 10"), labelled, [], 0.05, 0.6).collect()}
    assert alone == {k: (None, "block" if k == 8 else "allow") for k in range(10)}


def test_mined_rules_against_plain_counts(spark):
    rnd = random.Random(2)
    rows = [(f"http://{rnd.choice('abc')}.{rnd.choice('de')}.org/{rnd.choice(['p', 'q'])}/{k}", rnd.random() < 0.4) for k in range(200)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    from tidewire.llm.url_rules import host_of, path_of

    tokens = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "block").select(url_tokens().alias("tokens"), "block")
    data = [(set(r.tokens), r.block) for r in tokens.collect()]
    rules = mine_rules(tokens, 0.03, 0.45).collect()
    assert rules
    for rule in rules:
        having = [b for t, b in data if set(rule.antecedent) <= t]
        assert abs(rule.confidence - sum(having) / len(having)) < 1e-9 and rule.confidence >= 0.45 and sum(having) / len(data) >= 0.03


@pytest.mark.parametrize("part", [16 << 20, 3000])
def test_decontamination(spark, part, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_BYTES", part)
    items = [(900, None), (901, ""), (902, "short item"), (None, "rare short"), (903, "a b c d e f g h i j"), (904, "the of"), (902, "short item")]
    rows = [(20_000, None), (20_001, ""), (None, "one two"), (3, "x A b, c d e f g h i J k"), (20_002, "rare short item xx"), (20_003, "a b c d e f g h i j a b c d e f g h i j")]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, SCHEMA)).withColumn("matches", F.lit(1))
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(items, "item_id long, text string"))
    windows = {}
    for r in bench.collect():
        words = bench_words(r.text)
        n = min(10, len(words))
        for s in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[s : s + n]), set()).add(r.item_id)
    want = Counter()
    for r in docs.collect():
        words = bench_words(r.text)
        hit, seen = set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if found := windows.get(tuple(words[s : s + n])):
                    seen |= found
                    hit |= set(range(s, s + n))
        want[(r.doc_id, len(words), len(hit), tuple(sorted(str(i) for i in seen if i is not None)))] += 1
    found = decontamination.find_matches(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.hits(found).collect()) == want
    assert all(m.words >= m.window for r in found.collect() for m in r.matches)
    assert decontamination.find_matches(docs.limit(0), bench).collect() == []
    assert all(not r.matches for r in decontamination.find_matches(docs, bench.limit(0)).collect())


def test_shards(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["a"] * 6 + ["b", "c", None]), rnd.randrange(9)) for k in range(1003)] + [(5, "a", 1), (5, "a", 1), (None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = interleave(docs, "source", "doc_id", 16).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    for source, total in Counter(r[1] for r in rows).items():
        share = Counter(r.shard for r in got if r.source == source)
        assert all(abs(share[s] - total / 16) <= 2 for s in range(16))
    again = {(r.doc_id, r.source, r.size): (r.shard, r.slot) for r in interleave(docs.repartition(7), "source", "doc_id", 16).collect() if r.doc_id not in (5, None)}
    assert again == {(r.doc_id, r.source, r.size): (r.shard, r.slot) for r in got if r.doc_id not in (5, None)}
    assert interleave(docs.limit(0), "source", "doc_id", 16).collect() == []


def test_bpe_packs_and_asks_in_one_python_step(spark):
    """Two Python steps in one stage are two workers in every task."""
    df = spark.createDataFrame([(1, "one word and another"), (2, None)], "doc_id long, text string")
    out = encode(df, public_tokenizers.path("byte_bpe_50k.json"))
    plan = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in line]
    assert len(plan) == 3  # words, blocks, and the end
    assert [r["decoded"] for r in out.orderBy("doc_id").collect()] == ["one word and another", ""]
