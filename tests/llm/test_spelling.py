"""Spelling variants against plain code."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.llm.spelling_variants import common_prefix, near_words, noisy_runs, scan, variant_forms, vocabulary

WORDS = "word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(counts, ratio=10):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return out


def random_words(rnd, n, letters="abé", least=7, most=9, head=""):
    return list({head + "".join(rnd.choice(letters) for _ in range(rnd.randrange(least, most + 1))) for _ in range(n)})


@pytest.mark.parametrize("half_of", [lambda n: n // 2, lambda n: n - n // 2])
def test_scan_finds_all_later_words_one_edit_away_with_the_same_half(half_of):
    rnd = random.Random(2)
    keys = sorted(random_words(rnd, 900, "ab", 2, 9))
    lcps = [0, *map(common_prefix, keys, keys[1:])]
    for q in [*keys, "ab", "bbbbbbbbb", "abababababa"]:
        half = half_of(len(q))
        want = [k for k, w in enumerate(keys) if w > q and w[:half] == q[:half] and one_edit(q, w)]
        assert scan(keys, lcps, q, half) == want


@pytest.mark.parametrize("shard_words", [30, 20_000])
def test_forms_and_roots(spark, shard_words):
    rnd = random.Random(4)
    words = random_words(rnd, 500) + random_words(rnd, 300, "xyz", 3, 5, "verylongcommonhead") + ["lonelyword", "ÿ" * 7, "ÿ" * 8]
    counts = {w: rnd.choice([2, 3, 30, 31, 400, 5000]) for w in words}
    got = variant_forms(spark.createDataFrame(list(counts.items()), WORDS).withColumn("root", F.lit(1)).select("word", "n"), shard_words=shard_words)
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == plain_forms(counts)
    assert got.count() == len(counts)


def test_chain_of_forms_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdexh": 200, "abcdyxh": 2000, "zzzzzzz": 3, "zzzzzza": 50, "zzzzzzb": 50}
    got = {r.word: r for r in variant_forms(spark.createDataFrame(list(counts.items()), WORDS)).collect()}
    assert got["abcdefg"].root == "abcdyxh" and got["abcdefg"].form == "abcdefh"
    assert got["zzzzzzz"].form == "zzzzzza" and got["zzzzzza"].form is None and got["zzzzzza"].root == "zzzzzza"


def test_hot_half_is_dealt_to_many_shards(spark):
    """Half of all words begin alike: no shard holds more than its words, and nothing is lost."""
    rnd = random.Random(6)
    words = random_words(rnd, 1500, "abcd", 6, 8, "sameprefix") + random_words(rnd, 1500, "efgh", 7, 9)
    df = spark.createDataFrame([(w, 2) for w in words], WORDS)
    got = {r.word: r.n_near for r in near_words(df, shard_words=100).collect()}
    have = set(words)
    letters = "abcdefghinprsmx"
    for w in words:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        assert got.get(w, 0) == len((edits & have) - {w})


def test_runs_of_documents(spark):
    texts = [(1, "Zeitung Zeitungen, ZEITUNG-Nachrichten Étudiante ×÷äöüßÿ"), (2, None), (3, ""), (None, "Nachrichten nachrichten"), (4, "short words only"), (5, "longer " * 5000 + "x" * 200_000)]
    texts += [(k, "Zeitung nachrichten") for k in range(6, 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    want = Counter()
    for i, text in texts:
        run = ""
        for ch in (text or "") + " ":
            low = ch.lower() if "A" <= ch <= "Z" else ch
            if "a" <= low <= "z" or "À" <= low <= "ÿ":
                run += low
                continue
            if run:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(word) >= 7:
                    want[word] += 1
            run = ""
    got = vocabulary(noisy_runs(df))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n > 1}


def test_empty(spark):
    assert variant_forms(spark.createDataFrame([], WORDS)).collect() == []
    assert near_words(spark.createDataFrame([("abcdefg", 2)], WORDS)).collect() == []
