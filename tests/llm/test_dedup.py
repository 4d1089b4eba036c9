"""The deduplicating operators against plain code, on copies, edits, shared passages, nulls, ties and odd columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.plain import covered, grouped, shingles
from tidewire.llm import jaccard_join
from tidewire.llm.components import components
from tidewire.llm.jaccard_join import drop_near_duplicates, link_classes, near_duplicates
from tidewire.llm.substring_dedup import remove_passages
from tidewire.llm.suffix_dedup import Suffixes, merge_sorted, ranks, remove_strings

SCHEMA = "doc_id long, text string"


def sample() -> list:
    rnd = random.Random(11)
    words = ["w%d" % rnd.randrange(400) for _ in range(420)]
    rows = [(k, " ".join("x%d" % rnd.randrange(3000) for _ in range(rnd.randrange(5, 160)))) for k in range(60)]
    rows += [(900, None), (901, ""), (902, "  \n"), (None, " ".join(words[:120])), (None, " ".join(words[:120])), (903, "One two"), (904, "one  TWO"), (905, "a " * 400), (906, "a " * 90), (7, "a " * 70)]
    rows += [(950, " ".join(words)), (950, " ".join(words)), (940, "é " * 60 + " ".join(words[60:130]))]
    current = words[:]
    for k in range(70):
        new = (current if k % 3 else words)[:]
        for _ in range(rnd.randrange(1, 12)):
            new[rnd.randrange(len(new))] = "e%d" % rnd.randrange(40)
        if k % 5 == 0:
            current = new
        rows.append((1000 + rnd.randrange(65), " ".join(new[rnd.randrange(40) :])))
    passage = " ".join(words[200:262])
    rows += [(2000 + k, f"{passage}\n" + " ".join("u%d" % rnd.randrange(10**6) for _ in range(rnd.randrange(4, 50)))) for k in range(40)]
    rnd.shuffle(rows)
    return rows


def digest(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


@pytest.mark.parametrize("most", [4 << 20, 3000])
def test_passages(spark, most):
    rows = sample()
    want = sorted([(i, len(w), sum(g), digest(b" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, w, g in covered(rows, lambda t: (t or "").encode().split(), 50)], key=str)
    # other columns with clashing names are not read
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1)).withColumn("block", F.lit("x")).withColumn("rest", F.lit(None))
    got = sorted([(r.doc_id, r.n_words, r.n_removed, digest(b" ".join(r.kept.encode().split()))) for r in remove_passages(docs, most=most).collect()], key=str)
    assert got == want


@pytest.mark.parametrize("most", [4 << 20, 3000])
def test_strings(spark, most):
    rows = sample()
    want = sorted([(i, len(w), sum(g), sum(g[k] and not (k and g[k - 1]) for k in range(len(g))), digest(bytes(x for x, y in zip(w, g, strict=True) if not y))) for i, w, g in covered(rows, lambda t: (t or "").encode(), 50)], key=str)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept))) for r in remove_strings(spark.createDataFrame(rows, SCHEMA), most=most).collect()], key=str)
    assert got == want


@pytest.mark.parametrize("most", [4 << 20, 5000])
def test_near_duplicates(spark, most):
    rows = sample()
    want = grouped(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(5)).withColumn("component", F.lit("c"))
    got = near_duplicates(docs, most=most).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    kept = drop_near_duplicates(docs, most=most, carry=["key"]).collect()
    assert len(kept) == len({w[3] for w in want})
    ids = sorted(str(r.doc_id) for r in kept if shingles(r.text))
    assert ids == sorted(str(least) for least, _ in {(w[2], w[3]) for w in want if w[1]})
    assert {r.rest.key for r in kept} == {5}


def test_one_chain_of_links_is_one_group(spark):
    words = ["c%d" % k for k in range(300)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(12)]  # neighbours link, the ends do not
    assert {r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    assert {w[2] for w in grouped(rows)} == {0}


def test_unlike_documents_around_one_passage(spark, monkeypatch):
    """Own words bring most pairs just above or below the threshold; shared own phrases link some of them again."""
    rnd = random.Random(5)
    passage = ["p%d" % k for k in range(120)]
    phrases = [["q%d_%d" % (k, j) for j in range(12)] for k in range(6)]
    rows = []
    for k in range(260):
        own = ["o%d_%d" % (k, j) for j in range(rnd.randrange(3, 34))]
        start = rnd.randrange(0, 12)
        rows.append((k, " ".join((rnd.choice(phrases) if k % 3 else []) + passage[start:] + own)))
    want = sorted(w[:3] for w in grouped(rows))
    assert len({w[2] for w in want}) > 20  # not one group
    monkeypatch.setattr(jaccard_join, "link_classes", lambda sets, percent: link_classes(sets, percent, 3))
    assert sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), most=9000).collect()) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    assert remove_passages(empty).collect() == []
    assert remove_strings(empty).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 150)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150}


def test_suffix_sort(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    texts = rnd.integers(97, 99, (400, 20)).astype(np.uint8)
    texts[100:200] = texts[:100]
    group = rnd.integers(0, 3, 400)
    order = merge_sorted(Suffixes(texts), group)
    keys = [(int(group[i]), texts[i].tobytes(), i) for i in order]
    assert keys == sorted(keys)
    order, common = ranks(texts, group)
    for k in range(1, 400):
        a, b = texts[order[k - 1]].tobytes(), texts[order[k]].tobytes()
        same = next((j for j in range(20) if a[j] != b[j]), 20)
        assert common[k] == (same if group[order[k - 1]] == group[order[k]] else -1)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_under_polynomial_hashes(spark):
    """The two words have equal polynomial hashes modulo 2 ** 64, whatever base and letter values."""
    import public_tokenizers

    from tidewire.llm.bpe import Vocabulary, encode

    u = thue_morse(1024)
    v = u.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one {u} two three four five"), (2, f"one {v} two three four five"), (3, " ".join([u] + [f"w{k}" for k in range(60)])), (4, " ".join([v] + [f"w{k}" for k in range(49)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library = Vocabulary.at(public_tokenizers.path("byte_bpe_50k.json")).library
    got = {r.doc_id: (r.ids, r.decoded) for r in encode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == {i: (library.encode(t).ids, t) for i, t in rows}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in remove_passages(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    from tidewire.llm import bpe

    monkeypatch.setattr(bpe, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"onetwotwoonefour", dtype=np.uint8)
    first, like = bpe.distinct_words(data, np.array([0, 3, 6, 9, 12]))
    assert first.tolist() == [0, 1, 4] and like.tolist() == [0, 1, 1, 0, 2]
