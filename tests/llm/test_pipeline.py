"""The corpus pipeline against plain code, stage by stage on each stage's own input, and the registered queries."""

import re
from collections import Counter

import public_tokenizers

import corpus_pipeline
from tests.llm.plain import bench_words, covered, grouped
from tidewire.llm.bpe import Vocabulary
from tidewire.llm.quality_rules import quality_rules
from tidewire.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    first = {}
    for (i, text), (_, _, _, group) in zip(rows, grouped(rows), strict=True):
        if group not in first or i < first[group][0]:
            first[group] = (i, text)
    rows = list(first.values())
    cut = []
    for (_, text), (i, words, gone) in zip(rows, covered(rows, lambda t: (t or "").encode().split(), 50), strict=True):
        cut.append((i, b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else text))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = bench_words(r.text)
        n = min(10, len(words))
        windows |= {tuple(words[s : s + n]) for s in range(len(words) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = [(i, t) for i, t in cut if not any(tuple(w[s : s + n]) in windows for w in [bench_words(t)] for n in sizes for s in range(len(w) - n + 1))]
    assert len(docs.collect()) > len(good) > len(rows) > len(clean) > 0
    library = Vocabulary.at(public_tokenizers.path(corpus_pipeline.TOKENIZER)).library
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in clean)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert sorted(map(str, stage(spark, odd, FOLDER).collect())) == sorted(map(str, odd.collect())), name


def test_every_operator_has_its_query():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
