"""Posting tables against the plain predicates, on repeated words, nulls, repeated keys and an empty table."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import filters as fl
from tidewire.operators import postings as po

ROWS = [
    (1, "The cat, the hat", "A cat sat on the mat"), (2, None, "the the the end"), (3, "", None), (4, "hat the cat", "THE-END"),
    (5, "경제 성장률 둔화", "물가 성장률이 둔화"), (6, "cathat", "mat the on sat"), (7, "a a b a", "a b a a b"),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "article_id long, title string, content string").withColumn("key", F.lit("x")).withColumn("term", F.lit(0))
    path = str(tmp_path_factory.mktemp("postings") / "table")
    po.write_postings(po.postings(docs, ["title", "content"]), path)
    return docs.persist(), po.read_postings(spark, path).persist()


def keys(df):
    found = [r[0] for r in df.collect()]
    assert len(found) == len(set(found))
    return sorted(found)


@pytest.mark.parametrize("query", ["the cat", "the the", "the", "성장률 둔화", "a b a", "a a", "a c", "missing word", "Cat THE hat"])
@pytest.mark.parametrize("field", ["title", "content"])
def test_phrases(stored, query, field):
    docs, table = stored
    assert keys(po.phrase_keys(table, query, field)) == keys(docs.filter(fl.phrase(field, query)).select("article_id"))
    assert keys(po.phrase_prefix_keys(table, query, field)) == keys(docs.filter(fl.phrase_prefix(field, query)).select("article_id"))


def test_weighted_match(stored):
    docs, table = stored
    weights = {"title": 3.0, "content": 1.0}
    want = {r.article_id: r.score for r in fl.multi_match(docs, "cat end", weights).collect()}
    assert {r["key"]: r.score for r in po.match_scores(table, "cat end", weights).collect()} == want


def test_saved_searches(spark, stored):
    docs, table = stored
    asked = [(1, "the end"), (2, "mat"), (3, "the the"), (4, ""), (5, None), (6, "a b a"), (2, "mat"), (7, "the end")]
    found = sorted(tuple(r) for r in po.saved_phrases(table, spark.createDataFrame(asked, "query_id int, query string"), "content").collect())
    want = {(i, k) for i, text in asked if text for k in keys(docs.filter(fl.phrase("content", text)).select("article_id"))}
    assert found == sorted(want)


def test_words_are_read_by_range(spark, stored, tmp_path):
    table = stored[1]
    with pytest.raises(ValueError):
        po.phrase_keys(table, " .. ", "title")
    none = po.postings(spark.createDataFrame([], "article_id long, title string"), ["title"])
    assert po.phrase_keys(none, "the cat", "title").collect() == []
    docs = spark.range(1, 400).select(F.col("id").alias("article_id"), F.concat(F.lit("common w"), F.col("id").cast("string")).alias("title"))
    po.write_postings(po.postings(docs, ["title"]), str(tmp_path / "p"))
    read = po.read_postings(spark, str(tmp_path / "p"))
    po.write_postings(po.postings(docs.select((F.col("article_id") + 1000).alias("article_id"), "title"), ["title"]), str(tmp_path / "p"), "append")
    read = po.read_postings(spark, str(tmp_path / "p"))
    assert keys(po.phrase_keys(read, "common w17", "title")) == [17, 1017]
    plan = po.phrase_keys(read, "common w17", "title")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,common)" in plan and "EqualTo(term,w17)" in plan
    assert "StringStartsWith(term,w1)" in po.phrase_prefix_keys(read, "common w1", "title")._jdf.queryExecution().toString()


def test_building_exchanges_nothing_and_repeated_keys_are_found_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "of the sea"), (1, "the sea of the"), (2, "the of"), (2, "x the"), (3, None)], "article_id long, title string")
    table = po.postings(docs, ["title"])
    assert "Exchange" not in table.sortWithinPartitions("term")._jdf.queryExecution().executedPlan().toString()
    po.write_postings(table, str(tmp_path / "p"))
    read = po.read_postings(spark, str(tmp_path / "p"))
    # 2: "of" at place 1 of one text, "the" at place 1 of the other
    assert keys(po.phrase_keys(read, "of the", "title")) == [1] and keys(po.phrase_keys(read, "the", "title")) == [1, 2]
    asked = spark.createDataFrame([(1, "of the"), (2, "the sea")], "query_id int, query string")
    assert sorted(map(tuple, po.saved_phrases(read, asked, "title").collect())) == [(1, 1), (2, 1)]
