"""Operators and queries take whole texts and tables."""

import datetime as dt
import html
import random
import re

import duckdb
import pandas as pd

import __spark_entry__ as entry
from checks.packs import LATIN
from checks.verify import rows_of
from checks.views import TABLES
from tidewire.functions.packs import KOREAN
from tidewire.operators import models as md
from tidewire.operators import summaries as su

FOLDER = "/root/testdata/sf0.001"


def duck_rows(sql, folder=FOLDER):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    res = con.execute(sql)
    return rows_of([c[0] for c in res.description], res.fetchall())


def spark_rows(spark, name, folder=FOLDER):
    df = entry.queries()[name](spark, folder)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_training_rows_keep_the_whole_body(spark):
    body = "word " * 1000 + "last"
    df = spark.createDataFrame([("a", "title", body, "yes")], "article_id string, title string, clean_text string, label string")
    assert md.training_rows(df).first()["text"] == "title title " + body
    assert md.training_rows(df, body_limit=2000).first()["text"] == ("title title " + body[:2000]).strip()


def test_training_rows_of_repeated_articles(spark, monkeypatch):
    rows = [("a", 2, "t", "later", "yes"), ("a", 1, "", "", "yes"), ("a", 3, "t", "latest", "no"), ("b", 1, "t", "one", "no"), ("c", 1, "t", "x", None), (None, 2, "t", "second", "yes"), (None, 1, "t", "first", "yes")]
    df = spark.createDataFrame(rows, "article_id string, seq int, title string, clean_text string, label string")
    want = [(None, "t t first", 1), ("a", "t t later", 1), ("b", "t t one", 0)]
    for few in (100, 0):
        monkeypatch.setattr(md, "FEW_IDS", few)
        got = md.training_rows(df, seq="seq").select("article_id", "text", "label").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert md.training_rows(df.filter("article_id = 'b'")).count() == 1 and md.training_rows(df.limit(0)).collect() == []


def test_widened_queries_equal_their_sql(spark):
    for name in ("binary_training_rows", "clean_tokens", "page_headlines"):
        assert spark_rows(spark, name) == duck_rows(entry.oracle_sql()[name]), name


def test_scope_sentences_take_all_articles(spark):
    rows = [("s", f"a{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "one", f"Sentence number {i} stands in this article alone.", [1.0, 0.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "scope_id string, article_id string, published_at timestamp, press string, content string, embedding array<double>")
    assert su.scope_sentences(df, pack=LATIN).select("article_id").distinct().count() == 150
    assert su.scope_sentences(df, 100, 3, LATIN).select("article_id").distinct().count() == 3


def test_scope_summary_is_that_of_the_whole_scope(spark):
    plain = "Sentence about the harbour and its boats number"
    rows = [("s", f"a{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "one", f"{plain} {chr(97 + i % 26)}{chr(97 + i // 26)}.", [0.0, 1.0]) for i in range(120)]
    rows[0] = (*rows[0][:4], "The 3 boats of the nation with the best position on day 12.", [0.0, 1.0])  # the oldest scores highest
    df = spark.createDataFrame(rows, "scope_id string, article_id string, published_at timestamp, press string, content string, embedding array<double>")
    scopes = spark.createDataFrame([("s", "")], "scope_id string, scope_keywords string")
    assert su.scope_summaries(df, scopes, pack=LATIN).first()["scope_summary"] == rows[0][4]


def test_distinct_sentences_equal_a_pass_in_order(spark):
    rng = random.Random(3)
    words = ["harbour", "boat", "nation", "position", "market", "paper", "river", "winter", "morning", "engine", "letter", "garden"]
    rows, pos = [], 0
    for scope, articles in (("a", 60), ("b", 8), ("c", 1)):
        base = [[rng.choice(words) for _ in range(8)] for _ in range(6)]
        for _ in range(articles):
            pos += 1
            for spos in range(3):
                line = list(rng.choice(base))
                for _ in range(rng.choice((0, 0, 1, 2, 4))):
                    line[rng.randrange(8)] = rng.choice(words)
                rows.append((scope, f"d{pos}", pos, spos, " ".join(line)))
    names = ["scope_id", "article_id", "pos", "spos", "sentence"]
    df = spark.createDataFrame(rows, "scope_id string, article_id string, pos bigint, spos int, sentence string")
    want = pd.concat([su.drop_similar(0.85)(part) for _, part in pd.DataFrame(rows, columns=names).groupby("scope_id")])
    got = su.distinct_sentences(df, group_rows=20).select(*names).collect()
    assert 10 < len(want) < len(rows) - 10
    assert sorted(map(tuple, got)) == sorted(want.itertuples(index=False, name=None))


def test_page_headlines_equal_a_plain_parser_on_all_pages(spark):
    pages = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    found = {key: re.search(r"(?s)<article[^>]*>.*?<h1>(.*?)</h1>", text) for key, text in pages}
    want = {key: re.sub(r"\(.*?\)", "", html.unescape(m[1] if m else "")).strip(" ") for key, m in found.items()}
    assert any(m and "&" in m[1] for m in found.values())
    got = entry.queries()["page_headlines"](spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: r["author"] for r in got} == want and len(got) == len(pages)


def test_clean_tokens_equal_plain_code_on_all_words(spark):
    texts = duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall()
    want = {}
    for word in {w for (text,) in texts for w in re.split(r"\s+", text) if w}:
        cleaned = word
        for pattern in KOREAN.token_clean_patterns:
            cleaned = re.sub(pattern, " ", cleaned)
        want[word] = " ".join(cleaned.split()) or None
    assert any(re.search(r"[0-9.,]", w) for w in want)
    got = entry.queries()["clean_tokens"](spark, FOLDER).collect()
    assert {r["w"]: r["cleaned"] for r in got} == want and len(got) == len(want)


def test_grams_of_a_word_are_made_once():
    su.word_grams.cache_clear()
    text = "The market and the market and a paper"
    want = su.Counter(f" {w} "[i : i + n] for w in text.lower().split() for n in (2, 3) for i in range(max(1, len(w) + 3 - n)))
    assert su.gram_counts(text) == want
    assert su.word_grams.cache_info().misses == len(set(text.lower().split()))
