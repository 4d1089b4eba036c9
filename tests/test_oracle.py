"""Some registered queries against their SQL on the smallest data; checks/verify.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.verify import rows_of
from checks.views import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "daily_top_issue", "keyword_detail", "scope_keywords", "related_articles", "asof_job", "job_stats", "usage_stats", "viewpoint_detail",
    "press_reaction", "issue_chips", "class_report", "daily_trend", "next_scope_ids", "sentiment_scores", "stream_sessions", "stream_vote_states",
    "vote_states", "near_copies", "nearest_vectors", "clean_articles", "page_links", "lexicon_cleaned",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in res.description], res.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0]["article_count"] >= rows[-1]["article_count"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
