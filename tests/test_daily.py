"""The daily chain on a few Korean articles."""

import datetime as dt

from tidewire.operators.viewpoints import ViewpointWords
from tidewire.plans.daily import run_day, update_scopes


def test_daily_chain(spark):
    at = dt.datetime(2024, 1, 2, 9)
    body = "한국은행이 기준금리를 인상했다고 밝히며 시장에 충격을 주었다. 물가 상승률이 전년 대비 3% 증가했다고 통계청이 발표했다. 전문가들은 금리 인상이 이어질 것으로 내다보고 있다."
    rows = [(i, f"R{i}", f"A{i}", f"u{i}", f"언론{i % 2}", f"금리 인상 소식 {i}", body.replace("3%", f"{i}%") + f" 추가 문장 번호 {chr(0xAC00 + 40 * i) * 6} 입니다.", at, at + dt.timedelta(minutes=i)) for i in range(1, 5)]
    raw = spark.createDataFrame(rows + [(9, "R9", "A9", "u1", "언론", "중복", body, at, at)],
                                "seq int, raw_id string, article_id string, url string, press string, title string, raw_text string, published_at timestamp, collected_at timestamp")
    corpus = spark.createDataFrame([], "article_id string, url string, title string, press string")
    scopes = spark.createDataFrame([], "scope_id string, centroid array<double>, news_count bigint, scope_title string")
    probabilities = spark.createDataFrame([(f"A{i}", 0.9, 0.1) for i in range(1, 4)], "doc_id string, positive double, negative double")
    lexicon = spark.createDataFrame([("충격", "negative", 1.0)], "keyword string, sentiment string, weight double")
    day = run_day(raw, corpus, scopes, probabilities, lexicon, ViewpointWords({"worry": ["충격"]}), "20240102", dimension=32)
    states = {r["raw_id"]: r["status"] for r in day.statuses.collect()}
    assert states["R1"] == "accepted" and states["R9"] == "skipped_duplicate_url"
    articles = day.articles.collect()
    assert all(r["scope_id"].startswith("20240102-") and r["perspective"] and r["summary"] for r in articles)
    assert {r["sentiment"] for r in articles} <= {"positive", "neutral", "negative"}
    made = day.scopes.collect()
    assert sum(r["news_count"] for r in made) == len(articles) and all(r["scope_title"] for r in made)
    assert update_scopes(scopes, day.scopes).count() == len(made)
    assert day.keyword_metrics.count() > 0 and day.top_issue.count() >= 1


def test_second_run_sees_the_stored_articles(spark):
    """A scope with older articles keeps what they say, and a day that is run twice counts both runs."""
    at = dt.datetime(2024, 1, 2, 9)
    body = "한국은행이 기준금리를 인상했다고 밝히며 시장에 충격을 주었다. 물가 상승률이 전년 대비 증가했다고 통계청이 발표했다."
    fields = "seq int, raw_id string, article_id string, url string, press string, title string, raw_text string, published_at timestamp, collected_at timestamp"

    def raw(numbers):
        return spark.createDataFrame([(i, f"R{i}", f"A{i}", f"u{i}", f"언론{i}", f"금리 인상 소식 {i}", f"{body} 추가 문장 번호 {chr(0xAC00 + 40 * i) * 6} 입니다.", at, at + dt.timedelta(minutes=i)) for i in numbers], fields)

    def encoder(frames):
        for pdf in frames:
            yield pdf.assign(embedding=[[1.0, 0.0]] * len(pdf))[["article_id", "embedding"]]

    corpus = spark.createDataFrame([], "article_id string, url string, title string, press string")
    empty = spark.createDataFrame([], "scope_id string, centroid array<double>, news_count bigint, scope_title string, scope_keywords string")
    likely = spark.createDataFrame([(f"A{i}", 0.95, 0.05) for i in range(1, 9)], "doc_id string, positive double, negative double")
    lexicon = spark.createDataFrame([("없음", "negative", 1.0)], "keyword string, sentiment string, weight double")
    words = ViewpointWords({"worry": ["충격"]})
    one = run_day(raw(range(1, 7)), corpus, empty, likely, lexicon, words, "20240102", encoder=encoder, dimension=2)
    scopes = update_scopes(empty, one.scopes)
    first = one.scopes.first()
    two = run_day(raw([7]), one.articles.select("article_id", "url", "title", "press"), scopes, likely, lexicon, words, "20240102", encoder=encoder, dimension=2, stored=one.articles)
    second = two.scopes.first()
    assert two.articles.count() == 1 and second["scope_id"] == first["scope_id"] and second["news_count"] == 7
    assert first["sentiment_score"] and abs(second["sentiment_score"] - first["sentiment_score"]) < 1e-6
    assert set(first["scope_keywords"].split(",")) & set(second["scope_keywords"].split(","))
    before = {r["keyword"]: r["article_count"] for r in one.keyword_metrics.collect()}
    after = {r["keyword"]: r["article_count"] for r in two.keyword_metrics.collect()}
    assert all(after[k] >= n for k, n in before.items()) and sum(after.values()) > sum(before.values())
