"""The daily batch as one chain of table-to-table stages.

Every stage is a function of whole tables and may run on its own. Results that later stages read several times are
written durably in between, so a lost executor repeats one stage and not the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.text import clean_credit_title
from tidewire.operators import aggregates as ag
from tidewire.operators.aggregates import day_of
from tidewire.operators.ingest import accepted_articles, dedup_ingest
from tidewire.operators.models import embed, score_sentiment
from tidewire.operators.scopes import assign_scopes
from tidewire.operators.summaries import scope_summaries, textrank_summary
from tidewire.operators.tables import patch
from tidewire.operators.topics import keyword_text, scope_titles, tfidf_keywords, title_nouns
from tidewire.operators.viewpoints import ViewpointWords, classify_viewpoints
from tidewire.session import durable


@dataclass
class DailyResult:
    statuses: DataFrame
    articles: DataFrame
    scopes: DataFrame
    keyword_metrics: DataFrame
    top_issue: DataFrame


def run_day(raw: DataFrame, corpus: DataFrame, scopes: DataFrame, probabilities: DataFrame, lexicon: DataFrame,
            words: ViewpointWords, day: str, pack: TextPack = KOREAN, encoder=None, tokenizer=None, dimension: int = 768,
            stored: DataFrame | None = None) -> DailyResult:
    """Clean-up, embedding, scopes, sentiment, keywords, summaries, scope texts, viewpoints, metrics and report.

    ``raw``: the day's collected rows with seq, raw_id, article_id, url, press, title, raw_text, published_at and
    collected_at. ``corpus``: article_id, url, title, press of what is known. ``probabilities``: doc_id (an article
    id), positive, negative from the caller's sentiment model. ``stored``: the enriched articles of earlier runs
    (``DailyResult.articles``). Scope titles, keywords, sentiment and summaries are those of all articles of a changed
    scope, metrics and top issues those of all articles of a touched day.
    """
    statuses = durable(dedup_ingest(raw, corpus))
    fresh = durable(accepted_articles(raw, statuses, pack, tokenizer))
    vectors = durable(embed(fresh, encoder, dimension))
    homes, changed = assign_scopes(
        fresh.select("article_id", "collected_at").join(vectors, "article_id"), scopes.select("scope_id", "centroid", "news_count"), day, dimension=dimension)
    docs = fresh.select(F.col("article_id").alias("doc_id"), "title", "content", "tokens")
    feelings = score_sentiment(docs, probabilities, lexicon).withColumnRenamed("doc_id", "article_id")
    nouns = title_nouns(clean_credit_title("title", pack), pack)
    keywords = keyword_text(tfidf_keywords(docs.withColumn("title_nouns", nouns), pack=pack)).withColumnRenamed("doc_id", "article_id")
    summaries = textrank_summary(docs.select("doc_id", F.col("content").alias("text")), pack=pack).withColumnRenamed("doc_id", "article_id")
    enriched = fresh.withColumn("is_disabled", F.lit(False))
    for part in (vectors, homes, feelings, keywords, summaries):
        enriched = enriched.join(part, "article_id", "left")
    enriched = durable(enriched)
    articles = durable(enriched.join(classify_viewpoints(enriched, words, pack), "article_id"))
    members = days = articles
    if stored is not None:
        columns = [c for c in articles.columns if c in stored.columns]
        old = stored.select(*columns).join(articles.select("article_id"), "article_id", "left_anti")
        touched = articles.select(day_of("published_at").alias("_day")).distinct()
        members = durable(articles.unionByName(old.join(changed.select("scope_id"), "scope_id", "left_semi"), allowMissingColumns=True))
        of_days = old.withColumn("_day", day_of("published_at")).join(touched, "_day", "left_semi").drop("_day")
        days = durable(articles.unionByName(of_days, allowMissingColumns=True))
    known = scopes.select("scope_id", "scope_keywords") if "scope_keywords" in scopes.columns else None
    scope_rows = durable(
        changed.join(scope_titles(members, pack=pack), "scope_id", "left")
        .join(ag.scope_keywords(members, known).select("scope_id", "scope_keywords"), "scope_id", "left")
        .join(ag.scope_sentiment(members), "scope_id", "left"))
    scope_rows = scope_rows.join(scope_summaries(members, scope_rows, pack=pack), "scope_id", "left")
    return DailyResult(statuses, articles, scope_rows, ag.daily_keyword_metrics(days, pack=pack), ag.daily_top_issue(days, pack=pack))


def update_scopes(scopes: DataFrame, changed: DataFrame) -> DataFrame:
    """Put the day's scope values over the stored ones and add the new scopes."""
    columns = [c for c in changed.columns if c != "scope_id" and c in scopes.columns]
    known = patch(scopes, changed, ["scope_id"], columns)
    fresh = changed.select("scope_id", *columns).join(scopes.select("scope_id"), "scope_id", "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)
