"""Reports composed from the smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.keywords import keyword_list
from tidewire.functions.labels import base_date_label, clock_label, dominant_label, half_even_percent, opinion_sentence, percent_label
from tidewire.functions.text import strip_leading_tag, suggestion_words
from tidewire.operators import aggregates as ag
from tidewire.operators.filters import any_word, boosted_or, enabled, kw_contains, phrase, phrase_prefix, since_days
from tidewire.operators.joins import scope_search, viewpoint_select
from tidewire.operators.ranking import mode_by, prefix_within, sample_one, top_per
from tidewire.session import durable


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keyword_tests(keyword: str, columns=("keywords", "title", "summary", "content")) -> list:
    """(predicate, boost) pairs of the keyword search."""
    boosts = {"keywords": 8, "title": 5, "summary": 3, "content": 2}
    return [(kw_contains("keywords", keyword) if c == "keywords" else phrase(_text(c), keyword), boosts[c]) for c in columns]


def keyword_match(keyword: str, columns=("keywords", "title", "summary", "content")) -> Column:
    hit = F.lit(False)
    for test, _ in keyword_tests(keyword, columns):
        hit = hit | F.coalesce(test, F.lit(False))
    return hit



def newest_first() -> list:
    return [F.desc("published_at"), F.asc("article_id")]


def _newest(df: DataFrame, n: int | None) -> DataFrame:
    """The newest n rows, durable since several readers share them; all rows without a number."""
    return durable(df.orderBy(*newest_first()).limit(n)) if n else df


def _newest_per(df: DataFrame, key: str, n: int | None) -> DataFrame:
    return top_per(df, [key], newest_first(), n) if n else df


def keyword_detail(articles: DataFrame, scopes: DataFrame, keyword: str, newest: int | None = None) -> DataFrame:
    """Total, sentiment split, press count and leading viewpoint of a keyword (D18): one row. ``newest`` narrows the
    press count and the viewpoint to so many articles.

    The split divides by all matching articles, so unlabelled ones fall to negative."""
    hits = enabled(articles).filter(kw_contains("keywords", keyword))
    counts = hits.agg(F.count("*").alias("total_count"), F.count_distinct("scope_id").alias("scope_count"), *ag.label_counts())
    top = _newest(ag.first_ranked(hits).select("press", "category", "published_at", "article_id"), newest)
    votes = top.filter(~F.col("category").isin(*ko.UNCLASSIFIED)).groupBy("category").agg(F.count("*").alias("n"))
    flow = votes.agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))))
    press = top.agg(F.count_distinct("press"))
    issues = scopes.filter(kw_contains("scope_keywords", keyword)).agg(F.count("*"))
    out = ag.sentiment_percent(counts, "total_count")
    return out.select(
        F.lit(keyword).alias("keyword"), "total_count", "scope_count", "positive_percent", "neutral_percent", "negative_percent",
        press.scalar().alias("press_count"), F.coalesce(flow.scalar(), F.lit("관점 분석 없음")).alias("flow"),
        issues.scalar().alias("issue_count"),
    )


def keyword_articles(articles: DataFrame, keyword: str, newest: int = 50) -> DataFrame:
    from tidewire.operators.filters import article_card

    hits = enabled(articles).filter(kw_contains("keywords", keyword))
    return article_card(hits.orderBy(*newest_first()).limit(newest))


def sentiment_compare(articles: DataFrame, keyword: str, now, days: int = 3) -> DataFrame:
    """The newest article per sentiment on a keyword in the last days."""
    recent = since_days(enabled(articles), "published_at", days, now).filter(F.col("sentiment").isin(*ko.SENTIMENT_NAMES))
    tests = keyword_tests(keyword, ("keywords", "title", "summary"))
    found = boosted_or(recent, tests)
    return top_per(found, ["sentiment"], [F.desc("published_at"), F.desc("score"), F.asc("article_id")], 1)


def press_samples(articles: DataFrame) -> DataFrame:
    """The newest article of each press (E2): a max-by aggregation, one row per press and task shuffled."""
    order = F.struct(F.col("published_at"), F.col("article_id"))
    return articles.filter(F.col("press").isNotNull() & F.col("url").isNotNull()).groupBy("press").agg(
        F.max_by(F.struct("article_id", "url", "title"), order).alias("a")
    ).select("press", "a.*")


def viewpoint_cards(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Every category of every group with count, percent of the total and label, ordered inside its group."""
    total = counts.agg(F.sum("cnt"))
    rows = groups.join(counts, "category", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    rows = rows.withColumn("percent", half_even_percent("cnt", F.coalesce(total.scalar(), F.lit(0))))
    return rows.withColumn("percent_label", percent_label("cnt", "percent")).select(
        "group_name", "category", "cnt", "percent", "percent_label"
    )


def viewpoint_groups(spark) -> DataFrame:
    """The fixed dimension of groups and categories."""
    rows = [(g, c, i) for i, (g, c) in enumerate((g, c) for g, cs in ko.VIEWPOINT_GROUPS.items() for c in cs)]
    return spark.createDataFrame(rows, "group_name string, category string, sort_order int")


def viewpoint_detail(articles: DataFrame, master: DataFrame, keyword: str = "") -> DataFrame:
    """Count, percent, latest date, sentiment split and top keywords for every master category at once."""
    live = enabled(articles)
    if keyword:
        live = live.filter(keyword_match(keyword))
    ranked = ag.first_ranked(live).filter(F.col("category").isNotNull() & ~F.col("category").isin(*ko.UNCLASSIFIED))
    sums = ranked.groupBy("category").agg(
        F.count("*").alias("cnt"), F.max("published_at").alias("latest_at"), *ag.label_counts()
    )
    words = ranked.select("category", F.explode(keyword_list("keywords")).alias("keyword")).groupBy("category", "keyword").agg(
        F.count("*").alias("n")
    )
    top = top_per(words, ["category"], [F.desc("n"), F.asc("keyword")], 8, "pos").groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "keyword")))["keyword"], ",").alias("top_keywords")
    )
    total = sums.agg(F.sum("cnt")).scalar()
    full = master.join(sums, master["es_category"] == sums["category"], "left").join(top, "category", "left")
    zero = {c: 0 for c in ("cnt", "positive", "neutral", "negative")}
    full = ag.sentiment_percent(full.fillna(zero))
    return full.select(
        "group_name", "display_title", "es_category", "cnt",
        half_even_percent("cnt", F.coalesce(total, F.lit(0))).alias("percent"),
        base_date_label("latest_at").alias("date_label"),
        "positive_percent", "neutral_percent", "negative_percent", F.coalesce("top_keywords", F.lit("")).alias("top_keywords"),
    )


def viewpoint_newest(articles: DataFrame, category: str, n: int = 5) -> DataFrame:
    ranked = ag.first_ranked(enabled(articles)).filter(F.col("category") == category)
    return ranked.orderBy(*newest_first()).limit(n)


def scope_detail(articles: DataFrame, scopes: DataFrame, newest: int | None = None) -> DataFrame:
    """Per scope: article count, sentiment split, update clock (D26), for all scopes in one pass; over all its articles
    or the ``newest`` of them."""
    live = enabled(articles).filter(F.col("scope_id").isNotNull())
    top = _newest_per(live.select("scope_id", "article_id", "published_at", "sentiment"), "scope_id", newest)
    label = F.when(F.col("sentiment").isin(*ko.SENTIMENT_NAMES), F.col("sentiment")).otherwise("neutral")
    sums = top.withColumn("sentiment", label).groupBy("scope_id").agg(F.count("*").alias("article_count"), *ag.label_counts())
    zero = {c: 0 for c in ("article_count", "positive", "neutral", "negative")}
    full = ag.sentiment_percent(scopes.select("scope_id", "scope_title", "scope_keywords", "updated_at").join(sums, "scope_id", "left").fillna(zero))
    return full.select(
        "scope_id", "scope_title", F.array_join(F.slice(keyword_list("scope_keywords"), 1, 5), ",").alias("first_keywords"),
        "article_count", "positive_percent", "neutral_percent", "negative_percent", clock_label("updated_at").alias("updated_clock"),
    )


def scope_viewpoints(articles: DataFrame, newest: int | None = None, n: int = 4) -> DataFrame:
    """The n most frequent viewpoints of all ranks in a scope's articles, or the ``newest`` of them, as a share of those."""
    live = enabled(articles).filter(F.col("scope_id").isNotNull())
    top = _newest_per(live.select("scope_id", "article_id", "published_at", "perspective"), "scope_id", newest)
    totals = top.groupBy("scope_id").agg(F.count("*").alias("articles"))
    counts = top.select("scope_id", F.explode("perspective").alias("p")).select("scope_id", F.col("p.category").alias("category")).filter(
        F.col("category").isNotNull() & ~F.col("category").isin(*ko.UNCLASSIFIED)
    ).groupBy("scope_id", "category").agg(F.count("*").alias("cnt"))
    best = top_per(counts, ["scope_id"], [F.desc("cnt"), F.asc("category")], n)
    return best.join(totals, "scope_id").select("scope_id", "category", "cnt", half_even_percent("cnt", "articles").alias("percent"))


def random_scope(articles: DataFrame, scopes: DataFrame, now, seed: int = 0, days: int = 7, min_articles: int = 5) -> DataFrame:
    """One random recent scope that really has enough live articles (F4): the recount replaces retries."""
    live = ag.recount_scopes(articles).withColumnRenamed("news_count", "live_count").filter(F.col("live_count") >= min_articles)
    recent = since_days(scopes, "created_at", days, now).filter(F.col("created_at") <= F.lit(now).cast("timestamp"))
    return sample_one(recent.join(live, "scope_id"), "scope_id", seed)


def random_keyword(metrics: DataFrame, seed: int = 0, best: int = 10) -> DataFrame:
    """One of the ten leading keywords of the newest day."""
    from tidewire.operators.ranking import latest_rows

    return sample_one(latest_rows(metrics, "date").orderBy(F.desc("article_count"), F.asc("keyword")).limit(best), "keyword", seed)


def issue_chips(articles: DataFrame, scopes: DataFrame, topic: str, newest: int | None = None, max_length: int = 32, max_chips: int = 5,
                stopwords=tuple(ko.ISSUE_CHIP_STOPWORDS)) -> DataFrame:
    """Keywords of the scopes behind the matching articles (all, or the ``newest``), until the length budget is used."""
    fields = ["title", "summary", "keywords", "content"]
    match = F.lit(False)
    for c in fields:
        match = match | any_word(_text(c), topic)
    found = enabled(articles).filter(F.col("scope_id").isNotNull() & match)
    ids = _newest(found, newest).select("scope_id").distinct()
    words = scopes.join(ids, "scope_id", "left_semi").select(F.explode(keyword_list("scope_keywords")).alias("keyword"))
    counts = words.filter(
        (F.col("keyword") != topic) & ~F.col("keyword").isin(*stopwords) & ~F.col("keyword").rlike(r"(?U)^\d+$")
    ).groupBy("keyword").agg(F.count("*").alias("cnt"))
    return prefix_within(counts, "keyword", [F.desc("cnt"), F.asc("keyword")], max_length, max_chips)


def dominant_opinions(scopes: DataFrame, articles: DataFrame, topic: str, n: int = 5) -> DataFrame:
    """Sentiment split, leading label and sentence for the topic's best scopes."""
    best = scope_search(scopes, topic, n).select("scope_id", "scope_title", "scope_keywords")
    held = enabled(articles).join(F.broadcast(best.select("scope_id")), "scope_id", "left_semi")  # n rows
    sums = held.groupBy("scope_id").agg(*ag.label_counts())
    full = ag.sentiment_percent(best.join(sums, "scope_id", "left").fillna({c: 0 for c in ko.SENTIMENT_NAMES}))
    title = strip_leading_tag(F.coalesce(F.nullif("scope_title", F.lit("")), F.lit(ko.DEFAULT_TOPIC)))
    return full.select(
        "scope_id", "positive_percent", "neutral_percent", "negative_percent",
        dominant_label("positive_percent", "neutral_percent", "negative_percent").alias("dominant"),
        opinion_sentence(title, "positive_percent", "neutral_percent", "negative_percent").alias("sentence"),
        F.array_join(F.slice(keyword_list("scope_keywords"), 1, 3), ",").alias("chips"),
    )


def suggest(articles: DataFrame, query: str, n: int = 6, scan: int | None = None) -> DataFrame:
    """Up to n words that hold the query, taken from the matching articles, or the best ``scan`` of them, in order."""
    tests = [(F.contains(_text("keywords"), F.lit(query)), 5), (phrase_prefix(_text("title"), query), 3)]
    best = boosted_or(enabled(articles), tests)
    best = best.orderBy(F.desc("score"), *newest_first()).limit(scan) if scan else best
    order = F.struct((-F.col("score")).alias("a"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("b"), F.col("article_id"))
    words = F.concat(
        keyword_list("keywords"),
        F.when(F.contains(_text("title"), F.lit(query)), suggestion_words("title")).otherwise(F.array().cast("array<string>")),
    )
    flat = best.select(order.alias("doc"), F.posexplode(words).alias("pos", "word")).filter(F.contains("word", F.lit(query)))
    first = flat.groupBy("word").agg(F.min(F.struct("doc", "pos")).alias("seen"))
    return first.orderBy("seen").limit(n).select("word")


def press_mode(articles: DataFrame) -> DataFrame:
    """The most frequent sentiment of each press."""
    return mode_by(articles, ["press"], "sentiment", "flow")
