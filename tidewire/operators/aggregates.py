"""Counts, distributions and daily metrics (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.keywords import (
    is_metric_keyword, is_top_issue_keyword, keyword_list, metric_keyword, metric_words, top_issue_words,
)
from tidewire.functions.labels import half_even_percent, stay_text
from tidewire.functions.packs import KOREAN, TextPack
from tidewire.operators.filters import enabled, on_days
from tidewire.operators.intervals import pair_sessions
from tidewire.operators.joins import enrich, reaction_sums
from tidewire.operators.ranking import number_rows, top_per
from tidewire.session import durable


def day_of(ts: str, tz_offset_hours: int = 0) -> Column:
    return F.to_date(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(tz_offset_hours)))


def terms(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.asc(column)).limit(n) if n else counts


def cardinality(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """Distinct values (D2): a sketch by default, exact on request."""
    count = F.count_distinct(column) if exact else F.approx_count_distinct(column)
    return df.agg(count.cast("bigint").alias("distinct_values"))


def collection_summary(raw: DataFrame, articles: DataFrame, first=None, last=None) -> DataFrame:
    """Collected, processed and removed totals plus press, scope and sentiment counts in a date range (D3),
    as (section, label, cnt) rows."""
    collected = on_days(raw, "collected_at", first, last)
    processed = on_days(articles, "collected_at", first, last)
    totals = (
        collected.agg(F.count("*").alias("c"))
        .select("c", processed.agg(F.count("*")).scalar().alias("p"))
        .select(F.expr("stack(3, 'collected', c, 'processed', p, 'removed', greatest(c - p, 0)) AS (label, cnt)"))
        .select(F.lit("total").alias("section"), "label", "cnt")
    )
    # one scan for the three distributions
    parts = processed.select(
        F.explode(F.array(
            F.struct(F.lit("press").alias("section"), F.col("press").alias("label")),
            F.struct(F.lit("scope").alias("section"), F.col("scope_id").alias("label")),
            F.struct(F.lit("sentiment").alias("section"), F.col("sentiment").alias("label")),
        )).alias("x")
    ).select("x.*").filter(F.col("label").isNotNull()).groupBy("section", "label").agg(F.count("*").alias("cnt"))
    return totals.unionByName(parts)


def first_ranked(articles: DataFrame, column: str = "perspective") -> DataFrame:
    """article columns plus the category of the rank-1 element."""
    top = F.get(F.filter(column, lambda p: p["rank"] == 1), 0)
    return articles.withColumn("category", top["category"])


def rank1_counts(articles: DataFrame, keyword: str = "", exclude=tuple(ko.UNCLASSIFIED)) -> DataFrame:
    """Articles per first-ranked category, without the unclassified labels."""
    from tidewire.operators.reports import keyword_match

    df = enabled(articles)
    if keyword:
        df = df.filter(keyword_match(keyword))
    rows = df.select(F.explode("perspective").alias("p")).filter(
        (F.col("p.rank") == 1) & F.col("p.category").isNotNull() & ~F.col("p.category").isin(*exclude)
    )
    return rows.groupBy(F.col("p.category").alias("category")).agg(F.count("*").alias("cnt"))


def per_day(df: DataFrame, ts: str, tz_offset_hours: int = 0) -> DataFrame:
    """Rows per day, empty days left out."""
    return df.filter(F.col(ts).isNotNull()).groupBy(day_of(ts, tz_offset_hours).alias("day")).agg(F.count("*").alias("cnt"))


def histogram(df: DataFrame, column: str, width: float = 0.05) -> DataFrame:
    """Rows per fixed-width bucket."""
    bucket = F.bround(F.floor(F.bround(F.col(column) / width, 9)) * width, 2)
    return df.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def _settled_mean(mean: Column) -> Column:
    """Four decimals, half to even, of a mean whose last bits depend on the order of summation."""
    return F.bround(F.round(mean, 9), 4)


def confidence_stats(articles: DataFrame, first=None, last=None, low: float = 0.55, high: float = 0.8) -> DataFrame:
    """Confidence figures over all and per label (D7); the row 'all' is the grand total of a rollup."""
    score = F.col("sentiment_score")
    scored = on_days(articles, "published_at", first, last).filter(F.col("sentiment").isNotNull() & score.isNotNull())
    return (
        scored.rollup("sentiment")
        .agg(
            F.count("*").alias("cnt"), _settled_mean(F.avg(score)).alias("avg_score"),
            F.count_if(score >= high).alias("high"), F.count_if((score >= low) & (score < high)).alias("mid"),
            F.count_if(score < low).alias("low"),
        )
        .withColumn("low_rate", F.bround(F.col("low") / F.col("cnt"), 4))
        .withColumn("sentiment", F.coalesce("sentiment", F.lit("all")))
    )


def hot_articles(reactions: DataFrame, articles: DataFrame, n: int = 5) -> DataFrame:
    """The n articles with the most reactions."""
    sums = reaction_sums(reactions, ["article_id"]).withColumn("total", F.col("like_count") + F.col("dislike_count"))
    top = sums.orderBy(F.desc("total"), F.desc("like_count"), F.asc("article_id")).limit(n)
    return enrich(top, articles, ["title", "press"])


def daily_keyword_metrics(articles: DataFrame, day=None, pack: TextPack = KOREAN, is_array: bool = False) -> DataFrame:
    """Per day and keyword, the number of articles that hold the keyword (D10); without a day, all days."""
    live = enabled(articles).filter(F.col("published_at").isNotNull() & F.col("keywords").isNotNull())
    if day is not None:
        live = on_days(live, "published_at", day, day)
    words = live.select(day_of("published_at").alias("date"), F.explode(metric_words("keywords", pack, is_array)).alias("keyword"))
    return words.filter(is_metric_keyword("keyword", pack)).groupBy("date", "keyword").agg(F.count("*").alias("article_count"))


def reclean_metrics(metrics: DataFrame, pack: TextPack = KOREAN) -> DataFrame:
    """Clean stored keywords again and add up those that became equal."""
    cleaned = metrics.withColumn("keyword", metric_keyword("keyword", pack)).filter(F.col("keyword").isNotNull())
    return cleaned.groupBy("date", "keyword").agg(F.sum("article_count").alias("article_count"))


def removed_metrics(metrics: DataFrame, pack: TextPack = KOREAN) -> DataFrame:
    return metrics.filter(metric_keyword("keyword", pack).isNull())


def daily_top_issue(articles: DataFrame, first=None, last=None, tz_offset_hours: int = 0, pack: TextPack = KOREAN, is_array: bool = False) -> DataFrame:
    """The most mentioned keyword of each day and the sentiment of that day's articles whose keyword text holds it."""
    days = on_days(articles, "published_at", first, last, tz_offset_hours).select(
        day_of("published_at", tz_offset_hours).alias("date"), "sentiment",
        (F.array_join("keywords", ",") if is_array else F.col("keywords")).alias("keywords"),
    )
    words = days.select("date", F.explode(top_issue_words("keywords")).alias("keyword")).filter(is_top_issue_keyword("keyword", pack))
    mentions = words.groupBy("date", "keyword").agg(F.count("*").alias("n"))
    best = mentions.groupBy("date").agg(
        F.min_by("keyword", F.struct(-F.col("n"), F.col("keyword"))).alias("top_keyword"), F.max("n").alias("total_mentions")
    )
    held = days.filter(F.col("sentiment").isNotNull()).join(best.select("date", "top_keyword"), "date").filter(
        F.contains(F.lower("keywords"), F.lower("top_keyword"))
    )
    split = held.groupBy("date").agg(
        F.count_if(F.col("sentiment") == "positive").alias("p"), F.count_if(F.col("sentiment") == "negative").alias("g"),
        F.count("*").alias("t"),
    )
    ratio = lambda part: F.coalesce(part / F.nullif("t", F.lit(0)), F.lit(0.0))
    return best.join(split, "date", "left").select(
        "date", "top_keyword", "total_mentions",
        ratio(F.col("p")).alias("positive_ratio"), ratio(F.col("g")).alias("negative_ratio"),
        ratio(F.col("t") - F.col("p") - F.col("g")).alias("neutral_ratio"),
    )


def label_counts(column: str = "sentiment") -> list:
    """The three label counts as aggregate columns."""
    return [F.count_if(F.col(column) == label).alias(label) for label in ko.SENTIMENT_NAMES]


def sentiment_percent(counts: DataFrame, total: str | None = None) -> DataFrame:
    """Whole percentages that add up to 100: positive and neutral half-even, negative the rest.

    ``total`` names a column to divide by instead of the sum of the labels; then unlabelled rows fall to negative."""
    base = F.col(total) if total else F.col("positive") + F.col("neutral") + F.col("negative")
    out = counts.withColumn("positive_percent", half_even_percent("positive", base)).withColumn(
        "neutral_percent", half_even_percent("neutral", base)
    )
    return out.withColumn(
        "negative_percent",
        F.when(base > 0, 100 - F.col("positive_percent") - F.col("neutral_percent")).otherwise(0).cast("bigint"),
    )


def scope_sentiment(articles: DataFrame, min_articles: int = 3) -> DataFrame:
    """Label ratios and mean score per scope; below the minimum the score is 0 and the ratios stay NULL."""
    scored = articles.filter(F.col("scope_id").isNotNull() & F.col("sentiment").isNotNull() & F.col("sentiment_score").isNotNull())
    sums = scored.groupBy("scope_id").agg(F.count("*").alias("cnt"), F.avg("sentiment_score").alias("mean"), *label_counts())
    enough = F.col("cnt") >= min_articles
    return sums.select(
        "scope_id", F.col("cnt").alias("scored_count"),
        F.when(enough, _settled_mean(F.col("mean"))).otherwise(0.0).alias("sentiment_score"),
        *[F.when(enough, F.bround(F.col(label) / F.col("cnt"), 4)).alias(label) for label in ko.SENTIMENT_NAMES],
    )


def scope_keywords(articles: DataFrame, existing: DataFrame | None = None, n: int = 5, is_array: bool = False, existing_weight: int = 2) -> DataFrame:
    """The n most frequent article keywords per scope; keywords the scope already has may count more."""
    held = articles.filter(F.col("scope_id").isNotNull())
    words = held.filter(F.col("keywords").isNotNull()).select("scope_id", F.explode(keyword_list("keywords", is_array)).alias("keyword"), F.lit(1).cast("bigint").alias("weight"))
    if existing is not None:
        words = words.unionByName(existing.filter(F.col("scope_keywords").isNotNull()).select(
            "scope_id", F.explode(keyword_list("scope_keywords")).alias("keyword"), F.lit(existing_weight).cast("bigint").alias("weight")
        ))
    counts = words.groupBy("scope_id", "keyword").agg(F.sum("weight").alias("weight"))
    top = top_per(counts, ["scope_id"], [F.desc("weight"), F.asc("keyword")], n, "pos")
    joined = top.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("pos", "keyword")))["keyword"].alias("words"))
    return held.select("scope_id").distinct().join(joined, "scope_id", "left").select(
        "scope_id", F.coalesce(F.array_join("words", ","), F.lit("")).alias("scope_keywords"),
        F.when(F.col("words").isNull(), "insufficient").otherwise("ok").alias("scope_keywords_status"),
    )


def keyword_ranking(articles: DataFrame, contains: str = "", is_array: bool = False) -> DataFrame:
    """All keywords by frequency with their rank."""
    words = articles.filter(F.col("keywords").isNotNull()).select(F.explode(keyword_list("keywords", is_array)).alias("keyword"))
    counts = words.groupBy("keyword").agg(F.count("*").alias("frequency"))
    ranked = number_rows(counts, [F.desc("frequency"), F.asc("keyword")], "rank")
    return ranked.filter(F.contains("keyword", F.lit(contains))) if contains else ranked


def enrichment_status(articles: DataFrame, scopes: DataFrame) -> DataFrame:
    """How many articles and scopes still lack an output, and the label distribution (D19): one pass per table."""
    lack = lambda c: F.col(c).isNull()
    a = articles.agg(
        F.count_if(lack("embedding")).alias("no_embedding_news"), F.count_if(lack("scope_id")).alias("unclassified_news"),
        F.count_if(~lack("scope_id") & lack("sentiment")).alias("no_sentiment_news"),
        F.count_if(lack("summary")).alias("no_summary_news"), F.count_if(lack("keywords")).alias("no_keywords_news"),
        *[F.count_if(F.col("sentiment") == x).alias(f"{x}_news") for x in ko.SENTIMENT_NAMES],
    )
    s = scopes.agg(
        F.count("*").alias("total_scopes"), F.count_if(lack("scope_title")).alias("no_scope_title"),
        F.count_if(~lack("scope_title")).alias("has_scope_title"),
        F.count_if(lack("scope_keywords")).alias("no_scope_keywords"), F.count_if(lack("scope_summary")).alias("no_scope_summary"),
    )

    def long(df):
        pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        return df.select(F.expr(f"stack({len(df.columns)}, {pairs}) AS (measure, cnt)"))

    return long(a).unionByName(long(s))


def confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Joined label pairs and their counts."""
    return pred.join(truth, "article_id").groupBy("true_label", "pred_label").agg(F.count("*").alias("cnt"))


def class_report(counts: DataFrame, labels=("positive", "negative", "neutral")) -> DataFrame:
    """Precision, recall, F1 and support per label with macro and weighted means (D20), from the confusion counts."""
    counts = durable(counts)  # one row per label pair, read once per label below
    n = F.sum("cnt")
    per = None
    for label in labels:
        row = counts.agg(
            F.lit(label).alias("label"),
            F.coalesce(F.sum(F.when((F.col("true_label") == label) & (F.col("pred_label") == label), F.col("cnt"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(F.col("true_label") == label, F.col("cnt"))), F.lit(0)).alias("support"),
            F.coalesce(F.sum(F.when(F.col("pred_label") == label, F.col("cnt"))), F.lit(0)).alias("predicted"),
            F.coalesce(F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("cnt"))), F.lit(0)).alias("right"),
            n.alias("n"),
        )
        per = row if per is None else per.unionByName(row)
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    scored = per.withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    scored = scored.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rounded = [F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")]
    each = scored.select("label", *rounded, "support")
    macro = each.agg(F.lit("macro").alias("label"), *[F.bround(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = each.agg(
        F.lit("weighted").alias("label"),
        *[F.bround(safe(F.sum(F.col(c) * F.col("support")), F.sum("support")), 4).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    accuracy = scored.agg(F.bround(safe(F.max("right"), F.max("n")), 4).alias("a"), F.max("n").alias("n")).select(
        F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), F.col("n").alias("support")
    )
    return each.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def misclassified(pred: DataFrame, truth: DataFrame, n: int = 30) -> DataFrame:
    wrong = pred.join(truth, "article_id").filter(F.col("true_label") != F.col("pred_label"))
    return wrong.orderBy(F.desc("pred_score"), F.asc("article_id")).limit(n)


def daily_trend(views: DataFrame, users: DataFrame, last, first=None, min_days: int = 7) -> DataFrame:
    """Views and sign-ups per day, empty days as 0, over at least ``min_days`` (D21). The default start is the first sign-up."""
    end = F.lit(last).cast("date")
    start = F.lit(first).cast("date") if first is not None else F.coalesce(
        users.agg(F.to_date(F.min("created_at"))).scalar(), F.date_sub(end, min_days - 1))
    start = F.least(start, F.date_sub(end, min_days - 1))
    spark = views.sparkSession
    calendar = spark.range(1).select(start.alias("a"), end.alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    per = lambda df, name: df.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias(name))
    return (
        calendar.join(per(views, "views"), "day", "left").join(per(users, "signups"), "day", "left")
        .select("day", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("signups", F.lit(0)).alias("signups"))
    )


def usage_stats(logins: DataFrame, views: DataFrame, first=None, last=None) -> DataFrame:
    """Per day: distinct users, total and mean stay, valid views, stay as text."""
    stays = pair_sessions(on_days(logins, "created_at", first, last))
    days = stays.groupBy("day").agg(F.count_distinct("user_id").alias("daily_users"), F.sum("stay_seconds").alias("total_stay_seconds"))
    seen = (
        on_days(views, "created_at", first, last).filter(F.col("user_id").isNotNull() & F.col("is_valid_view"))
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("daily_article_views"))
    )
    mean = F.col("total_stay_seconds") / F.col("daily_users")
    return days.join(seen, "day", "full").select(
        "day", F.coalesce("daily_users", F.lit(0)).alias("daily_users"),
        F.coalesce("total_stay_seconds", F.lit(0)).alias("total_stay_seconds"),
        F.coalesce(F.bround(mean, 2), F.lit(0.0)).alias("avg_stay_seconds"),
        F.coalesce("daily_article_views", F.lit(0)).alias("daily_article_views"),
        stay_text(F.coalesce("total_stay_seconds", F.lit(0))).alias("total_stay_text"),
        stay_text(F.coalesce(mean, F.lit(0.0))).alias("avg_stay_text"),
    )


def centroid(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Unit vector of the summed vectors of each key (D28). Sums per position combine on the map side, so a key
    that holds much of the table costs one partial row per position and task."""
    cells = vectors.filter(F.col(key).isNotNull()).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    sums = cells.groupBy(key, "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    packed = sums.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("raw_sum"), F.max("n").alias("members"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"),
    )
    return packed.select(key, "members", "raw_sum", F.when(F.col("length") > 0, F.transform("raw_sum", lambda x: x / F.col("length"))).otherwise(F.col("raw_sum")).alias("centroid"))


def scope_stats(scopes: DataFrame, n: int = 20) -> DataFrame:
    """The largest scopes."""
    return scopes.orderBy(F.desc("news_count"), F.asc("scope_id")).limit(n)


def recount_scopes(articles: DataFrame) -> DataFrame:
    """Live articles per scope."""
    return enabled(articles).filter(F.col("scope_id").isNotNull()).groupBy("scope_id").agg(F.count("*").alias("news_count"))
