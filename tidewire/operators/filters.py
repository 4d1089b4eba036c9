"""Row selection (section B): every function returns a DataFrame whose filter reaches the scan where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import code_name, sentiment_in
from tidewire.functions.text import as_col, phrase_text


def _time(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def window_bounds(mode: str, now) -> tuple[Column, Column]:
    """auto: the whole day before ``now``; manual: today up to ``now``."""
    now = _time(now)
    today = F.date_trunc("day", now)
    if mode == "auto":
        return today - F.expr("INTERVAL 1 DAY"), today
    if mode == "manual":
        return today, now
    raise ValueError(f"unknown window mode {mode!r}")


def in_window(df: DataFrame, ts: str, mode: str, now) -> DataFrame:
    """Published inside the collection window; a missing time is rejected (B1)."""
    low, high = window_bounds(mode, now)
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def is_missing(columns) -> Column:
    """Some required column is NULL, blank or the text 'nan'."""

    def empty(name):
        text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return (text == "") | (F.lower(text) == "nan")

    return reduce(lambda a, b: a | b, [empty(c) for c in columns])


def tag_missing(df: DataFrame, columns) -> DataFrame:
    """Adds status ``skipped_missing`` or ``ok`` in one pass over the rows (B2)."""
    return df.withColumn("status", F.when(is_missing(columns), "skipped_missing").otherwise("ok"))


def split_missing(df: DataFrame, columns) -> tuple[DataFrame, DataFrame]:
    return df.filter(~is_missing(columns)), df.filter(is_missing(columns))


def pending(df: DataFrame, have=(), lack=()) -> DataFrame:
    """Rows where the inputs exist and an output is still NULL."""
    tests = [F.col(c).isNotNull() for c in have] + [F.col(c).isNull() for c in lack]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def enabled(df: DataFrame, flag: str = "is_disabled") -> DataFrame:
    """Not switched off; a missing flag counts as on."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def on_days(df: DataFrame, ts: str, first=None, last=None, tz_offset_hours: int = 0) -> DataFrame:
    """Whole days from ``first`` to ``last`` inclusive, as a half-open range on the stored column so that it
    is pushed to the scan; a positive offset reads the day borders in a zone that far east (B5)."""
    shift = F.make_dt_interval(F.lit(0), F.lit(tz_offset_hours))
    if first is not None:
        df = df.filter(F.col(ts) >= F.lit(first).cast("timestamp") - shift)
    if last is not None:
        df = df.filter(F.col(ts) < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY") - shift)
    return df


def kw_contains(column, keyword: str, exact: bool = False) -> Column:
    """Case-insensitive substring of the joined keyword text; exact compares whole keywords."""
    text = F.lower(as_col(column))
    if exact:
        return F.array_contains(F.transform(F.split(text, ","), lambda k: F.trim(k)), keyword.lower().strip())
    return F.contains(text, F.lit(keyword.lower()))


def phrase(column, query: str) -> Column:
    """Consecutive words."""
    return F.contains(phrase_text(column), phrase_text(F.lit(query)))


def phrase_prefix(column, query: str) -> Column:
    """Consecutive words, the last one a prefix."""
    return F.contains(phrase_text(column), F.rtrim(phrase_text(F.lit(query))))


def any_word(column, query: str) -> Column:
    """Some word of the query occurs as a word."""
    words = F.split(F.trim(phrase_text(F.lit(query))), " ")
    return F.arrays_overlap(F.split(F.trim(phrase_text(column)), " "), words)


SEARCH_WEIGHTS = {"title": 3.0, "summary": 2.0, "keywords": 4.0, "content": 1.0}


def multi_match(df: DataFrame, query: str, weights: dict | None = None) -> DataFrame:
    """Any field holds a query word; the heaviest hit field is the score."""
    weights = weights or SEARCH_WEIGHTS
    scores = [F.when(any_word(F.coalesce(F.col(c), F.lit("")), query), w).otherwise(0.0) for c, w in weights.items()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return df.withColumn("score", best).filter(F.col("score") > 0)


def boosted_or(df: DataFrame, tests, name: str = "score") -> DataFrame:
    """At least one predicate holds; the score is the sum of the boosts that hold."""
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(p, F.lit(False)), float(b)).otherwise(0.0) for p, b in tests])
    hit = reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p, _ in tests])
    return df.filter(hit).withColumn(name, score)


def since_days(df: DataFrame, ts: str, days: int, now) -> DataFrame:
    """From midnight ``days`` before ``now`` on."""
    start = F.date_trunc("day", _time(now) - F.make_dt_interval(F.lit(days)))
    return df.filter(F.col(ts) >= start)


def with_sentiment(df: DataFrame, wanted: str, column: str = "sentiment") -> DataFrame:
    return df.filter(sentiment_in(column, wanted))


def has_rank1(column, category: str) -> Column:
    """The first-ranked element of a nested array has this category."""
    return F.exists(as_col(column), lambda p: (p["rank"] == 1) & (p["category"] == category))


def article_card(df: DataFrame) -> DataFrame:
    """What a result list shows: summary, or the start of the text where there is none."""
    return df.select(
        "article_id",
        F.coalesce(F.nullif("press", F.lit("")), F.lit("언론사 없음")).alias("press"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("제목 없음")).alias("title"),
        F.coalesce(F.nullif("summary", F.lit("")), F.substring("content", 1, 120)).alias("description"),
        F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
        F.date_format("published_at", "yyyy-MM-dd").alias("published_on"),
        F.coalesce("url", F.lit("#")).alias("url"),
    )


def review_filter(
    articles: DataFrame, mode: str = "low_confidence", threshold: float = 0.55, query: str | None = None,
    sentiment: str | None = None, first=None, last=None,
) -> DataFrame:
    """Labelled articles for human review (B16); order them with :func:`review_order`."""
    df = articles.filter(F.col("sentiment").isNotNull())
    if mode == "low_confidence":
        df = df.filter(F.col("sentiment_score") < threshold)
    elif mode == "search":
        if not query:
            raise ValueError("search mode needs a query")
        df = df.filter(any_word("title", query) | any_word("keywords", query))
    if sentiment:
        df = df.filter(F.col("sentiment") == sentiment)
    return on_days(df, "published_at", first, last)


def review_order(mode: str) -> list:
    return [F.asc("sentiment_score"), F.asc("article_id")] if mode == "low_confidence" else [
        F.desc("published_at"), F.asc("article_id")
    ]


def log_filter(df: DataFrame, ts: str, equals: dict | None = None, like: dict | None = None, first=None, last=None) -> DataFrame:
    """Only the conditions that were given."""
    for name, value in (equals or {}).items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    for name, value in (like or {}).items():
        if value not in (None, ""):
            df = df.filter(F.contains(F.lower(name), F.lit(str(value).lower())))
    return on_days(df, ts, first, last)


def active_on(banners: DataFrame, day, kind: str | None = None) -> DataFrame:
    """Active on the day, open ends allowed, pinned first, then newest."""
    day = F.lit(day).cast("date")
    df = banners.filter(
        F.col("is_active")
        & (F.coalesce(F.col("start_at").cast("date"), day) <= day)
        & (F.coalesce(F.col("end_at").cast("date"), day) >= day)
    )
    if kind:
        df = df.filter(F.col("banner_type") == kind)
    return df.orderBy(F.desc("is_pinned"), F.desc("created_at"), F.asc("banner_id"))


def user_search(users: DataFrame, text: str = "", role: str = "") -> DataFrame:
    """Text inside id or name, role in either spelling."""
    from tidewire.fixed.korean import ROLE_NAMES

    if text:
        users = users.filter(
            F.contains(F.col("user_id").cast("string"), F.lit(text)) | F.contains("name", F.lit(text))
        )
    if role:
        users = users.filter(F.col("role") == code_name(F.lit(role), ROLE_NAMES))
    return users


def is_incomplete(perspective: str = "perspective") -> Column:
    """An enrichment output is missing or no perspective element is complete."""
    outputs = ["sentiment", "sentiment_score", "keywords", "scope_id", "summary"]
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in outputs])
    complete = F.exists(
        F.col(perspective), lambda p: p["category"].isNotNull() & p["rank"].isNotNull() & p["score"].isNotNull()
    )
    return lacking | ~F.coalesce(complete, F.lit(False))


def incomplete(df: DataFrame, perspective: str = "perspective") -> DataFrame:
    return df.filter(is_incomplete(perspective))
