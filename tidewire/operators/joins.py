"""Lookups and joins (section C). Join strategy is left to adaptive execution; a broadcast is only hinted for
sides whose size is fixed (one row, k rows) or was counted first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.filters import enabled, kw_contains, log_filter, on_days, phrase, user_search
from tidewire.operators.ranking import top_per
from tidewire.session import durable


def reaction_sums(reactions: DataFrame, keys: list) -> DataFrame:
    return reactions.groupBy(*keys).agg(
        F.count_if(F.col("reaction_type") == "like").alias("like_count"),
        F.count_if(F.col("reaction_type") == "dislike").alias("dislike_count"),
    )


def user_overview(users: DataFrame, reactions: DataFrame, logins: DataFrame, text: str = "", role: str = "", n: int = 300) -> DataFrame:
    """The newest n users with their reaction sums and last successful login.

    The n users are picked first, so both facts are reduced to those users before they are grouped."""
    picked = user_search(users, text, role).orderBy(F.desc("created_at"), F.asc("user_id")).limit(n)
    ids = F.broadcast(picked.select("user_id"))  # n rows
    likes = reaction_sums(reactions.join(ids, "user_id", "left_semi"), ["user_id"])
    last = (
        logins.filter((F.col("event_type") == "login") & (F.col("result") == "success"))
        .join(ids, "user_id", "left_semi")
        .groupBy("user_id").agg(F.max("created_at").alias("last_login"))
    )
    return picked.join(likes, "user_id", "left").join(last, "user_id", "left").select(
        "user_id", "name", "role", "created_at",
        F.coalesce("like_count", F.lit(0)).alias("like_count"),
        F.coalesce("dislike_count", F.lit(0)).alias("dislike_count"), "last_login",
    )


def process_errors(process: DataFrame, errors: DataFrame, n: int = 100, status: str = "", first=None, last=None) -> DataFrame:
    """The newest n process-log rows with their error rows (C2); the cut precedes the join."""
    newest = log_filter(process, "occurred_at", {"status": status}, first=first, last=last).orderBy(
        F.desc("occurred_at"), F.desc("history_id")
    ).limit(n)
    return newest.join(errors, "history_id", "left")


def anti_any_key(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows that share no article id, url or (title, press) with the corpus (C3). NULL and empty keys match nothing."""
    out = rows
    for keys in (["article_id"], ["url"], ["title", "press"]):
        # only what the rows ask for is taken from the corpus, so a small batch travels to it and not the other way
        known = corpus.select(*keys).filter(F.coalesce(F.col(keys[0]), F.lit("")) != "").join(rows.select(*keys), keys, "left_semi")
        out = out.join(known, keys, "left_anti")
    return out.select(*rows.columns)


def enrich(rows: DataFrame, articles: DataFrame, columns: list, missing: str = "drop") -> DataFrame:
    """Add article columns by id (C4); ids without an article are dropped or kept with NULLs."""
    return rows.join(articles.select("article_id", *columns), "article_id", "inner" if missing == "drop" else "left")


def press_reaction(views: DataFrame, reactions: DataFrame, articles: DataFrame, first=None, last=None) -> DataFrame:
    """Views and likes per press (C5, D9): both facts are added up per article before they meet the articles."""
    seen = on_days(views, "created_at", first, last).select("article_id", F.lit(1).alias("v"), F.lit(0).alias("k"))
    liked = on_days(reactions.filter(F.col("reaction_type") == "like"), "created_at", first, last).select(
        "article_id", F.lit(0).alias("v"), F.lit(1).alias("k")
    )
    per_article = seen.unionByName(liked).groupBy("article_id").agg(F.sum("v").alias("views"), F.sum("k").alias("likes"))
    return (
        per_article.join(articles.select("article_id", "press"), "article_id")
        .groupBy(F.coalesce(F.nullif("press", F.lit("")), F.lit("언론사 없음")).alias("press"))
        .agg(F.sum("views").alias("views"), F.sum("likes").alias("likes"))
    )


def orphan_scopes(scopes: DataFrame, articles: DataFrame) -> DataFrame:
    """Scopes without a live article."""
    return scopes.join(enabled(articles).select("scope_id"), "scope_id", "left_anti")


def titleless_live(scopes: DataFrame, articles: DataFrame) -> DataFrame:
    """Scopes without a title that do have articles."""
    return scopes.filter(F.coalesce("scope_title", F.lit("")) == "").join(articles.select("scope_id"), "scope_id", "left_semi")


def exclude_trained(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Without ids already used for training."""
    used = corrections.filter(F.col("used_in_finetune") == 1).select("article_id")
    return df.join(used, "article_id", "left_anti")


def latest_correction(log: DataFrame) -> DataFrame:
    """The correction with the largest id per article (C9), as one max-by aggregation."""
    row = F.max_by(F.struct("id", "corrected_sentiment", "used_in_finetune"), "id").alias("_row")
    return log.groupBy("article_id").agg(row).select("article_id", "_row.*")


#: Bytes of lexicon words that one pass over the texts looks for.
LEXICON_PART = 16 << 20
_automata: dict = {}


def _automaton(name: str, lexicon: pa.Table):
    """The automaton of a named lexicon part, built once per Python worker: each distinct word with its rows."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        rows: dict[str, list[int]] = {}
        for i, word in enumerate(lexicon.column("keyword").to_pylist()):
            rows.setdefault(word, []).append(i)
        made = ahocorasick.Automaton()
        for word, lines in rows.items():
            made.add_word(word, (len(word), lines))
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def _found_words(name: str, part):
    """Rows (key, lexicon row, hits) of a batch of texts, each text read once from left to right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = part.value
        if not lexicon.num_rows:
            return
        automaton = _automaton(name, lexicon)
        for batch in batches:
            texts, lines, hits = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found: dict[int, list] = {}  # by a word's first row: hits, end of the last one, rows
                for last, (size, rows) in automaton.iter(text or ""):
                    seen = found.setdefault(rows[0], [0, 0, rows])
                    if last - size + 1 >= seen[1]:
                        seen[0] += 1
                        seen[1] = last + 1
                for n, _, rows in found.values():
                    texts += [i] * len(rows)
                    lines += rows
                    hits += [n] * len(rows)
            chosen = lexicon.take(pa.array(lines, pa.int64())).combine_chunks()
            columns = [batch.column(0).take(pa.array(texts, pa.int64())), *[chosen.column(c).combine_chunks() for c in range(3)], pa.array(hits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "keyword", "sentiment", "weight", "hits"])

    return run


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", part_bytes: int = LEXICON_PART) -> DataFrame:
    """Every lexicon row whose word occurs in a text, with the word's non-overlapping count (C14). ``key`` names a text.

    The words stand in one automaton that reads each text once, inside the task that has read it: texts are neither
    shuffled nor taken apart. A lexicon above ``part_bytes`` is cut by hash into parts of about that size, and each part
    is a pass of its own; so what reaches the driver and every worker at once is bounded, whatever the lexicon's size.
    Null texts have no hits, words that are null or empty are never found, equal words of several rows give a row each.
    """
    words = lexicon.filter(F.coalesce("keyword", F.lit("")) != "").select("keyword", "sentiment", "weight")
    spark = docs.sparkSession
    size = words.agg(F.sum(F.octet_length("keyword") + 64)).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    if parts > 1:
        words = durable(words)
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    schema = f"`{key}` {texts.schema[0].dataType.simpleString()}, keyword string, sentiment {kinds['sentiment']}, weight {kinds['weight']}, hits bigint"
    out = None
    for p in range(parts):
        mine = words if parts == 1 else words.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == p)
        found = texts.mapInArrow(_found_words(uuid.uuid4().hex, spark.sparkContext.broadcast(mine.toArrow())), schema)
        out = found if out is None else out.unionByName(found)
    return out


def related(articles: DataFrame) -> DataFrame:
    """Per article: the newest other article of its scope with the same sentiment and the newest with another one.

    No pairs are formed: per scope and sentiment the two newest articles are enough, whoever asks."""
    live = enabled(articles).filter(F.col("scope_id").isNotNull())
    slim = live.select("scope_id", "article_id", "published_at", F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"))
    order = [F.desc("published_at"), F.asc("article_id")]
    newest = top_per(slim, ["scope_id", "sentiment"], order, 2)
    place = F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("pos"), "article_id", "sentiment")
    packed = newest.groupBy("scope_id").agg(F.array_sort(F.collect_list(place)).alias("_newest"))  # two per sentiment
    base = articles.filter(F.col("scope_id").isNotNull()).select(
        "article_id", "scope_id", F.coalesce("sentiment", F.lit("neutral")).alias("sentiment")
    )
    others = F.filter("_newest", lambda x: x["article_id"] != F.col("article_id"))
    wide = base.join(packed, "scope_id").withColumn("_others", others)
    same = F.get(F.filter("_others", lambda x: x["sentiment"] == F.col("sentiment")), 0)
    different = F.get(F.filter("_others", lambda x: x["sentiment"] != F.col("sentiment")), 0)
    return wide.select("article_id", same["article_id"].alias("same_id"), different["article_id"].alias("different_id"))


def viewpoint_select(master: DataFrame, counts: DataFrame, wanted: str = "") -> DataFrame:
    """The master row for a wanted viewpoint: by display title, else category, else the most counted one, else the
    first (C16). One candidate order, one row kept."""
    joined = master.join(counts.select(F.col("category").alias("es_category"), "cnt"), "es_category", "left").withColumn(
        "cnt", F.coalesce("cnt", F.lit(0)))
    choice = (
        F.when(F.col("display_title") == wanted, 1).when(F.col("es_category") == wanted, 2)
        .when(F.col("cnt") > 0, 3).otherwise(4)
    )
    by_count = F.when(choice == 3, -F.col("cnt")).otherwise(0)
    return joined.orderBy(choice, by_count, F.asc("sort_order"), F.asc("es_category")).limit(1)


def user_history(log: DataFrame, articles: DataFrame, user, page: int, size: int, valid_only: bool = False, kind: str | None = None) -> DataFrame:
    """One page of a user's history; missing or disabled articles leave after paging, so a page may be short (C17)."""
    mine = log.filter(F.col("user_id") == user)
    if valid_only:
        mine = mine.filter("is_valid_view")
    if kind:
        mine = mine.filter(F.col("reaction_type") == kind)
    paged = mine.orderBy(F.desc("created_at"), F.asc("article_id")).offset((page - 1) * size).limit(size)
    details = articles.select("article_id", "title", "press", "is_disabled")
    return (
        paged.select("article_id", "created_at").join(details, "article_id", "left")
        .filter(F.col("title").isNotNull() & ~F.coalesce("is_disabled", F.lit(False)))
        .drop("is_disabled")
    )


def scope_search(scopes: DataFrame, keyword: str, n: int = 5, min_articles: int = 5, by: str = "score") -> DataFrame:
    """Scopes whose keywords hold the text, best phrase score first (C18); by="date" orders by recency."""
    score = F.when(phrase(F.coalesce("scope_title", F.lit("")), keyword), 6.0).otherwise(0.0) + F.when(
        phrase(F.coalesce("scope_summary", F.lit("")), keyword), 3.0
    ).otherwise(0.0)
    found = scopes.filter(kw_contains("scope_keywords", keyword) & (F.col("news_count") >= min_articles)).withColumn("score", score)
    recency = [F.desc("updated_at"), F.desc("news_count"), F.asc("scope_id")]
    order = [F.desc("score"), *recency] if by == "score" else recency
    return found.orderBy(*order).limit(n)

