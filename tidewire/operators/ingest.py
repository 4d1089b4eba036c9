"""Ingest clean-up: reasons for rejecting rows, and the cleaned accepted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.text import article_tokens, clean_article
from tidewire.operators.filters import is_missing
from tidewire.operators.joins import anti_any_key
from tidewire.operators.similarity import first_come, text_signatures
from tidewire.session import durable

REQUIRED = ["collected_at", "title", "raw_text", "url", "press", "published_at"]


def dedup_ingest(raw: DataFrame, corpus: DataFrame, threshold: float = ko.NEAR_COPY_COSINE, required=tuple(REQUIRED)) -> DataFrame:
    """seq, raw_id and status of every raw row (I12): the first reason that applies among skipped_missing,
    skipped_duplicate_url, skipped_duplicate_meta, skipped_corpus_duplicate and skipped_similarity, else accepted.

    Reasons other than the first refer to rows accepted before this one; a rejected row never rejects another."""
    # the texts are not kept beside the table: they are read again where their words are wanted
    tagged = durable(raw.select("seq", "raw_id", "url", "title", "press", "article_id", is_missing(required).alias("_missing")))
    whole = tagged.filter(~F.col("_missing")).select(F.col("raw_id").alias("id"), "seq", "url", "title", "press", "article_id")
    fresh = durable(anti_any_key(whole, corpus).select("id", "seq"))
    keys = whole.join(fresh, "id", "left_semi").select("id", F.explode(F.array(
        F.concat(F.lit("u:"), "url"),
        F.concat(F.lit("m:"), F.sha2(F.concat_ws("\x1f", "title", "press"), 256)),
        F.concat(F.lit("a:"), F.nullif("article_id", F.lit(""))),
    )).alias("key")).filter(F.col("key").isNotNull())
    texts = raw.select(F.col("raw_id").alias("id"), "seq", F.col("raw_text").alias("text"))
    kept = first_come(fresh, keys, text_signatures(texts), threshold)
    accepted = whole.join(kept, "id", "left_semi").select("seq", "url", "title", "press", "article_id")

    def earliest(columns, name):
        return accepted.groupBy(*columns).agg(F.min("seq").alias(name))

    known = fresh.select("id", F.lit(True).alias("_fresh"))
    marked = (
        whole
        .join(earliest(["url"], "_u"), "url", "left")
        .join(earliest(["title", "press"], "_m"), ["title", "press"], "left")
        .join(earliest(["article_id"], "_a"), "article_id", "left")
        .join(known, "id", "left")
        .join(kept.select("id", F.lit(True).alias("_kept")), "id", "left")
    )
    status = (
        F.when(F.col("_kept"), "accepted")
        .when(F.col("_u") < F.col("seq"), "skipped_duplicate_url")
        .when(F.col("_m") < F.col("seq"), "skipped_duplicate_meta")
        .when(F.col("_fresh").isNull() | (F.col("_a") < F.col("seq")), "skipped_corpus_duplicate")
        .otherwise("skipped_similarity")
    )
    lost = tagged.filter("_missing").select("seq", "raw_id", F.lit("skipped_missing").alias("status"))
    return lost.unionByName(marked.select("seq", F.col("id").alias("raw_id"), status.alias("status")))


def accepted_articles(raw: DataFrame, statuses: DataFrame, pack: TextPack = KOREAN, tokenizer=None) -> DataFrame:
    """The accepted rows with clean text and tokens."""
    rows = raw.join(durable(statuses.filter(F.col("status") == "accepted").select("raw_id")), "raw_id", "left_semi")
    return retokenise(reclean(rows.withColumnRenamed("raw_text", "content"), pack), pack, tokenizer)


def reclean(articles: DataFrame, pack: TextPack = KOREAN) -> DataFrame:
    """Clean text of title and body again for the whole table."""
    return articles.withColumn("clean_text", clean_article(F.concat_ws(" ", "title", "content"), pack))


def retokenise(articles: DataFrame, pack: TextPack = KOREAN, tokenizer=None) -> DataFrame:
    """Tokens again for the whole table."""
    author = F.col("author") if "author" in articles.columns else None
    return articles.withColumn("tokens", article_tokens("clean_text", author, pack, tokenizer))
