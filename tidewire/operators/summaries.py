"""Extractive summaries of articles and scopes."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.fixed import korean as ko
from tidewire.functions import text as tx
from tidewire.functions.keywords import keyword_list
from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.vectors import cosine
from tidewire.operators.ranking import number_rows, top_per
from tidewire.operators.similarity import first_come
from tidewire.session import durable


@lru_cache(maxsize=1 << 16)
def word_grams(word: str, low: int = 2, high: int = 3) -> tuple[str, ...]:
    """Character n-grams of a word between spaces; words come again and again, so a task keeps those of the latest."""
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in range(low, high + 1) for i in range(max(1, len(padded) - n + 1)))


def gram_counts(sentence: str, low: int = 2, high: int = 3) -> Counter:
    """Character n-grams inside the space-padded words of a sentence."""
    return Counter(chain.from_iterable(word_grams(word, low, high) for word in sentence.lower().split()))


class Grams:
    """Unit rows of smooth tf-idf over character n-grams inside space-padded words, held as (row, gram, weight) entries."""

    def __init__(self, sentences, low: int = 2, high: int = 3):
        place: dict = {}
        split = [[place.setdefault(w, len(place)) for w in sentence.lower().split()] for sentence in sentences]
        self.n = len(split)
        # the grams of each distinct word, numbered in their order
        grams = [word_grams(w, low, high) for w in place]
        number = {g: i for i, g in enumerate(sorted({g for own in grams for g in own}))}
        self.width = len(number)
        size = np.array([len(own) for own in grams], dtype=np.int64)
        ids = np.array([number[g] for own in grams for g in own], dtype=np.int64)
        # every word of every sentence, spread out into its grams
        word = np.array([w for own in split for w in own], dtype=np.int64)
        line = np.repeat(np.arange(self.n), [len(own) for own in split])
        many = size[word]
        spot = np.arange(many.sum()) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(many) - many), many)
        cell, times = np.unique(np.repeat(line, many) * max(self.width, 1) + ids[spot], return_counts=True)
        self.row, self.column, weight = cell // max(self.width, 1), cell % max(self.width, 1), times.astype(float)
        held = np.bincount(self.column, minlength=self.width)
        weight *= (np.log((1 + self.n) / (1 + held)) + 1)[self.column]
        length = np.sqrt(np.bincount(self.row, weight * weight, minlength=self.n))
        self.weight = weight / np.where(length == 0, 1, length)[self.row]
        self.start = np.searchsorted(self.row, np.arange(self.n + 1))

    def mixed(self, x: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its x, as a dense vector over the grams."""
        return np.bincount(self.column, self.weight * x[self.row], minlength=self.width)

    def against(self, v: np.ndarray) -> np.ndarray:
        """The product of every row with a dense vector."""
        return np.bincount(self.row, self.weight * v[self.column], minlength=self.n)

    def dense(self, i: int) -> np.ndarray:
        part = slice(self.start[i], self.start[i + 1])
        return np.bincount(self.column[part], self.weight[part], minlength=self.width)


def central_sentence(sentences, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-5, best: int = 3) -> int:
    """Of the sentences ranked highest by their similarity graph, the one closest to the first sentence.

    The graph is never formed: its row sums and its steps are products with the rows, less each sentence with itself."""
    m = Grams(sentences)
    if not m.width:
        return 0
    own = np.bincount(m.row, m.weight * m.weight, minlength=m.n)
    step = lambda x: m.against(m.mixed(x)) - own * x
    out = step(np.ones(m.n))
    out = np.where(np.abs(out) < 1e-12, 0, out)
    rank = np.full(m.n, 1 / m.n)
    for _ in range(rounds):
        previous, rank = rank, (1 - damping) / m.n + damping * step(np.where(out == 0, 0, rank / np.where(out == 0, 1, out)))
        if np.abs(rank - previous).sum() < tolerance:
            break
    leading = np.argsort(np.round(rank, 12), kind="stable")[-best:]
    return int(leading[np.argmax(m.against(m.dense(0))[leading])])


@F.pandas_udf(T.IntegerType())
def central_index(sentences: pd.Series) -> pd.Series:
    return pd.Series([central_sentence(list(s)) for s in sentences], dtype="int32")


def textrank_summary(docs: DataFrame, limit: int = 70, pack: TextPack = KOREAN) -> DataFrame:
    """doc_id and a one-sentence summary of the whole text (I2). Documents are independent of each other, so the
    sentence graph of one text is all that a task holds at a time."""
    body = tx.strip(F.regexp_replace(F.regexp_replace("text", r"\[[^\]]{1,30}\]", ""), tx.wide(r"\s{2,}"), " "))
    parted = docs.select("doc_id", body.alias("body")).withColumn("sentences", tx.split_sentences("body", 15, pack))
    enough = F.size("sentences") >= 2
    # rows without a choice send an empty list to the Python worker
    several = F.when(enough, F.col("sentences")).otherwise(F.array(F.lit("")))
    picked = parted.withColumn("_at", central_index(several))
    chosen = F.when(enough, F.get("sentences", F.col("_at"))).otherwise(F.col("body"))
    return picked.select(
        "doc_id",
        F.when(F.coalesce(F.trim("body"), F.lit("")) == "", F.lit(ko.POOR_SUMMARY)).otherwise(tx.natural_trim(chosen, limit, pack)).alias("summary"),
    )


def drop_similar(threshold: float):
    """Grouped function: sentences in order, without those too similar to an earlier kept one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "spos"]).reset_index(drop=True)
        m = Grams(pdf["sentence"])
        if not m.width:
            return pdf
        dropped = np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            if not dropped[i]:
                dropped[i + 1 :] |= m.against(m.dense(i))[i + 1 :] >= threshold
        return pdf[~dropped]

    return run


@F.pandas_udf(T.ArrayType(T.StringType()))
def gram_list(sentences: pd.Series) -> pd.Series:
    return sentences.map(lambda s: sorted(gram_counts(s).elements()))


def distinct_sentences(sentences: DataFrame, threshold: float = ko.SENTENCE_COPY_COSINE, group_rows: int = 2_000) -> DataFrame:
    """What ``drop_similar`` keeps of every scope (I3). A scope of at most ``group_rows`` sentences is compared in one
    step; a larger one gives the same by shared rare grams, without being held in one task."""
    sentences = durable(sentences)
    sizes = sentences.groupBy("scope_id").agg(F.count("*").alias("n"))
    large = durable(sizes.filter(F.col("n") > group_rows).select("scope_id"))
    few = sentences.join(large, "scope_id", "left_anti").select(*sentences.columns).groupBy("scope_id").applyInPandas(drop_similar(threshold), sentences.schema)
    if large.isEmpty():
        return few
    return few.unionByName(_distinct_of_large(sentences.join(large, "scope_id", "left_semi"), threshold))


def _distinct_of_large(sentences: DataFrame, threshold: float) -> DataFrame:
    """Sentences that a pass in order keeps, over the cluster.

    Input: scope_id, pos, spos, sentence and others; pos is unique over all scopes. Weights are fitted per scope over all
    of its sentences. Grams carry their scope, so only sentences of one scope meet."""
    order = F.col("pos").cast("bigint") * F.lit(2**31) + F.col("spos")
    rows = durable(sentences.withColumn("id", order).withColumn("words", gram_list("sentence")))
    mark = F.lit("\x1f")  # white space, so no gram holds it
    signed = durable(rows.select("id", F.col("id").alias("seq"), "scope_id", F.sha2(F.concat("scope_id", mark, F.array_join("words", "\x1f")), 256).alias("sig"), "words"))
    held = signed.filter(F.size("words") > 0).groupBy("sig").agg(F.any_value("scope_id").alias("scope_id"), F.any_value("words").alias("words"), F.count("*").alias("times"))
    tf = held.select("sig", "scope_id", "times", F.explode("words").alias("term")).groupBy("sig", "scope_id", "times", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("scope_id", "term").agg(F.sum("times").alias("df"))
    sizes = signed.groupBy("scope_id").agg(F.count("*").alias("n"))
    weight = F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    vectors = tf.join(df, ["scope_id", "term"]).join(sizes, "scope_id").select("sig", F.concat("scope_id", mark, "term").alias("term"), "df", weight.alias("raw"))
    own = signed.select("id", F.concat(F.lit("i:"), F.col("id").cast("string")).alias("key"))
    # a sentence without grams is like no other
    alike = F.when(F.size("words") > 0, F.col("sig")).otherwise(F.col("id").cast("string")).alias("sig")
    kept = first_come(signed, own, signed.select("id", "seq", alike, "words"), threshold, vectors=vectors)
    return rows.join(kept, "id", "left_semi").drop("id", "words")


def scope_sentences(articles: DataFrame, newest: int | None = None, per_press: int | None = None, pack: TextPack = KOREAN, min_ratio: float = 0.4) -> DataFrame:
    """Sentences of each scope's articles with a validity mark; ``newest`` and ``per_press`` narrow them to the newest
    articles and to few per press. ``pos`` numbers the articles, newest first within their scope."""
    usable = articles.filter(F.col("scope_id").isNotNull() & F.col("content").isNotNull() & F.col("embedding").isNotNull())
    slim = usable.select("scope_id", "article_id", "published_at", F.coalesce(F.nullif("press", F.lit("")), F.lit("unknown")).alias("press"))
    order = [F.desc("published_at"), F.asc("article_id")]
    # only ids travel through the cuts and the numbering; the texts join the survivors
    cut = top_per(slim, ["scope_id"], order, newest) if newest else slim
    cut = top_per(cut, ["scope_id", "press"], order, per_press) if per_press else cut
    cut = number_rows(cut, [F.asc("scope_id"), *order], "pos")
    texts = cut.select("scope_id", "article_id", "pos").join(usable.select("article_id", "content"), "article_id")
    cleaned = texts.withColumn("body", tx.clean_body("content", pack)).drop("content")
    # posexplode keeps one row for a text without sentences, so its body can serve as the fallback
    return cleaned.select("scope_id", "article_id", "pos", "body", F.posexplode_outer(tx.split_sentences("body", 15)).alias("spos", "sentence")).withColumn(
        "body", F.when(F.coalesce("spos", F.lit(0)) == 0, F.col("body"))
    ).withColumn("valid", F.coalesce(tx.is_valid_sentence("sentence", pack, 20, min_ratio), F.lit(False)))


def scope_summaries(articles: DataFrame, scopes: DataFrame, limit: int = 100, copy_threshold: float = ko.SENTENCE_COPY_COSINE,
                    pack: TextPack = KOREAN, min_ratio: float = 0.4, newest: int | None = None, per_press: int | None = None) -> DataFrame:
    """One sentence per scope (I4): closeness to the mean article vector plus economy and fact scores, minus penalties
    for keyword overlap, quotes, captions and notices. A scope whose sentences are all unfit gets no summary.
    ``newest`` and ``per_press`` as in ``scope_sentences``."""
    sentences = durable(scope_sentences(articles, newest, per_press, pack, min_ratio))
    valid = sentences.filter("valid").select("scope_id", "article_id", "pos", "spos", "sentence")
    kept = durable(distinct_sentences(valid, copy_threshold))
    vectors = articles.select("article_id", F.col("embedding").cast("array<double>").alias("vec"))
    weights = kept.groupBy("scope_id", "article_id").agg(F.count("*").alias("c")).join(vectors, "article_id")
    cells = weights.select("scope_id", "c", F.posexplode("vec").alias("p", "x")).groupBy("scope_id", "p").agg(F.sum(F.col("c") * F.col("x")).alias("x"))
    centers = cells.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("p", "x")))["x"].alias("center"))
    close = weights.join(centers, "scope_id").select("scope_id", "article_id", F.coalesce(cosine("vec", "center"), F.lit(0.0)).alias("closeness"))
    words = scopes.select("scope_id", keyword_list("scope_keywords").alias("words"))
    penalty = sum((F.when(test, -0.5).otherwise(0.0) for test in (tx.is_quote("sentence", pack), tx.is_caption("sentence", pack), tx.is_meta("sentence", pack))), F.lit(0.0))
    score = (
        F.col("closeness") + tx.economy_score("sentence", pack) + tx.fact_score("sentence", pack)
        + tx.keyword_overlap_penalty("sentence", "words") + penalty
    )
    scored = kept.join(close, ["scope_id", "article_id"]).join(words, "scope_id", "left").select("scope_id", "pos", "spos", "sentence", score.alias("score"))
    best = scored.groupBy("scope_id").agg(
        F.min_by("sentence", F.struct(-F.round("score", 9), F.col("pos"), F.col("spos"))).alias("sentence"))
    plain = sentences.groupBy("scope_id").agg(
        F.count("sentence").alias("n"), F.min_by("body", F.struct("pos", F.coalesce("spos", F.lit(0)))).alias("body"))
    text = F.coalesce("sentence", F.when(F.col("n") == 0, F.col("body")))
    return plain.join(best, "scope_id", "left").select("scope_id", tx.natural_trim(text, limit, pack).alias("scope_summary")).filter(
        F.col("scope_summary").isNotNull())
