"""Corpus keywords and issue titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.keywords import is_valid_keyword, word_role
from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.text import clean_scope_title, clean_token, words_of
from tidewire.operators.ranking import top_per
from tidewire.session import durable


def tfidf_keywords(docs: DataFrame, k: int = 5, vocabulary: int | None = None, boost: float = ko.TITLE_BOOST, pack: TextPack = KOREAN,
                   extra_stopwords: DataFrame | None = None) -> DataFrame:
    """The k best keywords per document (I1), from columns doc_id, tokens and title_nouns.

    Weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over all terms or the most frequent ``vocabulary`` of them, unit
    length per document; a title noun that is among the tokens gets ``boost`` on top. Terms are lower-case, the title comparison
    is not. All steps are aggregations and joins; invalid terms leave before the k best are taken.
    """
    # cleaned before the explode, so that the tests below read a column and do not repeat the cleaning; there is nothing to
    # remove from tokens of letters only, which is seen at once for all tokens of a document
    letters = f"^[{pack.script}a-zA-Z]+$"
    cleaned = F.when(F.array_join("tokens", "").rlike(letters), F.col("tokens")).otherwise(
        F.transform("tokens", lambda t: F.when(t.rlike(letters), t).otherwise(clean_token(t, pack))))
    # the title nouns among the tokens follow them, so that no row carries the nouns of its document
    listed = docs.select("doc_id", cleaned.alias("tokens"), "title_nouns").select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.posexplode(F.concat("tokens", F.coalesce(F.array_intersect("title_nouns", "tokens"), F.array().cast("array<string>")))).alias("pos", "token"))
    raw = listed.select("doc_id", "token", (F.col("pos") >= F.col("n_tokens")).alias("title"))
    valid = raw.filter(F.col("token").isNotNull() & (F.col("token").rlike("^[a-zA-Z]+$") | F.col("token").rlike(letters)) & is_valid_keyword("token", pack))
    if extra_stopwords is not None:
        valid = valid.join(extra_stopwords.select(F.col("word").alias("token")), "token", "left_anti").join(
            extra_stopwords.select(F.lower("word").alias("_low")), F.lower("token") == F.col("_low"), "left_anti")
    tagged = valid.select("doc_id", F.lower("token").alias("term"), "title", (F.col("title") & (F.col("token") == F.lower("token"))).alias("in_title"))
    # three readers share the counts; cleaning and shuffling the tokens happens once
    tf = durable(tagged.groupBy("doc_id", "term").agg(F.count_if(~F.col("title")).alias("tf"), F.max("in_title").alias("in_title")))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    best = (stats.orderBy(F.desc("total"), F.asc("term")).limit(vocabulary) if vocabulary else stats).select("term", "df", is_valid_keyword("term", pack).alias("fit"))
    n = tf.agg(F.count_distinct("doc_id")).scalar()
    weights = tf.join(best, "term").select(
        "doc_id", "term", "in_title", "fit", ((1 + F.ln("tf")) * (F.ln((1 + n) / (1 + F.col("df"))) + 1)).alias("w")
    )
    terms = F.collect_list(F.when(F.col("fit"), F.struct("term", "in_title", "w"))).alias("terms")
    per_doc = weights.groupBy("doc_id").agg(terms, F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scored = F.transform(
        "terms",
        lambda t: F.struct(
            (-(t["w"] / F.col("length") + F.when(t["in_title"], F.lit(boost)).otherwise(0.0))).alias("minus"), t["term"].alias("term")
        ),
    )
    top = per_doc.select("doc_id", F.posexplode(F.slice(F.sort_array(scored), 1, k)).alias("pos", "x"))
    return top.select(
        "doc_id", F.col("x.term").alias("keyword"), (F.col("pos") + 1).alias("rank"), (-F.col("x.minus")).alias("score")
    )


def keyword_text(ranked: DataFrame) -> DataFrame:
    """The ranked keywords of a document as one comma text."""
    words = F.array_sort(F.collect_list(F.struct("rank", "keyword")))["keyword"]
    return ranked.groupBy("doc_id").agg(F.array_join(words, ",").alias("keywords"))


def title_nouns(title, pack: TextPack = KOREAN):
    """Default noun finder: words of two or more characters outside the noun stopwords."""
    return F.filter(
        words_of(F.regexp_replace(title, r"(?U)[^\w]+", " ")), lambda w: (F.length(w) >= 2) & ~w.isin(*pack.noun_stopwords)
    )


def scope_titles(articles: DataFrame, newest: int | None = None, words: int = 5, max_length: int = 50, pack: TextPack = KOREAN, nouns=None) -> DataFrame:
    """A title per scope from its article titles, all or the ``newest`` (I5): tf * (ln((n + 1) / (df + 1)) + 1) inside the scope, the
    five best words in the order of their roles, cut at a word border; without nouns, the first words of three titles."""
    nouns = nouns or (lambda title: title_nouns(title, pack))
    held = articles.filter(F.col("scope_id").isNotNull() & (F.coalesce("title", F.lit("")) != ""))
    order = [F.desc("published_at"), F.asc("article_id")]
    recent = held.select("scope_id", "article_id", "title", "published_at")
    recent = top_per(recent, ["scope_id"], order, newest) if newest else recent
    titles = recent.withColumn("title", clean_scope_title("title", pack)).filter(F.col("title") != "")
    sizes = titles.groupBy("scope_id").agg(
        F.count("*").alias("n"),
    )
    # the fallback needs the three newest titles only
    firsts = top_per(titles, ["scope_id"], order, 3, "pos").groupBy("scope_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.get(words_of("title"), 0).alias("word")))).alias("firsts"))
    fallback = F.nullif(F.array_join(F.array_distinct(F.col("firsts")["word"]), " "), F.lit(""))
    tokens = titles.select("scope_id", "article_id", F.explode(nouns(F.col("title"))).alias("word"))
    tf = tokens.groupBy("scope_id", "word", "article_id").agg(F.count("*").alias("c")).groupBy("scope_id", "word").agg(
        F.sum("c").alias("tf"), F.count("*").alias("df"))
    score = F.col("tf") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    scored = tf.join(sizes.select("scope_id", "n"), "scope_id").withColumn("score", score)
    best = top_per(scored, ["scope_id"], [F.desc("score"), F.asc("word")], words, "rank")
    ordered = best.groupBy("scope_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(word_role("word", pack).alias("role"), "rank", "word")))["word"], " ").alias("title"))
    # a cut in the middle of a word falls back to the last full word
    head = F.substring("title", 1, max_length)
    cut = F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), head)
    title = F.when(F.length("title") > max_length, cut).otherwise(F.col("title"))
    return sizes.join(firsts, "scope_id").join(ordered, "scope_id", "left").select(
        "scope_id", F.coalesce(title, fallback, F.lit(ko.DEFAULT_SCOPE_TITLE)).alias("scope_title")
    )
