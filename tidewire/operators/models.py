"""Sentiment scores, embeddings, training sets and the binary viewpoint model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, HashingTF, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import binary_label
from tidewire.functions.sentiment import boosted, gap_label
from tidewire.functions.text import model_text
from tidewire.operators.joins import lexicon_hits
from tidewire.operators.ranking import keep_first, top_per
from tidewire.session import durable


def score_sentiment(docs: DataFrame, probabilities: DataFrame, lexicon: DataFrame, body_limit: int | None = None) -> DataFrame:
    """Label and score per document from given class probabilities and a lexicon (I8).

    ``docs``: doc_id, title, content; ``probabilities``: doc_id, positive, negative; ``lexicon``: keyword, sentiment,
    weight. ``body_limit`` cuts the body to the input size of the model that gave the probabilities.
    A document without probabilities gets neutral and 0.0.
    """
    body = F.coalesce("content", F.lit(""))
    body = F.substring(body, 1, body_limit) if body_limit else body
    texts = docs.select("doc_id", F.concat(F.coalesce("title", F.lit("")), body).alias("text"))
    hits = lexicon_hits(texts, lexicon)
    ordered = F.array_sort(F.collect_list(F.struct("keyword", "sentiment", "weight")))  # at most the lexicon per text
    packed = hits.groupBy("doc_id").agg(ordered.alias("hits"))
    joined = docs.select("doc_id").join(probabilities, "doc_id", "left").join(packed, "doc_id", "left")
    of = lambda s: F.transform(F.filter("hits", lambda h: h["sentiment"] == s), lambda h: h["weight"].cast("double"))
    p, n = boosted("positive", of("positive")), boosted("negative", of("negative"))
    summed = joined.select("doc_id", F.col("positive").isNotNull().alias("known"), p.alias("p"), n.alias("n"))
    total = F.col("p") + F.col("n")
    label = gap_label(F.when(total > 0, F.col("p") / total).otherwise(F.col("p")), F.when(total > 0, F.col("n") / total).otherwise(F.col("n")))
    return summed.withColumn("_s", label).select(
        "doc_id", F.when(F.col("known"), F.col("_s.label")).otherwise("neutral").alias("sentiment"),
        F.when(F.col("known"), F.col("_s.score")).otherwise(0.0).alias("sentiment_score"))


def embed(articles: DataFrame, encoder=None, dimension: int = 768) -> DataFrame:
    """article_id, unit embedding and has_embedding (I9). ``encoder`` turns an iterator of pandas frames
    (article_id, text) into frames (article_id, embedding) and runs in the executors; the default hashes words."""
    text = F.coalesce(F.nullif(F.trim("clean_text"), F.lit("")), F.nullif(F.trim("title"), F.lit("")))
    texts = articles.select("article_id", text.alias("text")).filter(F.col("text").isNotNull())
    if encoder is not None:
        raw = texts.mapInPandas(encoder, "article_id string, embedding array<float>")
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = raw.withColumn("_l", length).filter(F.col("_l") > 0).select(
            "article_id", F.transform("embedding", lambda x: (x / F.col("_l")).cast("float")).alias("embedding"))
    else:
        words = texts.withColumn("words", F.filter(F.split(F.lower("text"), r"(?U)[^\w]+"), lambda w: w != ""))
        stages = [HashingTF(numFeatures=dimension, inputCol="words", outputCol="tf"), Normalizer(inputCol="tf", outputCol="unit")]
        for stage in stages:
            words = stage.transform(words)
        unit = words.filter(F.size("words") > 0).select("article_id", vector_to_array("unit", "float32").alias("embedding"))
    return unit.withColumn("has_embedding", F.lit(True))


def finetune_set(corrections: DataFrame, articles: DataFrame, per_label: int = 100, min_score: float = 0.8, body_limit: int | None = None) -> DataFrame:
    """Training rows (I11): unused corrections with their article text, and the best scored articles of each label.
    ``body_limit`` cuts the body to the input size of the model to be trained."""
    index = F.create_map(*[F.lit(x) for pair in (("negative", 0), ("neutral", 1), ("positive", 2)) for x in pair])
    text = F.concat_ws(" ", "title", F.substring("content", 1, body_limit) if body_limit else F.col("content")).alias("text")
    fresh = corrections.filter(F.col("used_in_finetune") == 0).join(articles.select("article_id", "title", "content"), "article_id").select(
        "article_id", text, index[F.col("corrected_sentiment")].alias("label"), F.lit("correction").alias("origin"))
    known = articles.filter(F.col("sentiment").isNotNull() & (F.col("sentiment_score") >= min_score))
    best = top_per(known.select("article_id", "sentiment", "sentiment_score"), ["sentiment"], [F.desc("sentiment_score"), F.asc("article_id")], per_label)
    model = best.join(articles.select("article_id", "title", "content"), "article_id").select(
        "article_id", text, index[F.col("sentiment")].alias("label"), F.lit("model").alias("origin"))
    return fresh.unionByName(model)


#: Repeated ids that may be sent to every task; more of them meet the rows in a shuffle.
FEW_IDS = 100_000


def training_rows(df: DataFrame, label: str = "label", seq: str = "article_id", body_limit: int | None = None) -> DataFrame:
    """article_id, model text and 0/1 label; unlabelled rows and repeated articles leave. ``body_limit`` as in ``model_text``.

    Ids come first: those that occur more than once are found without any text, and only their rows are compared. All
    other texts stay in the task that reads them."""
    many = durable(df.groupBy("article_id").agg(F.count("*").alias("n")).filter("n > 1").select("article_id"))
    n = many.count()
    # a filter on the text would be moved below it and make every text twice
    text = F.explode(F.filter(F.array(model_text("title", "clean_text", body_limit)), lambda t: t != "")).alias("text")
    rows = df.withColumn("label", binary_label(label)).filter(F.col("label").isNotNull()).select("article_id", F.col(seq).alias("_seq"), text, "label")
    if n == 0:
        return rows.drop("_seq")
    marked = many.select(F.col("article_id").alias("_id"))
    marked = F.broadcast(marked) if n <= FEW_IDS else marked
    same = F.col("article_id").eqNullSafe(F.col("_id"))
    return rows.join(marked, same, "left_anti").drop("_seq").unionByName(keep_first(rows.join(marked, same, "left_semi"), ["article_id"], "_seq").drop("_seq"))


def stratified_split(rows: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, each label cut in the same proportion by a hash of the id."""
    mark = F.pmod(F.xxhash64(F.col("article_id").cast("string"), F.col("label")), F.lit(10_000)) < int(test_share * 10_000)
    return rows.filter(~mark), rows.filter(mark)


def words_of_texts(rows: DataFrame) -> DataFrame:
    """The rows with their words of two letters and more, lower-case."""
    return RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)[^\w]+", minTokenLength=2).transform(rows)


def terms_of_texts(rows: DataFrame) -> DataFrame:
    """The rows with ``terms``, words and word pairs; rows that have ``words`` already are not split again."""
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows if "words" in rows.columns else words_of_texts(rows))
    return pairs.withColumn("terms", F.concat("words", "pairs"))


class BinaryModel:
    """Terms with their idf, and the fitted regression; :meth:`transform` adds ``features`` and ``probability``."""

    def __init__(self, counts: PipelineModel, idf: list[float]):
        self.counts, self.idf, self.regression = counts, idf, None

    def features(self, rows: DataFrame) -> DataFrame:
        """(1 + ln tf) * idf of words and word pairs, unit length per text."""
        idf = np.array(self.idf)

        @F.arrow_udf(VectorUDT())
        def damped(tf: pa.Array) -> pa.Array:
            kind, size, places, counts = tf.flatten()
            weights = (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * idf[places.flatten().to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(counts).to_numpy(zero_copy_only=False))]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(weights), type=counts.type)
            return pa.StructArray.from_arrays([kind, size, places, values], fields=list(tf.type))

        counted = self.counts.transform(terms_of_texts(rows)).withColumn("weighted", damped("tf"))
        return Normalizer(inputCol="weighted", outputCol="features").transform(counted).drop("weighted")

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.regression.transform(self.features(rows))


def fit_terms(rows: DataFrame, max_terms: int = 40_000, min_df: int = 2, max_df: float = 0.98) -> BinaryModel:
    """The ``max_terms`` most frequent words and word pairs, a size of the model, with idf = ln((1 + n) / (1 + df)) + 1.

    A text is split once: its terms, and once more each of them, are counted in one aggregation. Terms of equal frequency
    come in their own order."""
    n = rows.count()
    marked = lambda terms, first: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(first).alias("first")))
    held = terms_of_texts(rows).select(F.explode(F.concat(marked(F.col("terms"), 0), marked(F.array_distinct("terms"), 1))).alias("x")).select("x.term", "x.first")
    sums = held.groupBy("term").agg(F.sum(1 - F.col("first")).alias("total"), F.sum("first").alias("df"))
    fit = sums.filter((F.col("df") >= (min_df if min_df >= 1 else min_df * n)) & (F.col("df") <= (max_df if max_df >= 1 else max_df * n)))
    known = fit.orderBy(F.desc("total"), F.asc("term")).limit(max_terms).collect()  # max_terms rows
    if not known:
        raise ValueError("no term is in enough texts")
    counts = PipelineModel([CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="terms", outputCol="tf")])
    return BinaryModel(counts, [math.log((1 + n) / (1 + r["df"])) + 1 for r in known])


def train_binary(rows: DataFrame, max_terms: int = 40_000, min_df: int = 2, max_df: float = 0.98, min_per_class: int = 10) -> BinaryModel:
    """Balanced logistic regression on sublinear tf-idf of words and word pairs (I7); returns the fitted model.

    The texts are split once; their words are kept in the shared folder while the model is fitted."""
    rows = durable(words_of_texts(rows.select("text", "label")).select("words", "label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2 or min(sizes.values()) < min_per_class:
        raise ValueError(f"each class needs at least {min_per_class} rows, got {sizes}")
    total = sum(sizes.values())
    weights = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, total / (2.0 * v))])
    model = fit_terms(rows, max_terms, min_df, max_df)
    ready = durable(model.features(rows).select("features", "label", weights[F.col("label")].alias("weight")))
    model.regression = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / total, maxIter=100, standardization=False).fit(ready)
    return model


def score_binary(rows: DataFrame, model, threshold: float = 0.6) -> DataFrame:
    """Probability, prediction at the threshold and the bonus a likely article earns."""
    p = vector_to_array("probability")[1]
    bonus = F.when(F.col("p") >= 0.8, 4.0).when(F.col("p") >= 0.7, 3.0).when(F.col("p") >= 0.6, 2.0).when(F.col("p") >= 0.5, 0.8).otherwise(0.0)
    return model.transform(rows).select("article_id", "label", p.alias("p")).select(
        "article_id", "label", "p", (F.col("p") >= threshold).cast("int").alias("prediction"), bonus.alias("bonus"))


def binary_report(scored: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1 and area under the ROC curve from scored rows."""
    scored = durable(scored.select("label", "prediction", "p"))  # two readers share the scores
    y, q = F.col("label") == 1, F.col("prediction") == 1
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(
        scored.select("p", F.col("label").cast("double").alias("label")))
    sums = scored.agg(F.count_if(y & q).alias("tp"), F.count_if(~y & q).alias("fp"), F.count_if(y & ~q).alias("fn"), F.count_if(~y & ~q).alias("tn"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = sums.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("auc", F.lit(auc))
