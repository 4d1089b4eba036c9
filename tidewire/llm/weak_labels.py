"""Quality classifier from weak labels: expectation-maximisation over heuristic votes, then a hashed linear scorer."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable

SPACE = r"[\x20\x09-\x0D]+"
#: Very common words of the four languages.
COMMON = ["a", "and", "auf", "das", "de", "del", "der", "des", "die", "du", "el", "en", "est", "et", "for", "in", "is", "la", "las", "le", "les",
          "los", "of", "que", "se", "that", "the", "to", "un", "und", "une", "von", "with", "y", "zu"]
#: The scorer is fitted on about so many rows at most, taken by a hash of id and text.
FIT_ROWS = 20_000
BUCKETS = 1 << 16


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, 2 for neither."""
    return F.when(bad, "0").when(good, "1").otherwise("2")


def with_features(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``doc_id, key, words, shapes`` per row. A shape is the word with its letters and digits as classes (``Aa.``)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{Nd}+", "0")
    return rows.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("key"),
        F.octet_length("text").alias("size"),
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.array_remove(F.split(shaped, SPACE), "").alias("shapes"),
    )


def votes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``votes``: one character per labeller, in the order below. Every labeller sees the whole text."""
    n = F.size("words")
    among = ", ".join(f"'{w}'" for w in COMMON)
    shares = {
        "distinct": F.size(F.array_distinct("words")) / n,
        "common": F.size(F.expr(f"filter(words, w -> w IN ({among}))")) / n,
        "capital": F.size(F.expr("filter(shapes, s -> s LIKE 'A%' AND s NOT LIKE 'Aa%')")) / n,
        "symbol": F.size(F.expr("filter(shapes, s -> s RLIKE '[#*$%&|<>=_{}^~]')")) / n,
        "ending": F.size(F.expr("filter(shapes, s -> s RLIKE '[.!?]$')")) / n,
        "bare": F.size(F.expr("filter(shapes, s -> s NOT RLIKE '[a-zA-Z]')")) / n,
        "length": F.col("size") / n,
    }
    rows = rows.withColumns({f"s_{k}": F.when(n > 0, v) for k, v in shares.items()})
    s = {k: F.coalesce(F.col(f"s_{k}"), F.lit(-1.0)) for k in shares}
    enough = n >= 30
    heads = [
        _vote(enough & (s["distinct"] > 0.5), enough & (s["distinct"] < 0.35)),
        _vote(enough & (s["common"] > 0.08), enough & (s["common"] < 0.02)),
        _vote((n > 0) & (s["capital"] < 0.1), (n > 0) & (s["capital"] > 0.4)),
        _vote((n > 0) & (s["symbol"] < 0.02), (n > 0) & (s["symbol"] > 0.1)),
        _vote(enough & s["ending"].between(0.01, 0.3), enough & ((s["ending"] > 0.5) | (s["ending"] < 0.002))),
        _vote((n > 0) & (s["bare"] < 0.05), (n > 0) & (s["bare"] > 0.15)),
        _vote((n > 0) & s["length"].between(3.5, 14), (n > 0) & ~s["length"].between(2.5, 25)),
    ]
    return rows.withColumn("votes", F.concat(*heads)).drop(*[f"s_{k}" for k in shares])


def fit_votes(patterns: dict[str, int], rounds: int = 200) -> dict:
    """Prior of good and each labeller's vote odds in both classes, by expectation-maximisation over counted patterns.

    Starts from the majority of votes; abstentions say nothing. Counts are smoothed by one, so an empty table gives the uniform model.
    """
    keys = sorted(patterns)
    n_heads = len(keys[0]) if keys else 0
    seen = np.array([[int(c) for c in k] for k in keys], dtype=np.int64).reshape(len(keys), n_heads)
    n = np.array([patterns[k] for k in keys], dtype=float)
    good = np.array([0.9 if (row == 1).sum() > 2 * (row == 0).sum() else 0.1 for row in seen])
    prior, odds = 0.5, np.full((2, n_heads, 3), 0.5)
    for _ in range(rounds):
        prior = (1 + (n * good).sum()) / (2 + n.sum())
        for cls, weight in ((1, n * good), (0, n * (1 - good))):
            for v in (0, 1):
                odds[cls, :, v] = 1 + (weight[:, None] * (seen == v)).sum(axis=0)
        odds[:, :, :2] /= odds[:, :, :2].sum(axis=2, keepdims=True)
        odds[:, :, 2] = 1.0  # a labeller that abstains says nothing
        log = [np.log(p) + np.log(odds[c][np.arange(n_heads), seen]).sum(axis=1) if len(keys) else np.zeros(0) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if len(new) == 0 or np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return {"prior": prior, "odds": odds, "posterior": dict(zip(keys, good.tolist(), strict=True))}


def _tokens() -> Column:
    """What the scorer hashes: words, shapes, and how varied the text is in tenths."""
    variety = F.when(F.size("words") > 0, F.floor(10 * F.size(F.array_distinct("words")) / F.size("words")).cast("string")).otherwise("none")
    return F.concat(F.expr("transform(words, w -> concat('w:', w))"), F.expr("transform(shapes, s -> concat('s:', s))"), F.array_repeat(F.concat(F.lit("v:"), variety), F.size("words") + 1))


def label_model(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """The rows of :func:`with_features` with their votes, and the label model fitted on the votes of all rows.

    Votes are counted by pattern; three to the number of labellers at most reach the driver.
    """
    rows = votes(with_features(docs, id_column, text))
    counted = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return rows, fit_votes(counted) | {"rows": sum(counted.values())}


def weak_labels(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with the label model's ``posterior`` of a good text."""
    known = rows.sparkSession.createDataFrame(list(model["posterior"].items()), "votes string, posterior double")
    return rows.join(F.broadcast(known), "votes")  # one row per pattern, 3 ** 7 at most


def quality_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """One row per input row: ``doc_id, score, kept``.

    The label model's posteriors, as labels weighted by their certainty, train the scorer on a hash sample of about
    ``fit_rows`` rows. ``score`` is the scorer's probability of a good text, ``kept`` whether it is at least one half.
    A null or empty text has no words: its labellers abstain. Without both classes among the fitted labels (as in an
    empty table) the score is the posterior. Repeated rows score alike; other columns are not read.
    """
    rows, model = label_model(docs, id_column, text)
    share = min(1.0, fit_rows / max(1, model["rows"]))
    features = PipelineModel([HashingTF(inputCol="tokens", outputCol="counts", numFeatures=BUCKETS), Normalizer(inputCol="counts", outputCol="features", p=2.0)])
    chosen = rows.filter(F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share))
    taught = weak_labels(chosen, model).withColumn("tokens", _tokens()).withColumn("label", (F.col("posterior") >= 0.5).cast("double"))
    taught = taught.withColumn("weight", 2 * F.abs(F.col("posterior") - 0.5) + 1e-3)
    taught = durable(features.transform(taught).select("features", "label", "weight")).coalesce(4)  # about fit_rows rows
    keep = F.col("score") >= 0.5
    if taught.select("label").distinct().count() < 2:
        return weak_labels(rows, model).select("doc_id", F.col("posterior").alias("score")).withColumn("kept", keep)
    scorer = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-6, maxIter=100, standardization=False).fit(taught)
    scored = scorer.transform(features.transform(with_features(docs, id_column, text).withColumn("tokens", _tokens())))
    return scored.select("doc_id", vector_to_array("probability")[1].alias("score")).withColumn("kept", keep)
