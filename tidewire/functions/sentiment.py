"""Sentiment expressions over class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.text import as_col


def boosted(probability, weights, unit: float = ko.LEXICON_BOOST) -> Column:
    """Add unit*weight per lexicon hit in order, never above 1 (H26, before renormalising)."""
    return F.aggregate(
        F.coalesce(as_col(weights), F.array().cast("array<double>")),
        as_col(probability).cast("double"),
        lambda p, w: F.least(F.lit(1.0), p + F.lit(unit) * w),
    )


def gap_label(positive, negative, gap: float = ko.NEUTRAL_GAP) -> Column:
    """Label and score as a struct: a gap below the limit is neutral with 1 - gap, else the larger class."""
    p, n = F.coalesce(as_col(positive), F.lit(0.0)), F.coalesce(as_col(negative), F.lit(0.0))
    distance = F.abs(p - n)
    return (
        F.when(distance < gap, F.struct(F.lit("neutral").alias("label"), F.bround(1.0 - distance, 6).alias("score")))
        .when(p > n, F.struct(F.lit("positive").alias("label"), F.bround(p, 6).alias("score")))
        .otherwise(F.struct(F.lit("negative").alias("label"), F.bround(n, 6).alias("score")))
    )
