"""Keyed table maintenance and set operations (A5, A6, A15, A16, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.operators.ranking import keep_first, keep_last


def upsert(target: DataFrame, rows: DataFrame, key: list, seq: str) -> DataFrame:
    """New rows replace old ones with the same key; among new rows the last write wins (A5).

    Old rows leave by an anti join instead of a window over the target, so only keys are compared."""
    newest = keep_last(rows, key, seq).drop(seq)
    return target.join(newest.select(*key), key, "left_anti").unionByName(newest)


def upsert_counts(target: DataFrame, rows: DataFrame, key: list, seq: str) -> DataFrame:
    """How many keys an upsert inserts and how many it updates."""
    touched = rows.select(*key).distinct().join(target.select(*key, F.lit(1).alias("_old")), key, "left")
    return touched.agg(
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated")
    )


def patch(target: DataFrame, rows: DataFrame, key: list, columns: list, seq: str | None = None) -> DataFrame:
    """Set some columns by key and leave the others (A6); a NULL in the patch leaves the old value.

    Several patch rows of a key count as written one after another in the order of ``seq``: each column takes its last
    value that is not NULL. Without ``seq`` one of them is taken whole, the largest by ``columns``. Either way they are
    combined before the shuffle, and no target row is doubled."""
    if seq is None:
        whole = F.max(F.struct(*columns)).alias("_patch")
        fresh = rows.groupBy(*key).agg(whole).select(*key, *[F.col(f"_patch.{c}").alias(f"_new_{c}") for c in columns])
    else:
        last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
        fresh = rows.groupBy(*key).agg(*[last(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(fresh, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def insert_ignore(target: DataFrame, rows: DataFrame, key: list, seq: str) -> DataFrame:
    """Add rows whose key is absent; the first of several new rows is kept."""
    return target.unionByName(keep_first(rows, key, seq).select(*target.columns).join(target.select(*key), key, "left_anti"))


def stage_log(df: DataFrame, stage_code: str, failed, failure_kind, message=None) -> DataFrame:
    """One process-log row per input row: success, or fail with the mapped error code."""
    codes = F.create_map(*[F.lit(x) for pair in ko.STAGE_ERROR_CODES.items() for x in pair])
    code = F.coalesce(F.element_at(codes, failure_kind), F.lit(ko.OTHER_ERROR))
    bad = F.coalesce(failed, F.lit(False))
    return df.select(
        "article_id",
        F.lit(stage_code).alias("code_id"),
        F.when(bad, "fail").otherwise("success").alias("status"),
        F.when(bad, code).alias("error_code"),
        F.when(bad, message if message is not None else failure_kind).alias("error_message"),
    )


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, missing columns as typed NULL (G1)."""
    return left.unionByName(right, allowMissingColumns=True)


def common_items(df: DataFrame, left: str, right: str, name: str = "common") -> DataFrame:
    """Words in both arrays of a row."""
    return df.withColumn(name, F.array_intersect(left, right))


def stopword_set(fixed: DataFrame, added: DataFrame, column: str = "word") -> DataFrame:
    """Distinct union of the fixed and the added stopwords."""
    return fixed.select(column).unionByName(added.select(column)).distinct()


def drop_stopwords(words: DataFrame, stopwords: DataFrame, column: str = "word") -> DataFrame:
    return words.join(stopwords.select(column), column, "left_anti")


def dedupe(df: DataFrame, key: list, seq: str, keep: str = "first") -> DataFrame:
    """One row per key, the first or the last."""
    return keep_first(df, key, seq) if keep == "first" else keep_last(df, key, seq)
