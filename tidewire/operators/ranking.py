"""Ordering, numbering, paging and picking (sections E1, E8, E9 and F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import durable


def number_rows(df: DataFrame, order: list, name: str = "row_no", start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table without sending it through one task.

    The rows are range-partitioned on the ordering, each range is numbered on its own, and the range
    sizes (one row per range) give the offsets. ``order`` must be a total order.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")  # one row per shuffle partition
        .withColumn(name, (F.col("_before") + F.col("_inside") + (start - 1)).cast("bigint"))
        .drop("_range", "_inside", "_before")
    )


def rank_by(df: DataFrame, metric: str, tie: str, name: str = "rank") -> DataFrame:
    """Positions by falling metric, ties by key."""
    return number_rows(df, [F.desc(metric), F.asc(tie)], name)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of an ordering (F2); Spark keeps k rows per task, then merges."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, keys: list, order: list, n: int, name: str | None = None) -> DataFrame:
    """The first n rows of every group (E2-E4, F8). Spark cuts each task's share of a group to n rows before the
    shuffle, so a group that holds much of the table sends only n rows per task."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_position", position).filter(F.col("_position") <= n)
    return out.withColumnRenamed("_position", name) if name else out.drop("_position")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of one page; combine with :func:`page_info` for the totals."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > number * size)


def latest_rows(df: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date (F1): a scalar subquery, so the scan is filtered by one value."""
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


def sample_one(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One random row (F4): the first in the order of a hash of seed and key, so that a seed always picks the same."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(1)


def prefix_within(df: DataFrame, text: str, order: list, max_length: int, max_rows: int) -> DataFrame:
    """Rows from the top until the next text would pass the length budget, at most ``max_rows``.

    Only ``max_rows`` rows can survive, so the running sum works on that many."""
    head = df.orderBy(*order).limit(max_rows)
    spot = W.orderBy(*order)
    used = F.sum(F.length(text)).over(spot.rowsBetween(W.unboundedPreceding, W.currentRow))
    return head.withColumn("used_length", used).filter(F.col("used_length") <= max_length)


def next_ids(df: DataFrame, order: list, prefix: str, existing: DataFrame, id_column: str, name: str = "new_id") -> DataFrame:
    """Ids ``prefix-0001`` onwards, continuing after the largest number in use under the prefix."""
    used = existing.filter(F.startswith(id_column, F.lit(prefix))).agg(
        F.coalesce(F.max(F.substring_index(F.col(id_column), "-", -1).try_cast("bigint")), F.lit(0)).alias("_used")
    )
    number = F.col("_no") + used.scalar()
    return number_rows(df, order, "_no").withColumn(name, F.format_string("%s-%04d", F.lit(prefix), number)).drop("_no")


def merge_logs(left: DataFrame, right: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """The newest n of two logs with different columns, newest first."""
    order = [F.desc(ts), F.desc(tie)]
    both = left.orderBy(*order).limit(n).unionByName(right.orderBy(*order).limit(n), allowMissingColumns=True)
    return both.orderBy(*order)


def keep_first(df: DataFrame, keys: list, seq: str) -> DataFrame:
    """First row per key (E7), by a min-by aggregation that shrinks on the map side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(seq)).alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: list, seq: str) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.col(seq)).alias("_row")).select("_row.*")


def mode_by(df: DataFrame, keys: list, label: str, name: str = "mode") -> DataFrame:
    """Most frequent label per key, the smaller label on a tie (D23): two aggregations, no window."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    best = F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias(name)
    return counts.groupBy(*keys).agg(best, F.max("_n").alias(f"{name}_count"))


def seconds_slice(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
