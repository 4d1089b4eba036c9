"""Ordered-time operators: session pairing, streaks, fills, as-of and interval joins.

A group (a user, a day, the whole table) may be too large for one task, so order-dependent work is done
inside short time slices and only one small row per slice is carried across slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.ranking import seconds_slice
from tidewire.session import durable


def with_next(df: DataFrame, keys: list, order: list, slice_by: Column, columns: list, prefix: str = "next_") -> DataFrame:
    """The following row's values within ``keys``. The last row of a slice takes the first row of the next
    non-empty slice; ``slice_by`` must rise with ``order``."""
    sliced = df.withColumn("_slice", slice_by)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    payload = F.struct(*columns)
    firsts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.min_by(payload, F.struct(*order)).alias("_first"))
        .withColumn("_carried", F.lead("_first").over(W.partitionBy(*keys).orderBy("_slice")))
        .drop("_first")
    )
    on = F.lit(True)
    right = firsts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_slice").alias("_r_slice"), "_carried")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = sliced.withColumn("_next", F.lead(payload).over(inside)).join(right, on & (F.col("_slice") == F.col("_r_slice")), "left")
    following = F.coalesce(F.col("_next"), F.col("_carried"))
    return out.select(*df.columns, *[following[c].alias(prefix + c) for c in columns])


def pair_sessions(logins: DataFrame, default_seconds: int = 300, slice_seconds: int = 600) -> DataFrame:
    """Stay per login within a day (E5): the next event ends it; a further login or no event counts as the default.
    A logout without a login before it starts nothing."""
    ok = logins.filter((F.col("result") == "success") & F.col("user_id").isNotNull()).select(
        "user_id", "event_type", "created_at", F.to_date("created_at").alias("day")
    )
    linked = with_next(
        ok, ["user_id", "day"], ["created_at", "event_type"], seconds_slice("created_at", slice_seconds),
        ["event_type", "created_at"],
    )
    gap = F.floor((F.unix_micros(F.col("next_created_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000)
    stay = F.when(F.col("next_event_type") == "logout", F.greatest(gap, F.lit(0))).otherwise(F.lit(default_seconds))
    return linked.filter(F.col("event_type") == "login").select(
        "user_id", "day", F.col("created_at").alias("login_at"), stay.cast("bigint").alias("stay_seconds")
    )


def failure_streak(logins: DataFrame, tie: str, lock_at: int = 5, slice_seconds: int = 600) -> DataFrame:
    """Consecutive failures per user and day; a success resets to 0 (E6). ``locked`` marks lock_at or more."""
    rows = logins.filter(F.col("user_id").isNotNull()).withColumn("day", F.to_date("created_at")).withColumn(
        "_slice", seconds_slice("created_at", slice_seconds)
    ).withColumn("_fail", (F.col("result") != "success").cast("bigint"))
    keys = ["user_id", "day"]
    run = W.partitionBy(*keys, "_slice").orderBy("created_at", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_wins", F.sum(1 - F.col("_fail")).over(run)).withColumn("_fails", F.sum("_fail").over(run))
    # failures already counted when the last success of the slice happened
    rows = rows.withColumn("_base", F.max(F.when(F.col("_fail") == 0, F.col("_fails"))).over(run))
    slices = rows.groupBy(*keys, "_slice").agg(F.sum("_fail").alias("_all"), F.max("_base").alias("_last_base"))
    line = W.partitionBy(*keys).orderBy("_slice")
    before = F.coalesce(F.sum("_all").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("_before", before)
    at_reset = F.last(F.col("_before") + F.col("_last_base"), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1))
    slices = slices.withColumn("_carry", F.col("_before") - F.coalesce(at_reset, F.lit(0))).select(*keys, "_slice", "_carry")
    streak = F.when(F.col("_fail") == 0, 0).when(F.col("_base").isNotNull(), F.col("_fails") - F.col("_base")).otherwise(
        F.col("_carry") + F.col("_fails")
    )
    return (
        rows.join(slices, [*keys, "_slice"])
        .withColumn("fail_streak", streak.cast("bigint"))
        .withColumn("locked", F.col("fail_streak") >= lock_at)
        .select(*logins.columns, "fail_streak", "locked")
    )


def ranged(df: DataFrame, order: list, name: str = "_range") -> DataFrame:
    """The rows in sampled ranges of ``order``, numbered in rising order, in the shared folder. However the values are
    spread, ranges get like numbers of rows, as long as ``order`` tells rows apart."""
    return durable(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def carry_last(df: DataFrame, keys: list, order: list, value: str, name: str, before_only: bool = False) -> DataFrame:
    """The newest non-NULL ``value`` at or before each row within ``keys`` (``before_only``: before it) as ``name``.

    Rows are merged in order inside sampled ranges of keys and order; a range that begins inside a key is given the last
    value of the ranges before it, one small row per key and range. Neither a crowded hour nor a crowded key meets in one
    task. ``order`` should tell rows apart.
    """
    rows = ranged(df, [*keys, *order])
    up_to = -1 if before_only else W.currentRow
    inside = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, up_to)
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    spot = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    ends = rows.filter(F.col(value).isNotNull()).groupBy("_range", *keys).agg(F.max_by(value, spot).alias("_end"))
    # where a key goes on in a range that holds none of its values, the last one is still that of an earlier range
    marks = _null_safe(rows.groupBy("_range", *keys).agg(F.lit(1).alias("_one")), ends, keys, "_end")
    line = W.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(line)).filter(F.col("_carried").isNotNull()).select("_range", *keys, "_carried")
    return _null_safe(here, carried, keys, "_carried").withColumn(name, F.coalesce("_here", "_carried")).drop("_range", "_here", "_carried")


def _null_safe(left: DataFrame, right: DataFrame, keys: list, column: str) -> DataFrame:
    """``left`` with ``column`` of the row of ``right`` of equal range and keys, nulls being equal."""
    right = right.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_r_{k}") for k in keys], column)
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, on, "left").drop("_r", *[f"_r_{k}" for k in keys])


def fill_last(df: DataFrame, column: str, ts: str, tie: str, keys: list | None = None) -> DataFrame:
    """The newest non-NULL value at or before each row."""
    return carry_last(df, keys or [], [ts, tie], column, f"{column}_filled")


def asof_job(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each log row gets the newest job started at or before it, of jobs that start together the largest id.

    Logs and starts are merged in the order of time over sampled ranges (see :func:`carry_last`), so no slice of time
    is fixed in advance: rows of one hour spread as those of a year do. A log without a time has no job.
    """
    job_type = jobs.schema["job_id"].dataType
    starts = jobs.filter("start_at IS NOT NULL").select(F.col("start_at").cast("timestamp").alias("_at"), F.lit(0).alias("_side"), "job_id", F.lit(0).cast("bigint").alias("_tie"), F.lit(None).cast(logs.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    rows = logs.select(F.col("occurred_at").cast("timestamp").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(job_type).alias("job_id"), F.xxhash64(*[F.col(c) for c in logs.columns]).alias("_tie"), F.struct("*").alias("_row"))
    merged = carry_last(starts.unionByName(rows), [], ["_at", "_side", "job_id", "_tie"], "job_id", "_job")
    return merged.filter("_side = 1").select("_row.*", F.col("_job").alias("job_id"))


def prefix_counts(x: np.ndarray, y: np.ndarray, weights: np.ndarray, up_to_x: np.ndarray, below_y: np.ndarray) -> np.ndarray:
    """For each query the weights of the points with x <= up_to_x and y < below_y, one column per weight.

    The points that come first by x are taken apart into blocks whose lengths are powers of two, one per bit of their
    number; blocks of one length are sorted by y together, so each length costs one sort and one search."""
    by_x = np.argsort(x, kind="stable")
    many = np.searchsorted(x[by_x], up_to_x, side="right")
    level = np.searchsorted(np.sort(y), y)[by_x]
    limit = np.searchsorted(np.sort(y), below_y)
    out = np.zeros((len(up_to_x), weights.shape[1]), dtype=np.int64)
    n = len(x)
    for bit in range(n.bit_length()):
        asking = np.flatnonzero(many >> bit & 1)
        if not len(asking):
            continue
        keys = (np.arange(n) >> bit) * (n + 1) + level
        order = np.argsort(keys, kind="stable")
        sums = np.concatenate([np.zeros((1, weights.shape[1]), dtype=np.int64), np.cumsum(weights[by_x][order], axis=0)])
        block = (many[asking] >> (bit + 1)) << 1
        out[asking] += sums[np.searchsorted(keys[order], block * (n + 1) + limit[asking])] - sums[np.minimum(block << bit, n)]
    return out


def _partial(x: str, y: str):
    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or points.empty:
            return pd.DataFrame({"job": pd.Series([], dtype=object), "total": pd.Series([], dtype="int64"), "bad": pd.Series([], dtype="int64")})
        found = prefix_counts(*[points[c].to_numpy(dtype=np.int64) for c in (x, y)], points[["one", "bad"]].to_numpy(dtype=np.int64), asked["x"].to_numpy(dtype=np.int64), asked["y"].to_numpy(dtype=np.int64))
        found *= asked["sign"].to_numpy(dtype=np.int64)[:, None]
        return pd.DataFrame({"job": asked["job"].to_numpy(dtype=object), "total": found[:, 0], "bad": found[:, 1]})

    return run


_NEVER, _ALWAYS = -(2**62), 2**62


def job_stats(jobs: DataFrame, meta: DataFrame, incomplete_ids: DataFrame) -> DataFrame:
    """Per job: distinct articles created in [start, end] and how many of them are incomplete (C11).

    Of an article's times only the first inside an interval counts: a time t whose previous one p is before the start.
    The distinct articles are thus the points (t, p) with t <= end and p < start, less those with t < start. Points are cut
    into sampled ranges by t and by p. Whole ranges are summed in a table of one number per pair of ranges; only the
    range of t that holds the end and the range of p that holds the start are looked into. Each time and each job is
    sent to two ranges, however many intervals overlap.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    times = meta.select("article_id", micros("created_at").alias("t")).filter("t IS NOT NULL AND article_id IS NOT NULL").distinct()
    linked = carry_last(times, ["article_id"], ["t"], "t", "p", before_only=True)
    flagged = incomplete_ids.select("article_id", F.lit(1).cast("bigint").alias("bad")).distinct()
    points = linked.join(flagged, "article_id", "left").select("article_id", "t", F.coalesce("p", F.lit(_NEVER)).alias("p"), F.lit(1).cast("bigint").alias("one"), F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad"))
    points = ranged(ranged(points, ["t", "article_id"], "tr"), ["p", "article_id"], "pr")
    t_from = points.groupBy("tr").agg(F.min("t").alias("edge")).orderBy("tr").collect()  # one row per range
    p_to = points.groupBy("pr").agg(F.max("p").alias("edge")).orderBy("pr").collect()
    ids = jobs.select("job_id", micros("start_at").alias("s"), micros("end_at").alias("e")).filter("s IS NOT NULL AND e IS NOT NULL").distinct()
    line = lambda x, y, sign: ids.select(F.struct("job_id", "s", "e").alias("job"), x.alias("x"), y.alias("y"), F.lit(sign).cast("bigint").alias("sign"))
    asked = line(F.col("e"), F.col("s"), 1).unionByName(line(F.col("s") - 1, F.lit(_ALWAYS).cast("bigint"), -1))
    # the last range of t that begins at or before x, and the first range of p that ends at or after y
    edges = lambda rows, name: F.array(*[F.struct(F.lit(r[name]).alias("r"), F.lit(r["edge"]).cast("bigint").alias("edge")) for r in rows]) if rows else F.array().cast("array<struct<r:int,edge:bigint>>")
    tr = F.array_max(F.transform(F.filter(edges(t_from, "tr"), lambda r: r["edge"] <= F.col("x")), lambda r: r["r"]))
    pr = F.array_min(F.transform(F.filter(edges(p_to, "pr"), lambda r: r["edge"] >= F.col("y")), lambda r: r["r"]))
    asked = durable(asked.withColumn("tr", F.coalesce(tr, F.lit(-1))).withColumn("pr", F.coalesce(pr, F.lit(2**30))))
    plain = asked.select("tr", "pr", F.to_json("job", {"ignoreNullFields": "false"}).alias("job"), "x", "y", "sign")
    schema = "job string, total bigint, bad bigint"
    in_t = points.groupBy("tr").cogroup(plain.groupBy("tr")).applyInPandas(_partial("t", "p"), schema)
    in_p = points.groupBy("pr").cogroup(plain.withColumn("x", F.col("tr").cast("bigint") - 1).groupBy("pr")).applyInPandas(_partial("tr", "p"), schema)
    cells = F.broadcast(points.groupBy(F.col("tr").alias("ct"), F.col("pr").alias("cp")).agg(F.sum("one").alias("one"), F.sum("bad").alias("w")))
    corners = plain.select("tr", "pr").distinct().join(cells, (F.col("ct") < F.col("tr")) & (F.col("cp") < F.col("pr"))).groupBy("tr", "pr").agg(F.sum("one").alias("one"), F.sum("w").alias("w"))
    whole = plain.join(corners, ["tr", "pr"]).select("job", (F.col("one") * F.col("sign")).alias("total"), (F.col("w") * F.col("sign")).alias("bad"))
    counts = in_t.unionByName(in_p).unionByName(whole).groupBy("job").agg(F.sum("total").alias("total"), F.sum("bad").alias("bad"))
    own = jobs.withColumn("_job", F.to_json(F.struct("job_id", micros("start_at").alias("s"), micros("end_at").alias("e")), {"ignoreNullFields": "false"}))
    joined = own.join(counts.withColumnRenamed("job", "_job"), "_job", "left")
    return joined.select(
        *jobs.columns,
        F.greatest(F.coalesce("total", F.lit(0)), F.lit(0)).alias("total_count"),
        F.greatest(F.coalesce("bad", F.lit(0)), F.lit(0)).alias("fail_count"),
    )
