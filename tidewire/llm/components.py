"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; edges are (smaller, larger)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"), F.col("b").alias("node"))
    return moved.select("a", "b").filter("a <> b").unionByName(moved.select("a", F.col("node").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of the links; the component is its least node.

    Each round costs two aggregations and two joins; the number of rounds grows with the logarithm of the longest path.
    Minima are combined before they are shuffled and a node of many links is split by the adaptive join. Null ends and
    loops are left out; an empty table gives an empty result.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    now, before = durable(now), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = durable(_small_star(_large_star(now)))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
