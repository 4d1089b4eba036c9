"""Assignment of articles to issues, called scopes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.vectors import unit
from tidewire.operators.ranking import next_ids, number_rows
from tidewire.operators.similarity import linked_groups
from tidewire.session import durable


class _Group:
    """The scopes of one component so far: name, place, free room and search vector."""

    def __init__(self, cap: int):
        self.cap = cap
        self.names: list[str] = []
        self.places: list[int] = []
        self.room: list[int] = []
        self.vectors = np.zeros((0, 0))

    def open(self, name: str, place: int, members: int, vec: np.ndarray) -> None:
        n = len(self.names)
        if n == len(self.vectors):
            grown = np.zeros((max(8, 2 * n), len(vec)))
            if n:
                grown[:n] = self.vectors
            self.vectors = grown
        self.vectors[n] = vec
        self.names.append(name), self.places.append(place), self.room.append(self.cap - members)


def _settle(threshold: float, k: int, cap: int, step: int = 256):
    """Rows in the order of component, scopes first, then articles in order of arrival: an article joins the first scope
    with room among its k nearest, or opens one. Of a component only its scopes are kept."""

    def homes(group: _Group, vectors: np.ndarray, ids: np.ndarray, seqs: np.ndarray) -> list[str]:
        known = len(group.names)
        before = np.round(vectors @ group.vectors[:known].T, 9) if known else np.zeros((len(ids), 0))
        among = np.round(vectors @ vectors.T, 9)
        opened: list[int] = []  # rows of this step that have opened a scope
        out = []
        for i, key in enumerate(ids):
            near = [(-before[i, j], group.places[j], group.names[j], j) for j in np.flatnonzero(before[i] >= threshold)]
            near += [(-among[i, r], int(seqs[r]), group.names[known + m], known + m) for m, r in enumerate(opened) if among[i, r] >= threshold]
            choice = next((j for *_, j in sorted(near)[:k] if group.room[j] > 0), None)
            if choice is None:
                choice = len(group.names)
                group.open(f"new:{key}", int(seqs[i]), 0, vectors[i])
                opened.append(i)
            group.room[choice] -= 1
            out.append(group.names[choice])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = None, _Group(cap)
        for pdf in batches:
            if pdf.empty:
                continue
            vectors = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            ids, places, members, kinds = (pdf[c].to_numpy() for c in ("id", "place", "members", "kind"))
            parts = pdf["component"].to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            said = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if parts[a] != now:
                    now, group = parts[a], _Group(cap)
                first = a + int(np.searchsorted(kinds[a:b], 1))
                for i in range(a, first):
                    group.open(ids[i], 0, int(members[i]), vectors[i])
                for c in range(first, b, step):
                    d = min(c + step, b)
                    said += zip(ids[c:d], places[c:d], homes(group, vectors[c:d], ids[c:d], places[c:d]))
            yield pd.DataFrame(said, columns=["id", "seq", "scope"])

    return run


def assign_scopes(articles: DataFrame, scopes: DataFrame, day: str, threshold: float = ko.SIMILARITY_THRESHOLD,
                  k: int = ko.NEAREST_SCOPES, cap: int = ko.ARTICLES_PER_SCOPE, dimension: int | None = None,
                  block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Give every article a scope in order of arrival (I10); returns (article_id, scope_id) and the changed scopes.

    Each article takes the first of its k nearest scopes that reaches the threshold and has room, else opens a scope
    led by its own vector. A scope's search vector does not move during the run; similarities count to nine decimals and
    ties go to the older scope. A decision only looks at scopes and at earlier articles at or above the threshold, so
    the connected components of that relation are settled side by side. Inside a component the order of arrival is
    binding: its rows stream through one task, which holds the component's scopes and one batch.

    ``articles``: article_id, collected_at, embedding. ``scopes``: scope_id, centroid, news_count.
    """
    tagged = articles.withColumn("vec", unit("embedding", dimension))
    usable = tagged.filter(F.col("vec").isNotNull()).select(F.col("article_id").alias("id"), "collected_at", "vec")
    rows = durable(number_rows(usable, [F.asc("collected_at"), F.asc("id")], "seq"))
    state = scopes.select(F.col("scope_id").alias("id"), unit("centroid").alias("vec"), F.coalesce("news_count", F.lit(0)).cast("bigint").alias("members")).filter(F.col("vec").isNotNull())
    node = lambda kind: F.concat(F.lit(f"{kind}:"), "id")
    asking, asked = rows.select(node(1).alias("id"), "vec"), state.select(node(0).alias("id"), "vec")
    of = durable(linked_groups(asking, asking.unionByName(asked), threshold - 1e-8, block))
    told = state.select(F.lit(0).alias("kind"), "id", "vec", "members", F.lit(0).cast("bigint").alias("place")).unionByName(
        rows.select(F.lit(1).alias("kind"), "id", "vec", F.lit(0).cast("bigint").alias("members"), F.col("seq").alias("place")))
    told = told.withColumn("node", F.concat_ws(":", "kind", "id")).join(of, "node", "left").filter("kind = 1 OR component IS NOT NULL")
    ordered = told.withColumn("component", F.coalesce("component", "node")).repartition("component").sortWithinPartitions("component", "kind", "place", "id")
    homes = durable(ordered.select("component", "kind", "place", "id", "members", "vec").mapInPandas(_settle(threshold, k, cap), "id string, seq bigint, scope string"))
    skipped = tagged.filter(F.col("vec").isNull()).select("article_id", F.lit(ko.NO_EMBEDDING).alias("scope_id"))
    fresh = next_ids(homes.filter(F.startswith("scope", F.lit("new:")) & (F.col("scope") == F.concat(F.lit("new:"), F.col("id")))).select("scope", "seq"),
                     [F.asc("seq")], day, scopes, "scope_id", "scope_id").select("scope", "scope_id")
    named = durable(homes.join(fresh, "scope", "left").select("id", F.coalesce("scope_id", "scope").alias("scope_id")))
    # the stored centroid times its count stands for the old sum; members are added and the result is normalised
    old = scopes.join(named.select("scope_id").distinct(), "scope_id", "left_semi").select(
        "scope_id", F.transform(unit("centroid"), lambda x: x * F.col("news_count")).alias("vec"), F.col("news_count").cast("bigint").alias("n"))
    added = named.join(rows.select("id", "vec"), "id").select("scope_id", "vec", F.lit(1).cast("bigint").alias("n"))
    parts = old.unionByName(added)
    sums = parts.select("scope_id", F.posexplode("vec").alias("pos", "x")).groupBy("scope_id", "pos").agg(F.sum("x").alias("x"))
    packed = sums.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("raw"))
    changed = packed.join(parts.groupBy("scope_id").agg(F.sum("n").alias("news_count")), "scope_id").select(
        "scope_id", F.coalesce(unit("raw"), F.col("raw")).alias("centroid"), "news_count")
    return named.select(F.col("id").alias("article_id"), "scope_id").unionByName(skipped), changed
