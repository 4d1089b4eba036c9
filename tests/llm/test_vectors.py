"""Anchor trees and vector codes against plain code."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.anchor_trees import anchors, build_tree, owners, search, squared, sums_by_entry
from tidewire.llm.vector_codes import LIMIT, encode_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def clouds(rnd, n, width, spread=40):
    centres = rnd.integers(-300, 300, (5, width))
    x = centres[rnd.integers(0, 5, n)] + rnd.integers(-spread, spread + 1, (n, width))
    x[: n // 3] = x[0]  # one point holds a third
    return x.astype(np.int64)


@pytest.mark.parametrize("n,width,leaf", [(1, 4, 24), (2, 1, 1), (40, 3, 2), (700, 4, 1), (3000, 4, 24), (500, 64, 8)])
def test_trees_give_every_point_its_nearest_entry(n, width, leaf):
    rnd = np.random.default_rng(n)
    x = clouds(rnd, n, width)
    tree = build_tree(x, leaf)
    assert (np.sort(tree.order) == np.arange(n)).all() and (x[tree.order] == tree.points).all()
    for node in range(len(tree.start)):
        own = tree.points[tree.start[node] : tree.end[node]]
        assert (tree.total[node] == own.sum(axis=0)).all() and tree.radius2[node] == squared(own, tree.pivot[node]).max()
        if tree.left[node] >= 0:
            a, b = tree.left[node], tree.right[node]
            assert (tree.start[node], tree.end[a], tree.end[node]) == (tree.start[a], tree.start[b], tree.end[b])
    for entries in (x[:64], np.repeat(x[:5], 3, axis=0), rnd.integers(-400, 400, (64, width)), x[:1]):
        want = squared(x[:, None], entries[None]).argmin(axis=1)
        assert (owners(tree, entries) == want).all()
        total, count = sums_by_entry(tree, entries)
        assert (count == np.bincount(want, minlength=len(entries))).all()
        assert (total == np.array([x[want == k].sum(axis=0) for k in range(len(entries))])).all()


def test_far_balls_are_owned_without_a_look_at_their_points():
    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.integers(-9, 10, (800, 4)) + c for c in (0, 1000, 5000)]).astype(np.int64)
    owned, loose, _ = search(build_tree(x), np.array([[0] * 4, [1000] * 4, [5000] * 4], dtype=np.int64))
    assert len(loose) == 0 and len(owned) < 10
    owner = anchors(x, 3)
    assert sorted(np.bincount(owner)) == [800, 800, 800]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = Counter(len(v) for _, v, _ in kept if v and len(v) % parts == 0).most_common(1)[0][0]
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in kept if len(v) == size]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for step in range(rounds + 1):
        d = np.array([squared(x[:, p][:, None], books[p][None]) for p in range(parts)])
        own = d.argmin(axis=2)
        if step < rounds:
            for p in range(parts):
                for e in set(own[p].tolist()):
                    members = x[own[p] == e, p]
                    books[p][e] = [math.floor(s / len(members)) if abs(s) < 2**50 else s // len(members) for s in members.sum(axis=0).tolist()]
    error = d.min(axis=2).sum(axis=0)
    return Counter((i, lab, tuple(own[:, k].tolist()), int(error[k])) for k, (i, _, lab) in enumerate(kept)), np.array(books)


def sample(n, dim=32, seed=1):
    rnd = random.Random(seed)
    hot = [rnd.gauss(0, 0.2) for _ in range(dim)]
    rows = [(k, hot if k % 3 == 0 else [rnd.gauss(0, 0.2) for _ in range(dim)], rnd.choice([None, 1, 2])) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (dim - 1), 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 1), (n + 3, [float("-inf")] + [0.0] * (dim - 1), 1), (n + 4, [], 1), (n + 5, [0.5] * 16, 1), (n + 6, [0.5] * 3, 2)]
    return rows + [(None, hot, None), (None, hot, None), (1, hot, 5), (1, hot, 5)]


@pytest.mark.parametrize("n,leaf,block_rows", [(400, 2, 150), (400, 24, 1 << 14), (20, 24, 7)])
def test_codes(spark, n, leaf, block_rows):
    rows = sample(n)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit("x")).withColumn("rest", F.lit(1))
    made = encode_vectors(df, carry=["label"], leaf=leaf, block_rows=block_rows)
    want, books = plain_codes(rows)
    assert Counter((r.vec_id, r.rest.label, tuple(r.codes), r.error) for r in made.rows.collect()) == want
    assert (made.codebooks == books).all()


def test_empty_and_too_large(spark):
    made = encode_vectors(spark.createDataFrame([], SCHEMA))
    assert made.rows.collect() == [] and made.rows.columns == ["vec_id", "rest", "codes", "error"]
    assert encode_vectors(spark.createDataFrame([(1, None, 1), (2, [1.0], 1)], SCHEMA)).rows.collect() == []
    with pytest.raises(Exception, match="or more"):
        encode_vectors(spark.createDataFrame([(1, [float(LIMIT)] * 16, 1)], SCHEMA)).rows.collect()
