"""Short codes for vectors: each vector is cut into parts, each part is named by the nearest entry of its own codebook.

Codebooks are fitted over all vectors. Blocks of vectors get one metric tree per part (:mod:`anchor_trees`), written once to
the shared folder; every round searches those trees with the codebooks of the round before, so that balls owned by one
entry add their cached sums and counts, and only sums per entry leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.anchor_trees import LEAF, Tree, build_tree, owners, squared, sums_by_entry
from tidewire.session import durable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors and bytes of one block at most.
BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 8 << 20
#: Components are whole numbers below this, so that all sums of squares stay exact.
LIMIT = 1 << 25


@dataclass
class Codes:
    rows: DataFrame
    #: part, entry, position within the part
    codebooks: np.ndarray


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _whole(vector: Column, scale: int) -> Column:
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(F.forall(scaled, lambda x: F.abs(x) < LIMIT), scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more")).cast("array<int>"))


_FIELDS = [("order", np.int32), ("points", np.int32), ("start", np.int32), ("end", np.int32), ("left", np.int32), ("right", np.int32), ("pivot", np.int32), ("radius2", np.int64), ("total", np.int64)]


def _packed(tree: Tree) -> bytes:
    raw = b"".join(getattr(tree, name).astype(kind).tobytes() for name, kind in _FIELDS)
    head = np.array([*tree.points.shape, len(tree.start)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + raw)


def _unpacked(raw: bytes) -> Tree:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, width, nodes = (int(x) for x in np.frombuffer(raw, dtype=np.int64, count=3))
    shapes = {"order": (n,), "points": (n, width), "pivot": (nodes, width), "total": (nodes, width)}
    at, made = 24, {}
    for name, kind in _FIELDS:
        shape = shapes.get(name, (nodes,))
        made[name] = np.frombuffer(raw, dtype=kind, count=int(np.prod(shape)), offset=at).reshape(shape).astype(np.int64)
        at += made[name].size * np.dtype(kind).itemsize
    return Tree(**made)


def _cut(values: np.ndarray, parts: int) -> np.ndarray:
    """Part, vector, position."""
    return values.reshape(len(values), parts, -1).transpose(1, 0, 2).astype(np.int64)


def _built(dim: int, parts: int, leaf: int, most: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        have: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in have)
                have.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in have) == most:
                    yield pa.Table.from_batches(have).combine_chunks()
                    have = []
        if have:
            yield pa.Table.from_batches(have).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values = block.column("whole").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            trees = [_packed(build_tree(part, leaf)) for part in _cut(values, parts)]
            whole = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(k).combine_chunks()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "rests", "trees"])

    return run


def _summed(codebooks: np.ndarray):
    """One row per part and used entry of what all blocks of a task add up to."""
    parts, entries, _ = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(codebooks), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, raw in enumerate(trees):
                    own, n = sums_by_entry(_unpacked(raw.as_py()), codebooks[p])
                    total[p] += own
                    count[p] += n
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
        )

    return run


def _coded(codebooks: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, error = [], 0
                for p, raw in enumerate(batch.column(2)[k]):
                    tree = _unpacked(raw.as_py())
                    own = owners(tree, codebooks[p])
                    points = np.empty_like(tree.points)
                    points[tree.order] = tree.points
                    error = error + squared(points, codebooks[p][own])
                    codes.append(own)
                flat = pa.array(np.array(codes).T.reshape(-1), pa.int32())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(error) + 1) * len(codes), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, codes, pa.array(error)], names=names)

    return run


def encode_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", carry: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, leaf: int = LEAF, block_rows: int = BLOCK_ROWS) -> Codes:
    """Codes of all vectors, ``id, rest, codes, error`` (the entry of every part and the sum of squared distances), and the
    codebooks after ``rounds`` rounds. ``rest`` is a struct of the columns in ``carry``; others are not read.

    Components become whole numbers ``floor(scale * x)``. Each part's codebook begins as that part of the ``entries`` smallest
    ids (null last, equal ids by their vectors); a round gives every part to its nearest entry, the lower among equals, and
    sets each used entry to ``floor(sum / count)``. Vectors that are null or hold a null or non-finite component are dropped,
    as are those of another length than the most frequent positive multiple of ``parts``. Repeated rows count each; fewer
    vectors than entries give shorter codebooks; an empty table gives an empty result. A component too large for exact
    arithmetic is an error.

    The driver gets the first entries and per round one sum per entry and part, both bounded by the parameters.
    """
    names = [id_column, "rest", "codes", "error"]
    kept = vectors.select(F.col(id_column).alias("id"), F.struct(*(carry or [F.lit(None).alias("none")])).alias("rest"), F.col(vector).alias("v")).filter(_finite(F.col("v")))
    sizes = kept.groupBy(F.size("v").alias("size")).count().filter((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("count"), "size").first()
    dim = sizes["size"] if sizes else parts
    kept = kept.filter(F.size("v") == dim).select("id", "rest", _whole(F.col("v"), scale).alias("whole"))
    first = kept.select("id", "whole").orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).collect()
    fields = kept.schema
    row = f"{id_column} {fields['id'].dataType.simpleString()}, rest {fields['rest'].dataType.simpleString()}, codes array<int>, error long"
    if not first:
        return Codes(vectors.sparkSession.createDataFrame([], row), np.zeros((parts, 0, 0), dtype=np.int64))
    codebooks = _cut(np.array([r["whole"] for r in first], dtype=np.int64), parts)

    cores = vectors.sparkSession.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() < cores:
        kept = kept.repartition(cores)
    most = max(1, min(block_rows, BLOCK_BYTES // (4 * dim)))
    block = f"ids array<{fields['id'].dataType.simpleString()}>, rests array<{fields['rest'].dataType.simpleString()}>, trees array<binary>"
    blocks = durable(kept.mapInArrow(_built(dim, parts, leaf, most), block))
    for _ in range(rounds):
        sums = blocks.select("trees").mapInArrow(_summed(codebooks), "part int, entry int, n long, total array<long>")
        moved = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(dim // parts)]).alias("total"))
        codebooks = codebooks.copy()
        for r in moved.collect():  # parts * entries rows at most
            codebooks[r["part"], r["entry"]] = np.array(r["total"], dtype=np.int64) // r["n"]
    return Codes(blocks.mapInArrow(_coded(codebooks, names), row), codebooks)
