"""Texts in bounded blocks, and questions that blocks put to hash buckets and get answered.

A block holds a few megabytes of neighbouring texts, so that tasks work on arrays instead of rows. What a block wants to
know about all other texts it asks in two shuffles: messages go to the bucket of their hash, the bucket answers each
block. Both sides of every message have a size bounded by the block's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
#: Stands for a null id, which comes after every other.
LAST = np.iinfo(np.int64).max

BLOCK_SCHEMA = "block long, ids array<long>, sizes array<long>, blob binary"


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


#: A random-looking 64-bit value for every byte, and the odd base of the polynomial.
BYTE_VALUES = np.array([_mixed(i) for i in range(256)], dtype=np.uint64)
BASE = _mixed(1000) | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2 ** 64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of a row of 64-bit symbols."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, the same wherever a range stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k symbols."""
    return mix((sums[k:] - sums[:-k]) * powers(len(sums))[1][: len(sums) - k])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Hashes of byte ranges in rising order, over bounded pieces of the data: sums of a random-looking value for each byte
    and its place in the range. Unlike a polynomial modulo 2 ** 64, whose values agree for whole families of long words
    whatever its base, such sums agree by chance only."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + step)))
        base, end = starts[a], ends[b - 1]
        sizes = np.append(starts[a + 1 : b], end) - starts[a:b]  # up to the next range, what lies between included
        place = np.arange(end - base) - np.repeat(starts[a:b] - base, sizes)
        sums = np.zeros(end - base + 1, dtype=np.uint64)
        np.cumsum(mix(BYTE_VALUES[data[base:end]] + place.astype(np.uint64) * np.uint64(BASE)), out=sums[1:])
        out[a:b] = mix(sums[ends[a:b] - base] - sums[starts[a:b] - base])
        a = b
    return out


@dataclass
class Block:
    block: int
    ids: np.ndarray  # LAST for null
    offsets: np.ndarray
    data: np.ndarray  # UTF-8 bytes of all texts
    answers: list
    rest: pa.Array | None

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @property
    def id_list(self) -> list:
        return [None if i == LAST else int(i) for i in self.ids]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], data


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def _packed(most: int, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            offsets, data = texts_of(batch)
            ids = batch.column(0)
            for a, b in slices(offsets, most):
                rest = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(2).slice(a, b - a))] if carried else []
                blob = zstandard.ZstdCompressor(level=3).compress(data[offsets[a] : offsets[b]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a)),
                        pa.array([np.diff(offsets[a : b + 1])], pa.list_(pa.int64())),
                        pa.array([blob], pa.binary()),
                        *rest,
                    ],
                    names=["block", "ids", "sizes", "blob", *["rest"] * carried],
                )
                number += 1

    return run


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Blocks ``block, ids, sizes, blob`` of a table; ids must be whole numbers. Columns named in ``carry`` travel along
    as structs in ``rest``, others are not read."""
    columns = [F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")]
    schema = BLOCK_SCHEMA
    if carry:
        columns.append(F.struct(*carry).alias("rest"))
        schema += f", rest array<{docs.select(columns[-1]).schema['rest'].dataType.simpleString()}>"
    return docs.select(*columns).mapInArrow(_packed(most, bool(carry)), schema)


def unpacked(batches: Iterator[pa.RecordBatch], *answers: str) -> Iterator[Block]:
    """The blocks of the batches with the answers of the named columns, each a list of rows."""
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            sizes = columns["sizes"][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = columns["ids"][i].values.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = zstandard.ZstdDecompressor().decompress(columns["blob"][i].as_buffer(), max_output_size=int(sizes.sum()) + 1)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            got = [columns[name][i].as_py() or [] for name in answers]
            rest = columns["rest"][i].values if "rest" in columns else None
            yield Block(columns["block"][i].as_py(), ids, offsets, np.frombuffer(raw, dtype=np.uint8), got, rest)


def placed(blocks: DataFrame) -> DataFrame:
    """The blocks written to the shared folder, dealt out by block, so that answers join them where they are.

    A checkpoint only remembers how its rows are dealt out when adaptive execution had no part in it.
    """
    conf = blocks.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return durable(blocks.repartition(int(conf.get("spark.sql.shuffle.partitions")), "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def bucket_count(n_bytes: int) -> int:
    """Buckets for the messages about so many bytes of text."""
    return max(32, -(-n_bytes // BUCKET_BYTES))


def ask(blocks: DataFrame, fn: Callable[[Block], Iterator[dict]], schema: str, *answers: str) -> DataFrame:
    """Messages of all blocks; ``fn`` yields dictionaries of columns for one block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches, *answers):
            for rows in fn(block):
                yield pa.RecordBatch.from_pydict(rows, schema=fields)

    return blocks.mapInArrow(run, schema)


def ask_texts(docs: DataFrame, fn: Callable[[Block], Iterator[dict]], schema: str, id_column: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """The messages that :func:`ask` has for the blocks of :func:`pack`, from the texts in one step: a task that packs and
    asks in two runs two Python workers at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    packed = _packed(most, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(packed(batches)):
            for rows in fn(block):
                yield pa.RecordBatch.from_pydict(rows, schema=fields)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def answer(messages: DataFrame, fn: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """Answers of all buckets; ``fn`` sees one bucket's messages and returns columns that name their block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(messages.sparkSession.createDataFrame([], schema).schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(fn(table), schema=fields)

    return messages.groupBy("bucket").applyInArrow(run, schema)


def attach(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``blocks`` with each block's answers as an array of structs."""
    own = answers.groupBy("block").agg(F.collect_list(F.struct(*[c for c in answers.columns if c != "block"])).alias(name))
    return blocks.join(own, "block", "left")


def grouped(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys and the starts of equal runs in it, closed by the length."""
    order = np.argsort(order_key, kind="stable")
    ordered = order_key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return order, np.append(starts, len(ordered))


def array_of(raw: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(raw or b"", dtype=kind)
