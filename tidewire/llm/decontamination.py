"""Benchmark passages in training texts, found by binary search in suffix arrays over shards of the training words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import grouped, slices, texts_of, word_hashes

WINDOW_WORDS = 10
SHARD_BYTES = 4 << 20
#: Items travel to the tasks in parts of at most so many bytes of text, one pass over the shards for each part.
PART_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the bounds of each text among them."""
    data = LOWER[data]
    solid = IN_WORD[data]
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class SuffixArray:
    """Suffixes of the words of a shard, sorted by their first ``depth`` words or to the end of their text."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, depth: int):
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        n = len(words)
        self.n = n
        self.text_end = np.repeat(bounds[1:], np.diff(bounds))
        self.symbols = np.concatenate([numbers.reshape(-1) + 1, np.zeros(depth + 1, dtype=np.int64)])
        # Ranks by one word, then by twice as many in each round; only suffixes that still tie are sorted again.
        rank = numbers.reshape(-1).astype(np.int64)
        order, starts = grouped(rank)
        self.order = order
        first = np.repeat(starts[:-1], np.diff(starts))
        place = np.empty(n, dtype=np.int64)
        place[order] = first
        known = 1
        while known < depth and n:
            size = np.diff(np.append(starts[:-1], n))
            tied = np.repeat(size > 1, size)
            at = self.order[tied]
            if not len(at):
                break
            ahead = at + known
            inside = ahead < self.text_end[at]
            follow = np.where(inside, place[np.minimum(ahead, n - 1)] + 1, 0)
            own = place[at]
            by = np.lexsort((follow, own))
            at, follow, own = at[by], follow[by], own[by]
            slots = np.flatnonzero(tied)
            self.order[slots] = at
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
            head = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            fresh = place.copy()
            fresh[at] = head
            place = fresh
            is_start = np.zeros(n, dtype=bool)
            is_start[starts[:-1]] = True
            is_start[slots[new]] = True
            starts = np.append(np.flatnonzero(is_start), n)
            known *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray, right: bool) -> np.ndarray:
        """First place in [low, high) whose word at ``depth`` is not below (right: above) the symbol."""
        low, high = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            at = self.order[middle] + depth
            seen = np.where(at < self.text_end[self.order[middle]], self.symbols[at], 0)
            less = seen <= symbol[live] if right else seen < symbol[live]
            low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]

    def search(self, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the array whose suffixes begin with the ``lengths`` words of the queries at ``starts``."""
        spot = np.minimum(np.searchsorted(self.vocabulary, queries), max(0, len(self.vocabulary) - 1))
        known = np.where(self.vocabulary[spot] == queries, spot + 1, -1) if len(self.vocabulary) else np.full(len(queries), -1)
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n)
        for depth in range(int(lengths.max()) if len(lengths) else 0):
            live = np.flatnonzero((lengths > depth) & (low < high))
            if not len(live):
                break
            symbol = known[starts[live] + depth]
            a, b = low[live], high[live]
            low[live] = self._bound(a, b, depth, symbol, False)
            high[live] = self._bound(low[live], b, depth, symbol, True)
        return low, high


class Items:
    """Test items as words, with one query per suffix that holds a whole window."""

    def __init__(self, rows: list[tuple[int | None, str]], window: int):
        texts = [(text or "").encode() for _, text in rows]
        self.ids = [item for item, _ in rows]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.data, self.starts, self.ends, bounds = words_in(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        self.words = word_hashes(self.data, self.starts, self.ends)
        counts = np.diff(bounds)
        length = np.minimum(counts, window)
        suffixes = np.where(counts > 0, counts - length + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), suffixes)
        self.at = bounds[self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        self.length = length[self.item]
        self.end = bounds[self.item + 1] if len(self.item) else self.item


def _matches(shard: SuffixArray, items: Items, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and longest length in words of every occurrence of a query's window, confirmed by its bytes."""
    low, high = shard.search(items.words, items.at, items.length)
    many = np.maximum(high - low, 0)
    query = np.repeat(np.arange(len(many)), many)
    place = shard.order[np.repeat(low, many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)] if len(query) else query
    same = np.zeros(len(query), dtype=bool)
    for i, (q, p) in enumerate(zip(query.tolist(), place.tolist(), strict=True)):
        a, n = items.at[q], items.length[q]
        same[i] = n == 0 or _joined(data, starts[p : p + n], ends[p : p + n]) == _joined(items.data, items.starts[a : a + n], items.ends[a : a + n])
    query, place = query[same], place[same]
    length = items.length[query].copy()
    live = np.arange(len(query))
    while len(live):  # on to the longest verbatim match
        p, q = place[live] + length[live], items.at[query[live]] + length[live]
        on = (p < shard.text_end[place[live]]) & (q < items.end[query[live]])
        live, p, q = live[on], p[on], q[on]
        live = live[shard.vocabulary[shard.symbols[p] - 1] == items.words[q]]
        length[live] += 1
    return query, place, length


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _search(items: Broadcast, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Items(items.value, window)
        for batch in batches:
            offsets, data = texts_of(batch)
            for a, b in slices(offsets, SHARD_BYTES):
                own = offsets[a : b + 1] - offsets[a]
                part, starts, ends, bounds = words_in(data[offsets[a] : offsets[b]], own)
                shard = SuffixArray(word_hashes(part, starts, ends), bounds, window)
                query, place, length = _matches(shard, wanted, part, starts, ends)
                doc = np.searchsorted(bounds, place, side="right") - 1
                order = np.lexsort((query, place, doc))
                cut = np.searchsorted(doc[order], np.arange(b - a + 1))
                found: list[list[dict]] = []
                for i in range(b - a):
                    rows = order[cut[i] : cut[i + 1]]
                    found.append([
                        {"item_id": wanted.ids[wanted.item[q]], "at": int(p - bounds[i]), "words": int(n), "window": int(w)}
                        for q, p, n, w in zip(query[rows].tolist(), place[rows].tolist(), length[rows].tolist(), wanted.length[query[rows]].tolist(), strict=True)
                    ])
                old = batch.column(3).slice(a, b - a).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                        pa.array(np.diff(bounds), pa.int64()), pa.array([x + y for x, y in zip(old, found, strict=True)], batch.schema.field(3).type),
                        *[batch.column(k).slice(a, b - a) for k in range(4, batch.num_columns)],
                    ],
                    names=batch.schema.names,
                )

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, matches`` and, as struct ``rest``, the columns of ``carry``; a match has
    ``item_id, at, words, window``.

    A match is a place where a window of an item begins (``window`` words, or the whole of a shorter item), with the
    length of the longest verbatim match from there. Each task sorts the suffixes of its shards and looks up every
    suffix of the items. Items come as broadcasts of at most 16 MB each; a larger benchmark takes several passes over
    the shards, chained without a shuffle. Null texts, of documents and of items, have no words; an item with a null id
    matches under a null id; repeated items count once. Other columns are not read; an empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (PART_BYTES // 2)))
    kind = "array<struct<item_id: bigint, at: bigint, words: bigint, window: bigint>>"
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("bigint").alias("n_words"), F.expr(f"CAST(array() AS {kind})").alias("matches"), *([F.struct(*carry).alias("rest")] if carry else []))
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, text string, n_words bigint, matches {kind}"
    if carry:
        schema += f", rest {rows.schema['rest'].dataType.simpleString()}"
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.collect()])  # PART_BYTES at most
        rows = rows.mapInArrow(_search(held, window), schema)
    return rows.drop("text")


def hits(matches: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items``: the words inside any window, and the distinct items that have one there."""
    ordered = "array_sort(transform(matches, m -> struct(m.at AS at, m.at + m.window AS end)))"
    covered = f"aggregate({ordered}, struct(0L AS n, 0L AS upto), (a, m) -> struct(a.n + greatest(0L, m.end - greatest(m.at, a.upto)) AS n, greatest(a.upto, m.end) AS upto)).n"
    items = "array_sort(array_distinct(filter(transform(matches, m -> CAST(m.item_id AS string)), i -> i IS NOT NULL)))"
    return matches.select("doc_id", "n_words", F.expr(covered).alias("n_hit"), F.expr(items).alias("items"))
