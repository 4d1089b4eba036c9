"""Repeated passages by words: seeds at winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidewire.llm.anchors import Row, by_place, find_repeats
from tidewire.llm.blocks import Block, prefix_sums, range_hash, word_hashes

WINDOW_WORDS = 50
SEED_WORDS = 20
BLOCK_BYTES = 4 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = "doc_id long, n_words long, n_removed long, kept string, removed array<array<long>>"


def words_of(block: Block) -> Row:
    """The words of a block as symbols: runs of bytes other than blanks, never over the end of a text."""
    solid = ~BLANK[block.data]
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[block.offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, block.offsets)
    hashes = word_hashes(block.data, starts, ends)
    return Row(len(starts), lambda a, b: hashes[a:b], bounds, starts, ends)


def differ(flat: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, step: int = 20_000) -> bool:
    """Whether any of the runs that begin at a and b differ."""
    steps = np.arange(length)
    return any((flat[a[i : i + step, None] + steps] != flat[b[i : i + step, None] + steps]).any() for i in range(0, len(a), step))


def _heads(rank: np.ndarray, key: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by rank and key, and for each row of it the one of the least id among its equals."""
    order = np.lexsort((least, key, rank))
    r, k = rank[order], key[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def extend(h: np.ndarray, left: np.ndarray, right: np.ndarray, around: list[bytes], least: np.ndarray, length: int, gram: int):
    """For each class of a bucket and each place of the window, the least id among classes that agree with it there.

    A window that begins ``p`` words before a seed agrees in two classes when both extend the seed alike by ``p`` words
    to the left and by the rest to the right.
    """
    rank = np.unique(h, return_inverse=True)[1].reshape(-1)
    words = [text.split() for text in around]
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], dtype=np.int64)
    # numbers are exact in this bucket; their polynomial hashes stand for whole extensions and are confirmed below
    sums = prefix_sums((flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1]
    out = []
    for place in range(length - gram + 1):
        fits = np.flatnonzero((left >= place) & (right >= length - gram - place))
        if not len(fits):
            continue
        at = begin[fits] + left[fits] - place
        key = range_hash(sums, at, at + length)
        order, head = _heads(rank[fits], key, least[fits])
        if differ(flat, at[order], at[order[head]], length):  # two windows share a hash: compare them in full
            exact: dict[bytes, int] = {}
            key = np.array([exact.setdefault(flat[a : a + length].tobytes(), len(exact)) for a in at.tolist()])
            order, head = _heads(rank[fits], key, least[fits])
        out.append((fits[order], np.full(len(order), place), least[fits][order][head]))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return by_place(*(np.concatenate([part[k] for part in out]) for k in range(3)))


def _finish(block: Block, row: Row, mask: np.ndarray) -> dict:
    out: dict[str, list] = {"doc_id": block.id_list, "n_words": np.diff(row.bounds).tolist(), "n_removed": [], "kept": [], "removed": []}
    for i in range(len(block.ids)):
        a, b = row.bounds[i], row.bounds[i + 1]
        gone = mask[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        kept = block.text(i)
        if gone.any():
            kept = b" ".join(w for w, g in zip(kept.split(), gone.tolist(), strict=True) if not g)
        out["n_removed"].append(int(gone.sum()))
        out["kept"].append(kept.decode("utf-8", "replace"))
        out["removed"].append(edges.reshape(-1, 2).tolist())
    return out


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, seed: int = SEED_WORDS, most: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept, removed`` and, as struct ``rest``, the columns of ``carry``.

    A word goes when a run of ``window`` words around it also begins in a row of a smaller id, judged on the input.
    ``kept`` is the text itself if nothing goes, else the other words joined by one blank; ``removed`` the maximal repeats as word ranges. Null and empty
    texts have no word and keep an empty text; texts below the window keep all. A null id counts as larger than all
    ids; rows of equal ids do not remove each other. Other columns are not read, an empty table gives no row.
    """
    return find_repeats(docs, id_column, text, words_of, extend, window, seed, most, _finish, SCHEMA, carry)
