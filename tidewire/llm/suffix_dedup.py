"""Repeated byte strings by hash-compared suffix sorting.

The suffixes that can take part in a repeat begin at winnowed anchors. In every bucket those of a gram are sorted with
a merge sort whose comparison finds the common extension by binary search over prefix polynomial hashes, so that it
costs the logarithm of the length; neighbours are then confirmed byte by byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidewire.llm.anchors import Row, by_place, find_repeats
from tidewire.llm.blocks import BASE, BYTE_VALUES, Block

WINDOW_BYTES = 50
GRAM_BYTES = 24
BLOCK_BYTES = 4 << 20

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>"


def bytes_of(block: Block) -> Row:
    return Row(len(block.data), lambda a, b: BYTE_VALUES[block.data[a:b]], block.offsets)


class Suffixes:
    """Byte strings of bounded length, one per row, with the hashes of all their prefixes."""

    def __init__(self, texts: np.ndarray):
        self.texts = texts
        n, width = texts.shape
        self.prefix = np.zeros((n, width + 1), dtype=np.uint64)
        for j in range(width):
            self.prefix[:, j + 1] = self.prefix[:, j] * np.uint64(BASE) + BYTE_VALUES[texts[:, j]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows a and b, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.texts.shape[1])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; equal rows by number."""
        n = self.common(a, b)
        at = np.minimum(n, self.texts.shape[1] - 1)
        x, y = self.texts[a, at], self.texts[b, at]
        return np.where(n == self.texts.shape[1], a < b, x < y)


def merge_sorted(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Row numbers sorted by group, then by suffix: a merge sort of all groups side by side.

    In each pass the runs of a group merge in pairs: every row finds its place in the partner run by binary search.
    """
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else order
    sizes = np.diff(np.append(starts, len(order)))
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    at = np.arange(len(order)) - begin
    width, most = 1, int(sizes.max()) if len(sizes) else 0
    while width < most:
        live = np.flatnonzero(size > width)
        own = at[live] // width
        partner = own ^ 1
        low = np.minimum(partner * width, size[live])
        high = np.minimum(low + width, size[live])
        first, row = low.copy(), order[live]
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) // 2
            other = order[begin[live] + np.minimum(middle, size[live] - 1)]
            less = suffixes.before(other, row)
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        to = begin[live] + (own // 2) * 2 * width + (at[live] - own * width) + (low - first)
        fresh = order.copy()
        fresh[to] = row
        order = fresh
        width *= 2
    return order


def ranks(texts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted row numbers and, for each but the first, the confirmed common extension with the row before (-1: other group)."""
    suffixes = Suffixes(texts)
    order = merge_sorted(suffixes, group)
    a, b = order[:-1], order[1:]
    common = suffixes.common(a, b)
    differ = texts[a] != texts[b]
    true = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    if not np.array_equal(common, true):  # two prefixes share a hash: sort by the bytes themselves
        order = np.lexsort((*texts.T[::-1], group))
        a, b = order[:-1], order[1:]
        differ = texts[a] != texts[b]
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    return order, np.concatenate([[-1], np.where(group[a] == group[b], true, -1)]) if len(order) else true


def _classes(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Number of the set of rows of a group that agree in their first n bytes."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < n)
    return out


def sorted_repeats(h: np.ndarray, left: np.ndarray, right: np.ndarray, around: list[bytes], least: np.ndarray, length: int, gram: int):
    """For each class of a bucket and each place of the window, the least id among the classes with the same window.

    The suffixes from the gram on and the reversed ones before it are sorted; windows at a place are equal when the
    extensions to the right and to the left both reach far enough.
    """
    reach = length - gram
    group = np.unique(h, return_inverse=True)[1].reshape(-1)
    flat = np.frombuffer(b"".join(around), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in around])])[:-1]
    out = []
    # the gram itself was only compared by hash: its bytes are the first of the suffix
    steps = np.arange(gram + reach)
    to_right = np.where(steps < (gram + right)[:, None], flat[np.minimum(begin[:, None] + left[:, None] + steps, len(flat) - 1)], 0) if len(flat) else np.zeros((0, gram + reach), np.uint8)
    steps = np.arange(reach)
    to_left = np.where(steps < left[:, None], flat[np.maximum(begin[:, None] + left[:, None] - 1 - steps, 0)], 0) if len(flat) else np.zeros((0, reach), np.uint8)
    right_order, right_common = ranks(to_right.astype(np.uint8), group)
    left_order, left_common = ranks(to_left.astype(np.uint8), group)
    for place in range(reach + 1):
        fits = np.flatnonzero((left >= place) & (right >= reach - place))
        if not len(fits):
            continue
        x = _classes(right_order, right_common, gram + reach - place)[fits]
        y = _classes(left_order, left_common, place)[fits]
        key = x * (len(h) + 1) + y
        order = np.lexsort((least[fits], key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        out.append((fits[order], np.full(len(order), place), least[fits][order][head]))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    return by_place(*(np.concatenate([part[k] for part in out]) for k in range(3)))


def _finish(block: Block, row: Row, mask: np.ndarray) -> dict:
    out: dict[str, list] = {"doc_id": block.id_list, "n_bytes": np.diff(block.offsets).tolist(), "n_removed": [], "n_spans": [], "kept": [], "removed": []}
    for i in range(len(block.ids)):
        a, b = block.offsets[i], block.offsets[i + 1]
        gone = mask[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(len(edges) // 2)
        out["kept"].append(block.data[a:b][~gone].tobytes())
        out["removed"].append(edges.reshape(-1, 2).tolist())
    return out


def remove_strings(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, most: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept, removed``.

    A byte goes when a string of ``window`` bytes around it also begins in a row of a smaller id, judged on the input;
    matches never run over the end of a text. ``kept`` has the other bytes (a cut may fall inside a character),
    ``removed`` the maximal removed runs as byte ranges. Null and empty texts have 0 bytes; texts below the window keep
    all. A null id counts as larger than all ids; rows of equal ids do not remove each other. Other columns are not
    read, an empty table gives no row.
    """
    return find_repeats(docs, id_column, text, bytes_of, sorted_repeats, window, gram, most, _finish, SCHEMA)
