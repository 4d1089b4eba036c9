"""Winnowed anchors: which windows of a corpus can repeat, without a row per window.

Every window of ``length`` symbols has one or more anchors, the grams of ``gram`` symbols with the least hash in it.
Equal windows have equal anchors at equal places. Blocks ask which of their anchors occur in other texts, send the
surroundings of those only, and get back, for each place of a window around an anchor, the least document id that has
the same window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import LAST, Block, answer, array_of, ask, attach, bucket_count, gram_hash, grouped, pack, placed, prefix_sums, range_hash, unpacked
from tidewire.session import durable

STEP = 1 << 19

ASK_SHARED = "bucket long, block long, grams binary, copies binary, ids binary"
SHARED = "block long, bucket long, grams binary, copies binary, ids binary"
ASK_LEAST = "bucket long, block long, grams binary, low binary, high binary, left binary, right binary, sizes binary, around binary"
LEAST = "block long, bucket long, classes binary, first binary, last binary, ids binary"


class Row:
    """The symbols of one block: their number, 64-bit values by range, the bounds of each text among them, and the bytes
    that each symbol stands for (None: symbols are bytes)."""

    def __init__(self, n: int, part: Callable[[int, int], np.ndarray], bounds: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.n, self.part, self.bounds, self.starts, self.ends = n, part, bounds, starts, ends

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def _slid(values: np.ndarray, width: int, keep) -> np.ndarray:
    """Least or greatest value of every run of ``width``."""
    span = 1
    while 2 * span <= width:
        values = keep(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return keep(values[:-rest], values[rest:]) if rest else values


def anchors(row: Row, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie inside one text."""
    places, hashes = [], []
    width, n = length - gram + 1, row.n
    for a in range(0, n - length + 1, STEP):
        part = row.part(a, min(n, a + STEP + length - 1))
        grams = gram_hash(prefix_sums(part), gram) | np.uint64(1)
        least = _slid(grams, width, np.minimum).copy()
        # windows that run over the end of a text have no anchor
        cuts = row.bounds[(row.bounds > a) & (row.bounds < a + len(part))] - a
        over = np.zeros(len(least) + 1, dtype=np.int32)
        np.add.at(over, np.minimum(np.maximum(cuts - length + 1, 0), len(least)), 1)
        np.add.at(over, np.minimum(cuts, len(least)), -1)
        least[np.cumsum(over[:-1]) > 0] = 0
        padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
        padded[width - 1 : width - 1 + len(least)] = least
        found = np.flatnonzero(_slid(padded, width, np.maximum) == grams)
        places.append(found + a)
        hashes.append(grams[found])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:  # a place near a border was found on both sides
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return at, h


def _copy_keys(block: Block) -> np.ndarray:
    """128 bits of each text as two columns."""
    digests = b"".join(hashlib.blake2b(block.text(i), digest_size=16).digest() for i in range(len(block.ids)))
    return np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)


def _by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order, starts = grouped(keys % np.uint64(n))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield int(keys[order[a]] % np.uint64(n)), order[a:b]


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The 32 bits of a gram's hash that go to its bucket; a chance agreement only makes one more candidate."""
    return ((keys // np.uint64(n)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _ask_shared(rows: Callable[[Block], Row], length: int, gram: int, n: int):
    def run(block: Block) -> Iterator[dict]:
        _, hashes = anchors(rows(block), length, gram)
        keys = np.unique(hashes)
        copies = _copy_keys(block)
        for_copies = dict(_by_bucket(copies[:, 0], n)) if len(copies) else {}
        for_grams = dict(_by_bucket(keys, n)) if len(keys) else {}
        for bucket in sorted(for_copies.keys() | for_grams.keys()):
            g, c = for_grams.get(bucket, np.zeros(0, dtype=np.int64)), for_copies.get(bucket, np.zeros(0, dtype=np.int64))
            yield {
                "bucket": [bucket], "block": [block.block], "grams": [np.sort(_low(keys[g], n)).tobytes()],
                "copies": [copies[c].tobytes()], "ids": [block.ids[c].tobytes()],
            }

    return run


def _tell_shared(table: pa.Table) -> dict:
    """Grams that several blocks have, and the least id of each text that occurs more than once."""
    blocks = table.column("block").to_numpy()
    grams = [array_of(x, np.uint32) for x in table.column("grams").to_pylist()]
    copies = [array_of(x, np.uint64).reshape(-1, 2) for x in table.column("copies").to_pylist()]
    ids = [array_of(x, np.int64) for x in table.column("ids").to_pylist()]
    bucket = table.column("bucket")[0].as_py()
    keys, owner = np.concatenate(grams), np.repeat(np.arange(len(blocks)), [len(g) for g in grams])
    order, starts = grouped(keys)
    many = np.repeat(np.diff(starts) > 1, np.diff(starts))
    shared_keys, shared_owner = keys[order][many], owner[order][many]
    texts, text_owner, text_ids = np.concatenate(copies), np.repeat(np.arange(len(blocks)), [len(c) for c in copies]), np.concatenate(ids)
    copied = np.zeros(0, dtype=np.int64)
    least = text_ids
    if len(texts):
        by = np.lexsort((text_ids, texts[:, 1], texts[:, 0]))
        new = np.concatenate([[True], (texts[by][1:] != texts[by][:-1]).any(axis=1)])
        first = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        least = np.empty_like(text_ids)
        least[by] = text_ids[by][first]
        size = np.bincount(np.cumsum(new) - 1)
        copied = np.sort(by[np.repeat(size > 1, size)])
    out: dict[str, list] = {"block": [], "bucket": [], "grams": [], "copies": [], "ids": []}
    g_order, c_order = np.argsort(shared_owner, kind="stable"), copied[np.argsort(text_owner[copied], kind="stable")]
    g_cut = np.searchsorted(shared_owner[g_order], np.arange(len(blocks) + 1))
    c_cut = np.searchsorted(text_owner[c_order], np.arange(len(blocks) + 1))
    for k in range(len(blocks)):
        g, c = g_order[g_cut[k] : g_cut[k + 1]], c_order[c_cut[k] : c_cut[k + 1]]
        if len(g) or len(c):
            values = (int(blocks[k]), bucket, shared_keys[g].tobytes(), texts[c].tobytes(), least[c].tobytes())
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
    return out


class Candidates:
    """What is left of a block once it knows the shared grams: its copies, and its anchors that may repeat, by class.

    A class is a gram with its surroundings, up to the farthest window that holds it; equal classes of a block are
    one. ``sent`` lists, per bucket, the classes in the order in which they were sent.
    """

    def __init__(self, block: Block, row: Row, length: int, gram: int, n: int):
        docs = len(block.ids)
        self.least_copy = np.full(docs, LAST)
        keys = _copy_keys(block)
        known = {}
        shared = []
        for got in block.answers[0]:
            for key, least in zip(array_of(got["copies"], np.uint64).reshape(-1, 2).tolist(), array_of(got["ids"], np.int64).tolist(), strict=True):
                known[tuple(key)] = least
            shared.append((got["bucket"], array_of(got["grams"], np.uint32)))
        for i, key in enumerate(keys.tolist()):
            self.least_copy[i] = known.get(tuple(key), LAST)
        # a copy of an earlier text repeats it throughout; equal rows of the least id stay, one of them speaks for all
        self.copied = self.least_copy < block.ids
        silent = self.copied.copy()
        spoken = set()
        for i in np.flatnonzero((self.least_copy == block.ids) & ~silent):
            if tuple(keys[i].tolist()) in spoken:
                silent[i] = True
            spoken.add(tuple(keys[i].tolist()))
        self.twin = {tuple(keys[i].tolist()): i for i in np.flatnonzero(~silent)[::-1]}
        self.speaker = np.array([self.twin.get(tuple(k), i) for i, k in enumerate(keys.tolist())], dtype=np.int64)
        at, h = anchors(row, length, gram)
        doc = row.doc_of(at)
        wanted = ~silent[doc]
        at, h, doc = at[wanted], h[wanted], doc[wanted]
        # shared with another block, or between two texts of this one
        maybe = np.zeros(len(h), dtype=bool)
        low, bucket = _low(h, n), (h % np.uint64(n)).astype(np.int64)
        if shared:
            known_keys = np.concatenate([(np.uint64(b) << np.uint64(32)) | g.astype(np.uint64) for b, g in shared])
            known_keys.sort()
            own = (bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
            if len(known_keys):
                spot = np.minimum(np.searchsorted(known_keys, own), len(known_keys) - 1)
                maybe |= known_keys[spot] == own
        order, starts = grouped(h)
        if len(order):
            first, last = np.minimum.reduceat(doc[order], starts[:-1]), np.maximum.reduceat(doc[order], starts[:-1])
            inside = np.empty(len(h), dtype=bool)
            inside[order] = np.repeat(first != last, np.diff(starts))
            maybe |= inside
        self.at, self.h, self.doc, bucket = at[maybe], h[maybe], doc[maybe], bucket[maybe]
        reach = length - gram
        self.left = np.minimum(self.at - row.bounds[self.doc], reach)
        self.right = np.minimum(row.bounds[self.doc + 1] - self.at - gram, reach)
        around = np.zeros(len(self.at), dtype=np.uint64)
        for a in range(0, row.n, STEP):  # places are in order
            some = slice(*np.searchsorted(self.at, [a, a + STEP]))
            low_end = max(0, a - reach)
            sums = prefix_sums(row.part(low_end, min(row.n, a + STEP + gram + reach)))
            around[some] = range_hash(sums, self.at[some] - self.left[some] - low_end, self.at[some] + gram + self.right[some] - low_end)
        keys = (self.right, self.left, around, self.h, bucket)
        order = np.lexsort(keys)
        new = np.zeros(len(order), dtype=bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        chosen = order[new]  # one anchor of each class; classes are sorted by bucket
        self.kind = np.empty(len(order), dtype=np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.chosen = chosen
        ids = block.ids[self.doc]
        self.low, self.high = np.full(len(chosen), LAST), np.full(len(chosen), -LAST - 1)
        np.minimum.at(self.low, self.kind, ids)
        np.maximum.at(self.high, self.kind, ids)
        self.bucket = bucket[chosen]

    def first_of(self, bucket: int) -> int:
        return int(np.searchsorted(self.bucket, bucket))


def _ask_least(rows: Callable[[Block], Row], length: int, gram: int, n: int):
    def run(block: Block) -> Iterator[dict]:
        row = rows(block)
        c = Candidates(block, row, length, gram, n)
        _, cuts = grouped(c.bucket)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pick = c.chosen[a:b]
            start, end = c.at[pick] - c.left[pick], c.at[pick] + gram + c.right[pick]
            if row.starts is not None:
                start, end = row.starts[start], row.ends[end - 1]
            around = b"".join(block.data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True))
            yield {
                "bucket": [int(c.bucket[a])], "block": [block.block], "grams": [c.h[pick].tobytes()], "low": [c.low[a:b].tobytes()],
                "high": [c.high[a:b].tobytes()], "left": [c.left[pick].astype(np.uint16).tobytes()], "right": [c.right[pick].astype(np.uint16).tobytes()],
                "sizes": [(end - start).astype(np.uint32).tobytes()], "around": [zstandard.ZstdCompressor(level=3).compress(around)],
            }

    return run


def _tell_least(solve: Callable, length: int, gram: int):
    def run(table: pa.Table) -> dict:
        """Least ids by window place for every class that was sent; equal classes of different blocks are solved once."""
        blocks = table.column("block").to_numpy()
        read = lambda name, kind: [array_of(x, kind) for x in table.column(name).to_pylist()]
        grams, low, high = read("grams", np.uint64), read("low", np.int64), read("high", np.int64)
        counts = [len(g) for g in grams]
        left, right = (np.concatenate(read(name, np.uint16)).astype(np.int64) for name in ("left", "right"))
        around: list[bytes] = []
        for raw, sizes in zip(table.column("around").to_pylist(), read("sizes", np.uint32), strict=True):
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            text = zstandard.ZstdDecompressor().decompress(raw, max_output_size=(ends[-1] if ends else 0) + 1)
            around += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        h, low, high = np.concatenate(grams), np.concatenate(low), np.concatenate(high)
        number: dict[tuple, int] = {}
        kind = np.array([number.setdefault(key, len(number)) for key in zip(h.tolist(), left.tolist(), around, strict=True)], dtype=np.int64)
        first = np.zeros(len(number), dtype=np.int64)
        first[kind[::-1]] = np.arange(len(kind))[::-1]
        least = np.full(len(number), LAST)
        np.minimum.at(least, kind, low)
        # rows: class, first and last place of the window before the gram, least id
        cls, begin, end, ids = solve(h[first], left[first], right[first], [around[i] for i in first], least, length, gram)
        order, starts = grouped(cls)
        per = np.zeros(len(number) + 1, dtype=np.int64)
        if len(order):
            np.add.at(per, cls, 1)
        upto = np.concatenate([[0], np.cumsum(per[: len(number)])])
        many = per[kind]
        asked = np.repeat(np.arange(len(kind)), many)
        within = np.arange(len(asked)) - np.repeat(np.cumsum(many) - many, many)
        line = order[upto[kind[asked]] + within] if len(asked) else np.zeros(0, dtype=np.int64)
        useful = ids[line] < high[asked]
        asked, line = asked[useful], line[useful]
        ends = np.cumsum(counts)
        cut = np.searchsorted(asked, np.concatenate([[0], ends]))
        out: dict[str, list] = {"block": [], "bucket": [], "classes": [], "first": [], "last": [], "ids": []}
        for k in range(len(blocks)):
            a, b = cut[k], cut[k + 1]
            if b > a:
                values = (
                    int(blocks[k]), table.column("bucket")[0].as_py(), (asked[a:b] - (ends[k] - counts[k])).astype(np.uint32).tobytes(),
                    begin[line[a:b]].astype(np.uint16).tobytes(), end[line[a:b]].astype(np.uint16).tobytes(), ids[line[a:b]].tobytes(),
                )
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
        return out

    return run


def by_place(cls: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (class, place, id) as runs of neighbouring places of a class with the same id."""
    order = np.lexsort((place, cls))
    cls, place, ids = cls[order], place[order], ids[order]
    if not len(cls):
        return cls, place, place, ids
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1] + 1)])
    start = np.flatnonzero(new)
    return cls[start], place[start], place[np.append(start[1:], len(cls)) - 1], ids[start]


def repeated(block: Block, row: Row, length: int, gram: int, n: int) -> np.ndarray:
    """Mask of the symbols that windows of smaller ids cover; the block has the answers to both questions."""
    c = Candidates(block, row, length, gram, n)
    marks = np.zeros(row.n + 1, dtype=np.int32)
    order, starts = grouped(c.kind)
    for got in block.answers[1]:
        cls = array_of(got["classes"], np.uint32).astype(np.int64) + c.first_of(got["bucket"])
        first, last, ids = array_of(got["first"], np.uint16).astype(np.int64), array_of(got["last"], np.uint16).astype(np.int64), array_of(got["ids"], np.int64)
        many = starts[cls + 1] - starts[cls]
        line = np.repeat(np.arange(len(cls)), many)
        own = order[np.repeat(starts[cls], many) + np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)]
        hit = ids[line] < block.ids[c.doc[own]]
        own, line = own[hit], line[hit]
        np.add.at(marks, c.at[own] - last[line], 1)
        np.add.at(marks, c.at[own] - first[line] + length, -1)
    mask = np.cumsum(marks[:-1], dtype=np.int32) > 0
    for i in range(len(block.ids)):
        a, b = row.bounds[i], row.bounds[i + 1]
        if c.copied[i]:
            mask[a:b] = b - a >= length
        elif c.speaker[i] != i:
            mask[a:b] = mask[row.bounds[c.speaker[i]] : row.bounds[c.speaker[i] + 1]]
    return mask


def find_repeats(docs: DataFrame, id_column: str, text: str, rows: Callable[[Block], Row], solve: Callable, length: int, gram: int, most: int, finish: Callable, schema: str, carry: list[str] | None = None) -> DataFrame:
    """Run both questions over all blocks; ``finish(block, row, mask)`` gives the result columns of one block, to which
    the struct ``rest`` of the carried columns is added."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = bucket_count(size)
    blocks = placed(pack(docs, id_column, text, most, carry))
    shared = durable(answer(ask(blocks, _ask_shared(rows, length, gram, n), ASK_SHARED), _tell_shared, SHARED))
    knowing = attach(blocks, shared, "shared")
    told = answer(ask(knowing, _ask_least(rows, length, gram, n), ASK_LEAST, "shared"), _tell_least(solve, length, gram), LEAST)
    both = attach(knowing, told, "least")

    from pyspark.sql.pandas.types import to_arrow_schema

    if carry:
        schema += f", rest {docs.select(F.struct(*carry).alias('rest')).schema['rest'].dataType.simpleString()}"
    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches, "shared", "least"):
            row = rows(block)
            columns = finish(block, row, repeated(block, row, length, gram, n))
            if carry:
                columns["rest"] = block.rest
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns[f.name], list) else columns[f.name].cast(f.type) for f in fields], schema=fields)

    return both.mapInArrow(run, schema)
