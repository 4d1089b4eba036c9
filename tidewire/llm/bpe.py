"""Byte-level BPE through a table of distinct words: every word is encoded once and its ids join back by position."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import Block, answer, array_of, ask_texts, attach, bucket_count, pack, unpacked, word_hashes

BLOCK_BYTES = 3 << 20
#: Bytes and words of a block that are worked on at a time.
SLICE_BYTES = 1 << 18
SLICE_WORDS = 1 << 16
BETWEEN = re.compile(rb"[A-Za-z](?= [A-Za-z])")
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4

WORDS = "bucket long, block long, sum long, words binary"
IDS = "block long, bucket long, sum long, ids binary"


def _alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE tokenizer file: its library object, its pieces as bytes, and its classes of characters."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only byte-level BPE files without normaliser and prefix blank are taken")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks or need word borders are not taken")
        self.special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        alphabet = _alphabet()
        size = self.library.get_vocab_size()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [added[i] if i in added else bytes(alphabet[c] for c in self.library.id_to_token(i)) for i in range(size)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self._classes = np.zeros(0x110000, dtype=np.uint8)

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, blank or other, for each code point, as the library's own splitting has it.

        A code point is looked up in the library when it is first seen: next to ``a``, ``1`` or ``!`` it makes one
        piece only with its own kind.
        """
        out = self._classes[points]
        unknown = np.unique(points[out == 0])
        for point in unknown.tolist():
            split = self.library.pre_tokenizer.pre_tokenize_str
            alike = [len(split(other + chr(point))) == 1 for other in "a1!"]
            self._classes[point] = LETTER if alike[0] else NUMBER if alike[1] else OTHER if alike[2] else BLANK
        return self._classes[points] if len(unknown) else out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number per word."""
        found = [e.ids for at in range(0, len(words), 4096) for e in self.library.encode_batch([w.decode("utf-8", "replace") for w in words[at : at + 4096]], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=self.kind), np.array([len(ids) for ids in found], dtype=np.uint32)


def _settled(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, bytes that are not UTF-8 replaced as Python reads them."""
    try:
        block.data.tobytes().decode("utf-8")
        return block.data, block.offsets
    except UnicodeDecodeError:
        texts = [block.text(i).decode("utf-8", "replace").encode() for i in range(len(block.ids))]
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def split_words(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Byte positions of the starts of all words of all texts; ends are the next starts.

    The words of a byte-level vocabulary: English contractions; letters, numbers or others in a row, with one blank
    before them; blanks in a row, without the last before a word. Added tokens are words of their own and end others.
    """
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(at, offsets)] = True
    added = []
    for token in vocabulary.special:
        spot = raw.find(token)
        while spot >= 0:
            text = int(np.searchsorted(offsets, spot, side="right"))
            if spot + len(token) <= offsets[text] and not any(a < spot + len(token) and spot < b for a, b in added):
                added.append((spot, spot + len(token)))
                spot = raw.find(token, spot + len(token))
            else:
                spot = raw.find(token, spot + 1)
    spans = [(int(np.searchsorted(at, a)), int(np.searchsorted(at, b))) for a, b in added]
    for a, b in spans:
        edge[[a, b]] = True
    kind = vocabulary.classes(points)
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    blank = kind[begin] == BLANK if n else np.zeros(0, dtype=bool)
    before_word = blank & ~edge[end]  # a word of the same text follows
    last = end[before_word] - 1
    start[last] = True
    joined = last[points[last] == 32] + 1
    start[joined] = False
    # contractions: a lone apostrophe that begins a word, before one of the endings
    lone = begin[(points[begin] == 39) & (end - begin == 1) & ~edge[end] & start[begin]] if n else begin
    for lower, width in ((("s", "t", "m", "d"), 1), (("re", "ve", "ll"), 2)):
        for ending in lower:
            hit = lone[lone + width < n]
            for k, c in enumerate(ending):
                hit = hit[(points[hit + 1 + k] == ord(c)) & ((k == 0) | ~edge[hit + 1 + k])]
            start[hit + 1] = False
            after = hit + 1 + width
            after = after[(after < n)]
            start[after[(kind[after] == LETTER) & ~edge[after]]] = True
    for a, b in spans:
        start[a + 1 : b] = False
    return at[np.flatnonzero(start)]


def cuts(raw: bytes, offsets: np.ndarray, vocabulary: Vocabulary, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that cut no word: they end with a text, or inside a text before a blank between two
    letters (unless an added token holds a blank). A text without such a place is one range."""
    inside = not any(b" " in token for token in vocabulary.special)
    a = 0
    while a < len(raw):
        b = len(raw)
        if a + most < b:
            b = int(offsets[np.searchsorted(offsets, a + most)])
            gap = BETWEEN.search(raw, a + most - 1, b) if inside else None
            b = gap.end() if gap else b
        yield a, b
        a = b


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words that tile the data, from their starts: numbers of the first of each, and for each word the place of its like
    among those. Words are sorted by hash and compared byte by byte with the first of their hash."""
    ends = np.append(starts[1:], len(data))
    sizes = ends - starts
    _, first, like = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = like.reshape(-1)
    same = (sizes == sizes[first][like]).all()
    if same:
        there = np.repeat(starts[first][like] - starts, sizes) + np.arange(len(data))
        same = (data[there] == data).all()
    if not same:  # different words of one hash
        raw, number = data.tobytes(), {}
        like = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
        _, first = np.unique(like, return_index=True)
    return first, like


class Words:
    """The words of a block, by distinct word: sorted by bucket, then by bytes. The block is worked through in slices."""

    def __init__(self, block: Block, vocabulary: Vocabulary, n: int):
        data, offsets = _settled(block)
        raw = data.tobytes()
        number: dict[bytes, int] = {}
        which, starts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for a, b in cuts(raw, offsets, vocabulary):
            texts = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)] - a
            own = split_words(data[a:b], np.concatenate([[0], texts, [b - a]]), vocabulary)
            first, like = distinct_words(data[a:b], own)
            begin = (own + a).tolist() + [b]
            names = [number.setdefault(raw[begin[k] : begin[k + 1]], len(number)) for k in first.tolist()]
            which.append(np.array(names, dtype=np.int32)[like])
            starts.append(own + a)
        words = list(number)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        buckets = (hashes % np.uint64(n)).astype(np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        order = np.array(order, dtype=np.int64)[np.argsort(buckets[order], kind="stable")]
        self.words = [words[i] for i in order.tolist()]
        self.hashes, self.buckets = hashes[order], buckets[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.which = place[np.concatenate(which)]
        #: first word of each text, closed by their number
        self.bounds = np.searchsorted(np.concatenate(starts), offsets)

    def parts(self) -> Iterator[tuple[int, int, int, int]]:
        """Bucket, range of words, and a checksum of the range."""
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], self.buckets, [-1]]))) if len(self.buckets) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(self.buckets[a]), a, b, int(np.bitwise_xor.reduce(self.hashes[a:b]).astype(np.int64))


def _ask_words(path: str, n: int):
    def run(block: Block) -> Iterator[dict]:
        words = Words(block, Vocabulary.at(path), n)
        for bucket, a, b, total in words.parts():
            some = words.words[a:b]
            raw = np.array([len(some), *map(len, some)], dtype=np.uint32).tobytes() + b"".join(some)
            yield {"bucket": [bucket], "block": [block.block], "sum": [total], "words": [zstandard.ZstdCompressor(level=6).compress(raw)]}

    return run


def _tell_ids(path: str):
    def run(table: pa.Table) -> dict:
        """Each distinct word of a bucket is encoded once, for all blocks that ask."""
        number: dict[bytes, int] = {}
        asked = []
        for packed in table.column("words").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(packed)
            count = int(np.frombuffer(raw[:4], dtype=np.uint32)[0])
            ends = 4 + 4 * count + np.cumsum(np.frombuffer(raw[4 : 4 + 4 * count], dtype=np.uint32).astype(np.int64))
            begins = [4 + 4 * count, *ends[:-1].tolist()]
            asked.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begins, ends.tolist(), strict=True)], dtype=np.int64))
        ids, counts = Vocabulary.at(path).encode(list(number))
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        out: dict[str, list] = {"block": table.column("block").to_pylist(), "bucket": table.column("bucket").to_pylist(), "sum": table.column("sum").to_pylist(), "ids": []}
        for words in asked:
            raw = counts[words].tobytes() + ids[_gather(upto, words)[0]].tobytes()
            out["ids"].append(zstandard.ZstdCompressor(level=6).compress(raw))
        return out

    return run


def _gather(upto: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of the chosen groups, one after the other, and the number of items of each."""
    many = upto[which + 1] - upto[which]
    if not len(many):
        return np.zeros(0, dtype=np.int64), many
    step = np.ones(int(many.sum()), dtype=np.int64)
    ends = np.cumsum(many)
    some = many > 0
    first = (ends - many)[some]
    begin = upto[which][some]
    step[first] = begin
    step[first[1:]] -= begin[:-1] + many[some][:-1] - 1
    return np.cumsum(step), many


def _with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """The blocks one by one, with their answers as they came."""
    for batch in batches:
        column = batch.column("told")
        for i in range(batch.num_rows):
            answers = pa.RecordBatch.from_struct_array(column.slice(i, 1).flatten())
            for block in unpacked([batch.slice(i, 1)]):
                yield block, answers


def _finish(path: str, n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        lengths = np.array([len(p) for p in vocabulary.pieces], dtype=np.int64)
        piece_upto = np.concatenate([[0], np.cumsum(lengths)])
        piece_bytes = np.frombuffer(b"".join(vocabulary.pieces), dtype=np.uint8)
        for block, told in _with_answers(batches):
            words = Words(block, vocabulary, n)
            line_of = {bucket: k for k, bucket in enumerate(told.column("bucket").to_pylist())}
            all_ids, all_counts = [], []
            for bucket, a, b, total in words.parts():
                line = line_of.get(bucket)
                if line is None or told.column("sum")[line].as_py() != total:  # the question was another one: encode here
                    ids, counts = vocabulary.encode(words.words[a:b])
                else:
                    raw = zstandard.ZstdDecompressor().decompress(told.column("ids")[line].as_buffer())
                    counts, ids = array_of(raw[: 4 * (b - a)], np.uint32), array_of(raw[4 * (b - a) :], vocabulary.kind)
                all_ids.append(ids)
                all_counts.append(counts)
            ids = np.concatenate([*all_ids, np.zeros(0, dtype=vocabulary.kind)])
            upto = np.concatenate([[0], np.cumsum(np.concatenate([*all_counts, np.zeros(0, dtype=np.uint32)]), dtype=np.int64)])
            # the join with the pieces, for each distinct word
            piece, sizes = _gather(piece_upto, ids.astype(np.int64))
            word_bytes = piece_bytes[piece]
            word_upto = np.concatenate([[0], np.cumsum(sizes)])[upto]
            # words by position
            tokens, token_upto = _by_position(ids, upto, words)
            decoded, text_upto = _by_position(word_bytes, word_upto, words)
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(text_upto), pa.py_buffer(decoded)])
            columns = [
                pa.array(block.id_list, pa.int64()), pa.array(np.diff(token_upto), pa.int64()),
                pa.ListArray.from_arrays(pa.array(token_upto.astype(np.int32)), pa.array(tokens.astype(np.int32))), decoded.cast(pa.large_string()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _by_position(items: np.ndarray, upto: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The items of all words in the order of the texts, and where each text's begin."""
    many = upto[1:] - upto[:-1]
    sizes = np.concatenate([[0], np.cumsum(many[words.which])])
    out = np.empty(int(sizes[-1]), dtype=items.dtype)
    for a in range(0, len(words.which), SLICE_WORDS):
        b = min(a + SLICE_WORDS, len(words.which))
        out[sizes[a] : sizes[b]] = items[_gather(upto, words.which[a:b])[0]]
    return out, sizes[words.bounds].astype(np.int64)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, decoded``.

    The ids are those of the library for the whole text, without added begin or end tokens; strings of added tokens
    inside a text count as those tokens. ``decoded`` is put together from the pieces of the ids. Null and empty texts
    have no token and decode to an empty text. Blocks of texts ask for the ids of their distinct words; every distinct
    word of the corpus is encoded in one bucket. Rows with equal ids stay rows of their own, other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = bucket_count(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    blocks = pack(docs, id_column, text, most)
    told = answer(ask_texts(docs, _ask_words(path, n), WORDS, id_column, text, most), _tell_ids(path), IDS)
    schema = "doc_id long, n_tokens long, ids array<int>, decoded string"
    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return attach(blocks, told, "told").mapInArrow(_finish(path, n, fields), schema)
