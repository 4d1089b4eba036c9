"""Spelling variants: words one edit apart, found by scanning sorted word lists with reused rows of a banded edit matrix.

A word looks for the near words behind it in two sorted lists. In the list of words it scans only those that begin with its
own first half, in the list of reversed words those that end with its own second half: one edit leaves one half as it is.
While scanning, rows of the edit matrix are kept for the prefix that neighbours of the list share, and a prefix that is
already two edits away skips the whole range of words that begin with it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: Words of one shard of a sorted list, and queries that one task takes to it.
SHARD_WORDS = 20_000
#: Entries of the directory of shards at most; with more words the shards get longer instead.
MAX_SHARDS = 4096
_END = "\U0010ffff"
_CLOSE = "\0\0\0"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy_runs(docs: DataFrame, every: int = 31, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row ``word`` per maximal run of letters that has ``min_length`` code points or more after the planted typos: of a
    run whose checksum with its document's id is divisible by ``every``, one code point is missing.

    A null text has no runs; a null id counts as the text ``null``. Runs too short to give a word are never made rows."""
    runs = F.regexp_extract_all(lower_ascii(F.col(text).cast("string")), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    mark, length = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.char_length("run")
    at = (F.col("mark") % F.col("length")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("length")))
    marked = rows.withColumns({"mark": mark, "length": length.cast("bigint")})
    word = F.when(F.col("mark") % every == 0, cut).otherwise(F.col("run"))
    return marked.select(word.alias("word")).filter(F.char_length("word") >= min_length)


def vocabulary(words: DataFrame, word: str = "word", min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of every distinct word that occurs ``min_count`` times or more; nulls are left out."""
    counted = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _step(row: tuple[int, int, int], same: tuple[bool, bool, bool]) -> tuple[int, int, int]:
    """Row i + 1 of the edit matrix in the columns i, i + 1 and i + 2, from row i; ``same`` says whether character i of the
    scanned word is the word's character i - 1, i, i + 1. All above one edit counts as two."""
    left, mid, right = row
    a = min(left + (not same[0]), mid + 1)
    b = min(mid + (not same[1]), right + 1, a + 1)
    return min(a, 2), min(b, 2), min(right + (not same[2]), b + 1, 2)


def _states() -> tuple[list, dict]:
    """The rows that can arise, and the number of the next row by number and comparisons; -1 for no cell below two."""
    rows, after = [(1, 0, 1)], {}
    for k, row in enumerate(rows):
        for bits in range(8):
            new = _step(row, (bool(bits & 1), bool(bits & 2), bool(bits & 4)))
            if min(new) < 2 and new not in rows:
                rows.append(new)
            after[k, bits] = rows.index(new) if min(new) < 2 else -1
    return rows, after


_ROWS, _after = _states()
_NEXT = [[_after[k, bits] for bits in range(8)] for k in range(len(_ROWS))]
#: Columns, counted from the left, that let a row without a zero go on by an equal character.
_OPEN = [[c for c in range(3) if row[c] == 1] for row in _ROWS]


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    while a[:n] != b[:n]:
        n -= 1
    return n


def scan(keys: list[str], lcps: list[int], q: str, half: int) -> list[int]:
    """Places in the sorted ``keys`` of all words behind q, exactly one edit from it, that begin with its first ``half``
    characters (one at least); ``lcps[j]`` is the common prefix of keys j - 1 and j.

    A prefix with no cell below two ends its whole range, and with it all following ranges that differ in its last
    character, up to the next character that the row before lets through: no row of those is computed. q is closed by marks
    that no word holds, as no path leads back from a column behind its end.
    """
    j = bisect_right(keys, q)
    stop = bisect_left(keys, q[:half] + _END, j)
    if j >= stop:
        return []
    n, closed = len(q), q + _CLOSE
    rows = [0] * (common_prefix(keys[j], q) - half + 1)  # of rows half and on; so far q and the word are the same
    found = []
    while True:
        word = keys[j]
        depth = half + len(rows) - 1
        row = rows[-1]
        for ch in word[depth:]:
            new = _NEXT[row][(closed[depth - 1] == ch) + 2 * (closed[depth] == ch) + 4 * (closed[depth + 1] == ch)]
            if new < 0:
                break
            rows.append(new)
            row = new
            depth += 1
        else:
            gap = n - depth
            if -1 <= gap <= 1 and _ROWS[row][gap + 1] == 1:
                found.append(j)
            j += 1
            if j >= stop:
                return found
            del rows[max(1, lcps[j] - half + 1) :]
            continue
        further = [x for c in _OPEN[row] if (x := closed[depth - 1 + c]) > ch]
        shared = word[:depth]
        j = bisect_left(keys, shared + (min(further) if further else _END), j + 1, stop)
        if j >= stop:
            return found
        if not keys[j].startswith(shared):
            del rows[max(1, common_prefix(keys[j], shared) - half + 1) :]


def reachable(q: str, half: int, prefix: str) -> bool:
    """Whether a word with this prefix, which begins like q up to ``half``, can be within one edit of q."""
    row, closed = 0, q + _CLOSE
    for i in range(half, len(prefix)):
        row = _NEXT[row][(closed[i - 1] == prefix[i]) + 2 * (closed[i] == prefix[i]) + 4 * (closed[i + 1] == prefix[i])]
        if row < 0:
            return False
    return True


def _lists(words: DataFrame, shard_words: int) -> DataFrame:
    """``side, key, n, shard`` of both sorted lists, in the shared folder: side 0 has the words, side 1 the reversed words."""
    both = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))
    place = both.repartitionByRange("side", "key").sortWithinPartitions("side", "key").withColumn("place", F.monotonically_increasing_id())
    row = F.col("place").bitwiseAND((1 << 33) - 1)
    shard = F.shiftrightunsigned("place", 33) * (1 << 31) + F.floor(row / shard_words)
    return durable(place.select("side", "key", "n", (shard * 2 + F.col("side")).alias("shard")))


def _visits(directory: dict[int, list[tuple[str, str, int]]]):
    """Sends every word to the shards that may hold near words of it, by side; the directory has first and last key of each."""
    firsts = {side: [first for first, _, _ in entries] for side, entries in directory.items()}
    lasts = {side: [last for _, last, _ in entries] for side, entries in directory.items()}
    shared = {side: [first[: common_prefix(first, last)] for first, last, _ in entries] for side, entries in directory.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, sides, asked, counts = [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for side, q, half in ((0, word, len(word) // 2), (1, word[::-1], len(word) - len(word) // 2)):
                    a, b = bisect_right(lasts[side], q), bisect_left(firsts[side], q[:half] + _END)
                    for k in range(a, b):
                        if b - a < 3 or reachable(q, half, shared[side][k]):
                            shards.append(directory[side][k][2])
                            sides.append(side)
                            asked.append(q)
                            counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(sides, pa.int32()), pa.array(asked, pa.string()), pa.array(counts, pa.int64())], names=["shard", "side", "q", "n"])

    return run


_FOUND = "word string, near long, best_n long, best string"


def _answer(table: pa.Table, queries: pa.Table) -> pa.Table:
    """What a shard's words and a group of queries have near each other: how many, and the best of them by count. Each pair
    is met once, in the list of words if its smaller word's first half begins both, else in the other."""
    order = table.sort_by("key")
    keys, counts = order.column("key").to_pylist(), order.column("n").to_pylist()
    lcps = [0, *map(common_prefix, keys, keys[1:])]
    met: dict[str, tuple[int, int, str]] = {}

    def meet(word: str, other: str, n: int) -> None:
        near, best_n, best = met.get(word, (0, 0, ""))
        met[word] = (near + 1, n, other) if n > best_n or n == best_n and other < best else (near + 1, best_n, best)

    for side, q, n in sorted(zip(*[queries.column(c).to_pylist() for c in ("side", "q", "n")], strict=True)):
        own = q[::-1] if side else q
        for j in scan(keys, lcps, q, len(q) - len(q) // 2 if side else len(q) // 2):
            word = keys[j][::-1] if side else keys[j]
            least, most = (own, word) if own < word else (word, own)
            if not side or not most.startswith(least[: len(least) // 2]):
                meet(own, word, counts[j])
                meet(word, own, n)
    columns = [list(met), *(list(c) for c in zip(*met.values(), strict=True))] if met else [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of every word of ``word, n`` that has words exactly one edit away: their number, and
    the one with the largest n, the smallest in code-point order among equals.

    The lists are range-sorted and cut into shards. Every word goes to the shards behind it whose range its half covers (a few
    unless very many words begin alike, and of those only where the shards' common prefix is still within one edit). The
    queries of a busy shard are dealt to several tasks, each with the shard's words, so a task holds ``shard_words`` words
    and about as many queries. Words must be distinct, of two code points or more; an empty table gives an empty result.
    """
    size = max(shard_words, 2 * words.count() // MAX_SHARDS)
    lists = _lists(words, size)
    directory: dict[int, list] = {0: [], 1: []}
    for r in lists.groupBy("side", "shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect():  # MAX_SHARDS and one per partition at most
        directory[r["side"]].append((r["first"], r["last"], r["shard"]))
    for entries in directory.values():
        entries.sort()
    asked = durable(words.select("word", "n").mapInArrow(_visits(directory), "shard long, side int, q string, n long"))
    busy = asked.groupBy("shard").count().select("shard", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    lists = lists.join(F.broadcast(busy), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.join(F.broadcast(busy), "shard").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    keys = ["shard", "part"]
    found = lists.select(*keys, "key", "n").groupBy(*keys).cogroup(asked.select(*keys, "side", "q", "n").groupBy(*keys)).applyInArrow(_answer, _FOUND)
    best = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), F.col("b.best_n").alias("best_n"))


def variant_forms(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``word, n``.

    The form of a word is its best near word if that is at least ``ratio`` times as frequent, else null; the root is the
    last word reached from form to form, the word itself without a form. Counts grow by ``ratio`` with each form, so the
    chains are short; each round of joins doubles the part of them that is known. An empty table gives an empty result.
    """
    words = durable(words)
    near = near_words(words, shard_words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    all_words = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    all_words = durable(all_words)
    steps = all_words.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return all_words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def document_variants(docs: DataFrame, every: int = 31) -> DataFrame:
    """Forms and roots of the words of a document table (see :func:`noisy_runs`)."""
    return variant_forms(vocabulary(noisy_runs(docs, every)))
