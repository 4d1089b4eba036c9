"""Similarity join of documents on word shingles through a token-group matrix.

Documents are cut down to those that can have a partner at all, exactly and in three questions of the blocks: equal sets
become one class; a class stays when a token of its prefix (longest shingles first) is shared; of those, a class stays
when enough of all its tokens are shared. The rest are grouped: a leader of every token is compared with the other classes of
the token, and what links forms groups of similar documents. The matrix holds the union of each group's
tokens. A class from outside is counted against the union first; only groups whose count reaches the threshold are
opened and compared member by member.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import LAST, Block, answer, array_of, ask, attach, bucket_count, gram_hash, grouped, pack, placed, prefix_sums, unpacked, word_hashes
from tidewire.llm.components import components
from tidewire.session import durable

SHINGLE_WORDS = 5
PERCENT = 80
GROUP_SIZE = 64
SIZE_STEP = 1.05
LEADER_ROUNDS = 2
BLOCK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

ASK_TOKENS = "bucket long, block long, tokens binary"
TELL_TOKENS = "block long, bucket long, tokens binary, counts binary"


def token_sets(block: Block, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of all texts, sorted within each text, and the bounds of each text among them.

    A token is a shingle's hash of 56 bits below a byte that falls with its length, so that the order of tokens puts
    long shingles, which are rarely common, first. A text of fewer words has its whole sequence as its one token.
    """
    data = LOWER[block.data]
    solid = ~BLANK[data]
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[block.offsets] = True
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, block.offsets)
    counts = np.diff(bounds)
    sums = prefix_sums(word_hashes(data, starts, ends))
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    docs, hashes, lengths = [], [], []
    if len(starts) >= width:
        doc = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
        at = bounds[doc] + np.arange(len(doc)) - np.searchsorted(doc, doc)
        docs.append(doc)
        hashes.append(gram_hash(sums, width)[at])
        lengths.append(sizes[at + width] - sizes[at])
    short = np.flatnonzero((counts > 0) & (counts < width))
    for n in range(1, width):
        some = short[counts[short] == n]
        if len(some):
            docs.append(some)
            hashes.append(gram_hash(sums, n)[bounds[some]])
            lengths.append((sizes[bounds[some] + n] - sizes[bounds[some]]))
    if not docs:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts) + 1, dtype=np.int64)
    doc, hashed, length = (np.concatenate(x) for x in (docs, hashes, lengths))
    tokens = ((255 - np.minimum(length, 255)).astype(np.uint64) << np.uint64(56)) | (hashed & np.uint64((1 << 56) - 1))
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, tokens = doc[order], tokens[order]
    cuts = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        tokens[a:b].sort()
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tokens[1:] != tokens[:-1])])
    doc, tokens = doc[new], tokens[new]
    return tokens, np.searchsorted(doc, np.arange(len(counts) + 1))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n tokens needs with any partner."""
    return -(-percent * n // 100)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in unpacked(batches):
        tokens, bounds = token_sets(block)
        keys = [hashlib.blake2b(tokens[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.id_list, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(keys, pa.string()), pa.array([block.block] * n, pa.int64()), pa.array(range(n), pa.int64())],
            names=["doc_id", "n_shingles", "key", "block", "line"],
        )


class Speakers:
    """The sets of the texts of a block that speak for their class."""

    def __init__(self, block: Block):
        tokens, bounds = token_sets(block)
        said = sorted((got["line"], got["key"]) for got in block.answers[0])
        self.keys = [key for _, key in said]
        lines = np.array([line for line, _ in said], dtype=np.int64)
        self.sizes = (bounds[lines + 1] - bounds[lines]) if len(lines) else lines
        self.starts = bounds[lines] if len(lines) else lines
        self.tokens = tokens

    def heads(self, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of the chosen sets, and the set that each belongs to."""
        owner = np.repeat(which, counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.tokens[self.starts[owner] + within], owner


def _low(tokens: np.ndarray, n: int) -> np.ndarray:
    """32 bits of a token for its bucket; chance agreements only keep a class in."""
    return ((tokens // np.uint64(n)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _messages(block: int, tokens: np.ndarray, n: int) -> Iterator[dict]:
    order, cuts = grouped(tokens % np.uint64(n))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = tokens[order[a:b]]
        yield {"bucket": [int(some[0] % np.uint64(n))], "block": [block], "tokens": [np.sort(_low(some, n)).tobytes()]}


def _tell_counts(table: pa.Table) -> dict:
    """For every block, its tokens that were said more than once and how often (65,535 stands for more)."""
    parts = [array_of(x, np.uint32) for x in table.column("tokens").to_pylist()]
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    keys, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order, starts = grouped(keys)
    count = np.repeat(np.diff(starts), np.diff(starts))
    order, count = order[count > 1], np.minimum(count[count > 1], 65535)
    keys, owner = keys[order], owner[order]
    by = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by], np.arange(len(parts) + 1))
    out: dict[str, list] = {"block": [], "bucket": [], "tokens": [], "counts": []}
    for k, block in enumerate(blocks):
        mine = by[cut[k] : cut[k + 1]]
        mine = mine[np.concatenate([[True], keys[mine][1:] != keys[mine][:-1]])] if len(mine) else mine
        if len(mine):
            for name, value in zip(out, (block, bucket, keys[mine].tobytes(), count[mine].astype(np.uint16).tobytes()), strict=True):
                out[name].append(value)
    return out


def _counts_of(tokens: np.ndarray, told: list, n: int) -> np.ndarray:
    """How often each token was said by all blocks: 1 unless an answer names it."""
    out = np.ones(len(tokens), dtype=np.int64)
    if not told:
        return out
    keys = np.concatenate([(np.uint64(got["bucket"]) << np.uint64(32)) | array_of(got["tokens"], np.uint32).astype(np.uint64) for got in told])
    counts = np.concatenate([array_of(got["counts"], np.uint16) for got in told])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    own = ((tokens % np.uint64(n)) << np.uint64(32)) | _low(tokens, n).astype(np.uint64)
    spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[spot] == own, counts[spot], out)


def _ask_heads(n: int, percent: int):
    def run(block: Block) -> Iterator[dict]:
        s = Speakers(block)
        tokens, _ = s.heads(np.arange(len(s.keys)), s.sizes - needed(s.sizes, percent) + 1)
        yield from _messages(block.block, tokens, n)

    return run


def _alive(s: Speakers, told: list, n: int, percent: int) -> np.ndarray:
    tokens, owner = s.heads(np.arange(len(s.keys)), s.sizes - needed(s.sizes, percent) + 1)
    shared = _counts_of(tokens, told, n) > 1
    return np.unique(owner[shared])


def _ask_all(n: int, percent: int):
    def run(block: Block) -> Iterator[dict]:
        s = Speakers(block)
        alive = _alive(s, block.answers[1], n, percent)
        yield from _messages(block.block, s.heads(alive, s.sizes[alive])[0], n)

    return run


def _sets(n: int, percent: int):
    """Classes that share enough tokens for a partner: their shared tokens, rarest first, and how many of them the prefix
    holds (tokens that are said once come before all others and match nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches, "speakers", "heads", "counts"):
            s = Speakers(block)
            alive = _alive(s, block.answers[1], n, percent)
            tokens, owner = s.heads(alive, s.sizes[alive])
            count = _counts_of(tokens, block.answers[2], n)
            shared = count > 1
            tokens, owner, count = tokens[shared], owner[shared], count[shared]
            order = np.lexsort((tokens, count, owner))
            tokens, owner = tokens[order], owner[order]
            keep = [i for i in alive.tolist()]
            cut = np.searchsorted(owner, alive), np.searchsorted(owner, alive, side="right")
            rows = [(i, a, b) for i, a, b in zip(keep, cut[0].tolist(), cut[1].tolist(), strict=True) if b - a >= needed(s.sizes[i], percent)]
            heads = [int(s.sizes[i] - needed(s.sizes[i], percent) + 1 - (s.sizes[i] - (b - a))) for i, a, b in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s.keys[i] for i, _, _ in rows], pa.string()), pa.array([int(s.sizes[i]) for i, _, _ in rows], pa.int64()),
                    pa.array(heads, pa.int32()), pa.array([tokens[a:b].astype(np.int64) for _, a, b in rows], pa.list_(pa.int64())),
                ],
                names=["key", "n", "head", "tokens"],
            )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the threshold, by their whole intersection."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _in_reach(n: str, low: str, high: str, percent: int):
    return (100 * F.col(high) >= percent * F.col(n)) & (percent * F.col(low) <= 100 * F.col(n))


def _enough(common, low, percent: int):
    """Whether a set of n tokens with so many in common can link with one of at least ``low``: the other has no fewer than
    percent * n / 100 either, and a pair of n and m needs percent * (n + m) / (100 + percent) in common."""
    return (100 + percent) * (F.col(common) if isinstance(common, str) else common) >= percent * (F.col("n") + F.greatest(low, F.ceil(percent * F.col("n") / 100)))


def link_classes(sets: DataFrame, percent: int, group_size: int = GROUP_SIZE) -> DataFrame:
    """``node, component`` of the classes that have a link."""
    alone = (F.col("n") - F.size("tokens")) / F.col("n")
    # of a pair's common tokens the first lies in both prefixes, and the others behind it in both: `left` bounds them all
    spread = F.posexplode(F.slice("tokens", 1, F.col("head"))).alias("place", "token")
    heads = durable(sets.select("key", "n", alone.alias("alone"), F.size("tokens").alias("shared"), spread).withColumn("left", F.col("shared") - F.col("place")).drop("shared", "place"))
    # 1. groups of similar classes: every class against one leader of each of its prefix tokens, the one with the
    #    smallest share of tokens of its own; what does not link stands for the next round's leaders
    links = None
    rest = heads
    for _ in range(LEADER_ROUNDS):
        leaders = rest.groupBy("token").agg(F.min(F.struct("alone", "key", "n")).alias("lead"), F.count("*").alias("many")).filter("many > 1")
        tried = rest.join(leaders.select("token", "lead"), "token").filter("key <> lead.key").withColumn("a", F.col("lead.key"))
        pairs = tried.filter(_in_reach("n", "lead.n", "lead.n", percent)).select("a", F.col("key").alias("b")).distinct()
        linked = durable(_linked(pairs, sets, percent))
        links = linked if links is None else links.unionByName(linked)
        rest = durable(tried.join(linked.withColumnRenamed("b", "key"), ["a", "key"], "left_anti").select("token", "key", "n", "alone"))
    similar = durable(components(links))
    # 2. the matrix: groups of bounded size and of nearly equal set sizes within a component, with the union of their tokens
    width = F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).cast("string")
    placed_in = durable(similar.withColumnRenamed("node", "key").join(sets.select("key", "n"), "key").select("key", "component", width.alias("width")))
    sized = placed_in.groupBy("component", "width").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / group_size)).cast("string")
    of = placed_in.join(sized, ["component", "width"]).select("key", "component", F.concat_ws(":", "width", part).alias("piece"))
    grouped_sets = durable(
        sets.join(of, "key", "left").select("key", "n", "tokens", F.coalesce("component", "key").alias("component"), F.coalesce("piece", F.lit("")).alias("piece"))
    )
    spots = heads.drop("alone").join(grouped_sets.select("key", "component", "piece"), "key")
    shares = spots.groupBy("token", "component").agg(F.count("*").alias("many"), F.min("n").alias("least"))
    mixed = shares.groupBy("token").agg(
        F.max_by("component", F.struct("many", "component")).alias("main"), F.count("*").alias("kinds"), F.min("least").alias("least")
    ).filter("kinds > 1")
    # what has too little left of a token even for the smallest set of the token has no partner that begins there
    spots = durable(spots.join(mixed, "token").filter(_enough("left", F.col("least"), percent)))
    asking = spots.filter("component <> main").select("token", "key", "n", "left", F.col("component").alias("own"))
    cells = spots.groupBy("token", "component", "piece").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("most"))
    tried = asking.join(cells, "token").filter("own <> component").filter(_in_reach("n", "low", "high", percent))
    tried = tried.filter(_enough(F.least("left", "most"), F.col("low"), percent))
    tried = tried.groupBy("key", "n", "component", "piece").agg(F.min("low").alias("low"))  # of the members that share a prefix token
    wanted = tried.select("component", "piece").distinct()
    unions = (
        grouped_sets.join(wanted, ["component", "piece"], "left_semi").groupBy("component", "piece").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    )  # at most about group_size sets each
    own = sets.select("key", "tokens")
    reach = tried.join(own, "key").join(unions, ["component", "piece"]).filter(_enough(F.size(F.array_intersect("tokens", "union")), F.col("low"), percent))
    opened = durable(reach.select("key", "n", "component", "piece"))
    inside = grouped_sets.select("component", "piece", F.col("key").alias("other"), F.col("n").alias("other_n"))
    pairs = opened.join(inside, ["component", "piece"]).filter(_in_reach("n", "other_n", "other_n", percent))
    more = _linked(pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), sets, percent)
    # 3. the links between groups join their components
    across = more.unionByName(similar.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(across)


def _grouped_members(docs: DataFrame, id_column: str, text: str, percent: int, most: int, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each of their texts ``doc_id, n_shingles, key, block, line, component, component_id``."""
    n = bucket_count(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    blocks = placed(pack(docs, id_column, text, most, carry))
    members = durable(blocks.mapInArrow(_members, "doc_id long, n_shingles long, key string, block long, line long"))
    spot = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "block", "line")
    classes = durable(members.filter("key IS NOT NULL").groupBy("key").agg(F.min(spot).alias("first"), F.min("doc_id").alias("least")))
    speakers = classes.select("first.block", "first.line", "key")
    known = attach(blocks, speakers, "speakers")
    heads = durable(answer(ask(known, _ask_heads(n, percent), ASK_TOKENS, "speakers"), _tell_counts, TELL_TOKENS))
    known = attach(known, heads, "heads")
    counts = answer(ask(known, _ask_all(n, percent), ASK_TOKENS, "speakers", "heads"), _tell_counts, TELL_TOKENS)
    sets = durable(attach(known, counts, "counts").mapInArrow(_sets(n, percent), "key string, n long, head int, tokens array<long>"))
    linked = durable(link_classes(sets, percent))
    grouped_ids = linked.join(classes, linked["node"] == classes["key"]).groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("keeper"))
    named = linked.join(grouped_ids, "component").select(F.col("node").alias("key"), "component_id", "keeper")
    by_class = classes.join(named, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("keeper", "first").alias("keeper"))
    joined = members.join(by_class, "key", "left")
    alone = F.col("key").isNull()
    return blocks, joined.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two rows link when the Jaccard similarity of their sets of five-word shingles is at least ``percent`` / 100;
    ``component_id`` is the least id of all rows reachable by links. Rows of equal sets always link. A null or empty
    text has no shingle and no link and is its own component. Null ids take part but are never the least, unless all
    are null. Rows with equal ids stay rows of their own; other columns are not read; an empty table gives no row.
    """
    return _grouped_members(docs, id_column, text, percent, most)[1].select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, most: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, text`` and struct ``rest`` of the columns of ``carry`` for one row of each component, that of the least id.

    Of rows that repeat the least id one stays. Rows without words all stay.
    """
    blocks, members = _grouped_members(docs, id_column, text, percent, most, carry)
    stays = F.col("key").isNull() | ((F.col("keeper.block") == F.col("block")) & (F.col("keeper.line") == F.col("line")))
    schema = "doc_id long, text string"
    if carry:
        schema += f", rest {docs.select(F.struct(*carry).alias('rest')).schema['rest'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches, "keepers"):
            lines = sorted(got["line"] for got in block.answers[0])
            columns = [pa.array([block.id_list[i] for i in lines], pa.int64()), pa.array([block.text(i).decode("utf-8", "replace") for i in lines], pa.string())]
            if carry:
                columns.append(block.rest.take(pa.array(lines, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "rest"][: len(columns)])

    return attach(blocks, members.filter(stays).select("block", "line"), "keepers").mapInArrow(run, schema)
