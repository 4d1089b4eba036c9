"""Token counts of whole texts by a sentencepiece model; huge texts go in overlapping chunks that are spliced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
MARK = "▁"  # the model's stand-in for a blank


class Pieces:
    """A model together with the length of each piece in normalised UTF-8 bytes."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.lengths = np.array([1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode()) for i in range(size)], dtype=np.int64)

    @classmethod
    def at(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]


def spliceable(path: str) -> bool:
    """Whether splicing is exact for the model: texts are taken as they are (no normaliser, only blanks are replaced and
    one blank put in front) and unknown characters fall back to bytes. Merges go by score, then from the left, so what
    happens between two neighbouring tokens does not depend on the rest of the text."""
    model = Pieces.at(path).model
    probe = "a  b 　ﬁ①\n é "
    pieces = model.encode(probe, out_type=str)
    taken = b"".join(bytes([int(p[3:5], 16)]) if model.is_byte(model.piece_to_id(p)) else p.encode() for p in pieces)
    return taken == (MARK + probe).replace(" ", MARK).encode()


def _bytes_as_read(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) + 2 * text.count(" ")


def _cut(chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["text_key"], frame["text"], strict=True):
                at = [0]
                marks = list(range(0, len(text), chunk))
                for a, b in zip(marks, [*marks[1:], len(text)], strict=True):
                    at.append(at[-1] + _bytes_as_read(text[a:b]))
                for k, a in enumerate(marks):
                    begin, end = max(0, a - overlap), min(len(text), a + chunk + overlap)
                    # byte positions of the chunk's start, of the two seams, and of the ends of the regions around them
                    seams = [at[k] if k else -1, at[k + 1] if k + 1 < len(marks) else -1]
                    start = at[k] - _bytes_as_read(text[begin:a])
                    yield pd.DataFrame({"text_key": [key], "part": [k], "start": [start], "left": [seams[0]], "right": [seams[1]], "parts": [len(marks)], "piece": [text[begin:end]], "reach": [4 * overlap + 64]})

    return run


def _encode_chunks(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.at(path)
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = np.array(pieces.model.encode(row.piece), dtype=np.int64)
                ends = np.cumsum(pieces.lengths[ids]) + row.start - len(MARK.encode())
                starts = ends - pieces.lengths[ids]
                for seam, number in ((row.left, row.part - 1), (row.right, row.part)):
                    if seam < 0:
                        continue
                    near = np.flatnonzero(np.abs(starts - seam) <= row.reach)
                    yield pd.DataFrame({"text_key": [row.text_key], "seam": [number], "side": [int(seam == row.right)], "part": [row.part], "starts": [starts[near]], "ids": [ids[near]], "order": [near], "total": [len(ids)], "parts": [row.parts]})
                if row.parts == 1:
                    yield pd.DataFrame({"text_key": [row.text_key], "seam": [0], "side": [0], "part": [0], "starts": [starts[:0]], "ids": [ids[:0]], "order": [ids[:0]], "total": [len(ids)], "parts": [1]})

    return run


def _splice(frame: pd.DataFrame) -> pd.DataFrame:
    """One seam: the tokens that both neighbours have at the same place prove it; their share of the count is what the
    left one has before that token and the right one from it on."""
    frame = frame.drop_duplicates(["side", "part"])
    row = frame.iloc[0]
    if row["parts"] == 1:
        return pd.DataFrame({"text_key": [row["text_key"]], "tokens": [int(row["total"])], "open": [0]})
    # a middle chunk stands on two seams: its total is counted on its left one, the first chunk's on its right one
    left = frame[frame["side"] == 1].iloc[0]
    right = frame[frame["side"] == 0].iloc[0]
    a = pd.DataFrame({"start": left["starts"], "id": left["ids"], "order": left["order"]})
    b = pd.DataFrame({"start": right["starts"], "id": right["ids"], "order": right["order"]})
    both = a.merge(b, on=["start", "id"])
    if both.empty:
        return pd.DataFrame({"text_key": [row["text_key"]], "tokens": [0], "open": [1]})
    common = both.iloc[len(both) // 2]
    first = int(left["total"]) if left["part"] == 0 else 0
    tokens = first - (int(left["total"]) - int(common["order_x"])) + int(right["total"]) - int(common["order_y"])
    return pd.DataFrame({"text_key": [row["text_key"]], "tokens": [tokens], "open": [0]})


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``text_key, n_tokens`` of distinct texts ``text_key, text``, by overlapping chunks.

    A merge order decides each adjacent pair of tokens on its own, so a row of tokens is the encoding of its text as soon
    as every adjacent pair of it stands in the encoding of some chunk. Two neighbours that share a token at the same
    place are therefore spliced there. Where they share none, the text's chunks are cut again with four times
    the overlap; once the overlap reaches over the whole text all chunks are equal, so the rounds end.
    """
    done = None
    pending = texts
    while True:
        chunks = pending.mapInPandas(_cut(chunk, overlap), "text_key string, part long, start long, left long, right long, parts long, piece string, reach long")
        spread = chunks.repartition("text_key", "part")
        seams = spread.mapInPandas(
            _encode_chunks(path), "text_key string, seam long, side long, part long, starts array<long>, ids array<long>, order array<long>, total long, parts long"
        )
        spliced = seams.groupBy("text_key", "seam").applyInPandas(_splice, "text_key string, tokens long, open long")
        counted = durable(spliced.groupBy("text_key").agg(F.sum("tokens").alias("n_tokens"), F.sum("open").alias("open")))
        good = counted.filter("open = 0").select("text_key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = counted.filter("open > 0").select("text_key")
        if bad.isEmpty():
            return done
        pending, overlap = texts.join(bad, "text_key", "left_semi"), 4 * overlap


def _count_small(path: str, chunk: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pieces.at(path).model
        for frame in frames:
            counts: list[int | None] = []
            texts = frame["text"].tolist()
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                counts += [len(ids) for ids in model.encode([t or "" for t in part], num_threads=1)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_key": frame["text_key"], "n_bytes": frame["n_bytes"], "n_tokens": pd.array(counts, dtype="Int64")})

    return run


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens``, as the library counts each whole text.

    A null or empty text has 0 bytes and no token. A text of more than ``chunk`` characters is cut into overlapping
    chunks that spread over the cluster; equal huge texts are counted once. Rows with equal ids stay rows of their own,
    other columns are not read. For a model that :func:`spliceable` rejects, every text is encoded whole.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    huge = F.char_length("text") > chunk if spliceable(path) else F.lit(False)
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    rows = rows.withColumn("text_key", F.when(huge, F.sha2("text", 256)))
    kind = docs.schema[id_column].dataType.simpleString()
    small = rows.withColumn("text", F.when(F.col("text_key").isNull(), F.col("text")))
    counted = small.mapInPandas(_count_small(path, chunk), f"doc_id {kind}, text_key string, n_bytes long, n_tokens long")
    long = count_huge(rows.filter("text_key IS NOT NULL").select("text_key", "text"), path, chunk, overlap)
    joined = counted.join(long.withColumnRenamed("n_tokens", "spliced"), "text_key", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("spliced", F.when(F.col("text_key").isNull(), F.col("n_tokens"))).alias("n_tokens"))
