"""Positional posting tables: which word stands where, built once and asked often."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import phrase_text
from tidewire.operators.filters import SEARCH_WEIGHTS


#: Rows that a task hands over at a time, and bytes of a row group of a stored table.
OUT_ROWS, ROW_GROUP = 50_000, 16 << 20


def _words(text) -> Column:
    return F.filter(F.split(F.trim(phrase_text(text)), " "), lambda w: w != "")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of every text with their places, about ``OUT_ROWS`` rows at a time."""

    def made(names: list, whose: list, terms: list, spots: list, key: pa.Array) -> pa.RecordBatch:
        upto = np.cumsum([0, *map(len, spots)])
        flat = np.fromiter(chain.from_iterable(spots), dtype=np.int32, count=int(upto[-1]))
        places = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(terms, pa.string()), key.take(pa.array(whose, pa.int64())), places], names=["field", "term", "key", "positions"])

    for batch in batches:
        key, fields, texts = batch.column("key"), batch.column("field"), batch.column("text")
        names, whose, terms, spots = [], [], [], []
        for i in range(batch.num_rows):
            found: dict[str, list[int]] = {}
            for place, word in enumerate(w for w in (texts[i].as_py() or "").split(" ") if w):
                found.setdefault(word, []).append(place)
            names += [fields[i].as_py()] * len(found)
            whose += [i] * len(found)
            terms += found
            spots += found.values()
            if len(terms) >= OUT_ROWS:
                yield made(names, whose, terms, spots, key)
                names, whose, terms, spots = [], [], [], []
        if terms:
            yield made(names, whose, terms, spots, key)


def postings(df: DataFrame, fields: list, key: str = "article_id") -> DataFrame:
    """``field, term, key, positions``: one row per word of a field of a row, with all its places in ascending order.

    Words are those of :func:`tidewire.functions.text.phrase_text`; a null or empty field has none. Rows that repeat a key
    have postings of their own, and searches find the key once; a phrase is met where its words stand in one text or at the
    same places of texts of one key. Each text is taken apart where it was read, nothing is exchanged.
    """
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    texts = df.select(F.col(key).alias("key"), named.alias("_f")).filter("_f.text IS NOT NULL").select("key", "_f.field", F.trim(phrase_text("_f.text")).alias("text"))
    return texts.mapInArrow(_places, f"field string, term string, key {dict(df.dtypes)[key]}, positions array<int>")


def write_postings(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store postings by field, in files of ascending terms, so that a question reads the pages of its terms only.

    Every task writes the postings of the rows it has, as a search index cuts its rows into shards: a word that stands in
    every row spreads over all files, and storing costs no exchange, only a sort inside each task. ``mode="append"`` adds the
    postings of further rows."""
    ordered = table.sortWithinPartitions("field", "term", "key")
    ordered.write.mode(mode).option("parquet.block.size", ROW_GROUP).partitionBy("field").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _terms(spark: SparkSession, query: str) -> list[str]:
    """The words of a query text as the table spells them (one row of constants)."""
    found = spark.range(1).select(_words(F.lit(query)).alias("words")).first()["words"]
    if not found:
        raise ValueError("the query has no words")
    return found


def _runs(hits: DataFrame, offsets: Column, keys: list, length) -> DataFrame:
    """Keys with some start from which every offset of a phrase is met."""
    starts = hits.select(*keys, length.alias("_length"), F.explode(offsets).alias("_offset"), "positions")
    starts = starts.select(*keys, "_length", F.explode("positions").alias("_position"), "_offset")
    whole = starts.groupBy(*keys, (F.col("_position") - F.col("_offset")).alias("_start")).agg(F.collect_set("_offset").alias("_met"), F.max("_length").alias("_length"))
    return whole.filter("size(_met) = _length").select(*keys).distinct()


def _phrase(table: DataFrame, query: str, field: str, open_end: bool) -> DataFrame:
    terms = _terms(table.sparkSession, query)
    tests = [F.col("term") == t for t in terms]
    if open_end:
        tests[-1] = F.col("term").startswith(terms[-1])
    hits = table.filter(F.col("field") == field).filter(reduce(lambda a, b: a | b, tests))
    if len(terms) == 1:
        return hits.select("key").distinct()
    offsets = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]))
    return _runs(hits, offsets, ["key"], F.lit(len(terms)))


def phrase_keys(table: DataFrame, query: str, field: str) -> DataFrame:
    """Keys of the rows in whose field the words of the query stand one after another (B7). A query without words is an
    error."""
    return _phrase(table, query, field, False)


def phrase_prefix_keys(table: DataFrame, query: str, field: str) -> DataFrame:
    """The same, the last word of the query being the start of a word."""
    return _phrase(table, query, field, True)


def match_scores(table: DataFrame, query: str, weights: dict | None = None) -> DataFrame:
    """``key, score``: rows that hold a word of the query in some field, with the weight of the heaviest such field."""
    weights = weights or SEARCH_WEIGHTS
    hits = table.filter(F.col("field").isin(*weights)).filter(F.col("term").isin(*_terms(table.sparkSession, query)))
    weight = F.coalesce(*[F.when(F.col("field") == f, float(w)) for f, w in weights.items()])
    return hits.groupBy("key").agg(F.max(weight).alias("score"))


def saved_phrases(table: DataFrame, queries: DataFrame, field: str) -> DataFrame:
    """``query_id, key`` for every phrase of a table of saved searches (``query_id, query``), in one pass over the postings.

    Queries without words, or null ones, find nothing; a repeated ``query_id`` with another text is a search of its own
    whose finds are added."""
    asked = queries.select("query_id", _words("query").alias("_words")).distinct()
    asked = asked.withColumn("_length", F.size("_words")).withColumn("_query", F.concat_ws(" ", "_words"))
    words = asked.select("query_id", "_query", "_length", F.posexplode("_words").alias("_offset", "term"))
    words = words.groupBy("query_id", "_query", "_length", "term").agg(F.collect_list("_offset").alias("_offsets"))
    hits = table.filter(F.col("field") == field).join(words, "term")
    return _runs(hits, F.col("_offsets"), ["query_id", "_query", "key"], F.col("_length")).select("query_id", "key").distinct()
