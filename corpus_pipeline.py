"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, encoding."""

from __future__ import annotations

import os
import sys
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewire.llm.bpe import encode  # noqa: E402
from tidewire.llm.decontamination import find_matches  # noqa: E402
from tidewire.llm.jaccard_join import drop_near_duplicates  # noqa: E402
from tidewire.llm.quality_rules import drop_rejected  # noqa: E402
from tidewire.llm.substring_dedup import remove_passages  # noqa: E402
from tidewire.session import shared_folder  # noqa: E402

TOKENIZER = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return drop_rejected(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    marked = docs.withColumn("_no_text", F.col("text").isNull())
    rest = [c for c in marked.columns if c not in ("doc_id", "text")]
    kept = drop_near_duplicates(marked, carry=rest).withColumn("text", F.when(~F.col("rest._no_text"), F.col("text")))
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.{c}") for c in docs.columns])


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that begin in a document of a smaller id."""
    marked = docs.withColumn("_no_text", F.col("text").isNull())
    rest = [c for c in marked.columns if c not in ("doc_id", "text")]
    cut = remove_passages(marked, carry=rest)
    columns = {c: F.col(f"rest.{c}") for c in docs.columns if c not in ("doc_id", "text")}
    columns["doc_id"], columns["text"] = F.col("doc_id"), F.when(~F.col("rest._no_text"), F.col("kept"))
    columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("rest.n_chars"))
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns)
    return found.filter(F.size("matches") == 0).select("rest.*")


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each),
    ("substring_dedup", cut_passages),
    ("decontamination", keep_clean),
    ("bpe", to_ids),
]

#: Passages are cut and ids looked up in ways that SQL has no words for; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
