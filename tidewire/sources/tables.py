"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.ranking import keep_last
from tidewire.session import durable

LABELS = ["positive", "negative", "neutral"]


def read_table(spark: SparkSession, path: str, columns: list | None = None, schema=None) -> DataFrame:
    """A table or some of its columns; only those are read."""
    df = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def replace_partition(df: DataFrame, path: str, column: str = "date", files: int = 8) -> None:
    """Replace only the partitions that occur in ``df`` (A8), each in at most ``files`` files."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(column, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, **options) -> DataFrame:
    """A relational table in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def clean_lexicon(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Trimmed lower-case keywords and labels, weight 1.0 where it is missing, last row per keyword.

    ``rows``: keyword, sentiment, weight as text, and the reading order."""
    tidy = rows.select(
        F.lower(F.trim("keyword")).alias("keyword"), F.lower(F.trim("sentiment")).alias("sentiment"),
        F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"), F.col(seq).alias("_seq"))
    good = tidy.filter((F.coalesce("keyword", F.lit("")) != "") & F.col("sentiment").isin("positive", "negative"))
    return keep_last(good, ["keyword"], "_seq").drop("_seq")


def bad_lexicon_rows(rows: DataFrame) -> DataFrame:
    """Values that make a lexicon file unfit, with how often they occur."""
    label = F.lower(F.trim("sentiment"))
    bad = rows.filter((F.coalesce(F.trim("keyword"), F.lit("")) == "") | ~F.coalesce(label.isin("positive", "negative"), F.lit(False)))
    return bad.groupBy(label.alias("sentiment")).agg(F.count("*").alias("cnt"))


def read_csv(spark: SparkSession, path: str, required: list) -> DataFrame:
    """CSV with a header, a byte-order mark at its start removed; a missing column is an error."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place (file, start of the split, number in it) and whether a quoted value is open
    before them.

    Quotes of a closed value come in pairs, so the state before a line is the parity of all quotes of the file before
    it: counted per split, summed over the splits (one row each), then run through the lines of a split."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    lines = durable(read.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))))
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("_all"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    opened = splits.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    broken = opened.groupBy("file").agg(F.sum("_all").alias("n")).filter("n % 2 = 1").first()
    if broken is not None:
        raise ValueError(f"{broken['file']} ends inside a quoted value")
    inside = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    state = (F.col("_before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 1
    return lines.join(opened.drop("_all"), ["file", "block"]).withColumn("open", state).drop("_before", "quotes")


def read_csv_rows(spark: SparkSession, path: str, required: list) -> DataFrame:
    """CSV with a header as text columns and ``seq``, a struct that orders rows as they stand: by file name, then place.

    Files are read in splits like any text, and a quoted value may hold line breaks, at the border of two splits as well
    (a break inside a value becomes a line feed). Lines without text between records are passed over; missing values
    are null; the byte-order mark at a file's start goes. All files have the header of the first; a missing column, a file of
    another header or one that ends inside quotes is an error, an empty file one for its missing columns.
    """
    lines = _numbered_lines(spark, path)
    begins = F.when(~F.col("open"), F.struct("block", "line"))
    near = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lasts = lines.groupBy("file", "block").agg(F.max(begins).alias("_last"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    carried = lasts.select("file", "block", F.max("_last").over(earlier).alias("_carried"))
    owned = lines.withColumn("_own", F.max(begins).over(near)).join(carried, ["file", "block"]).withColumn("at", F.coalesce("_own", "_carried"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    records = owned.groupBy("file", "at").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
    records = durable(records.filter(F.trim("record") != ""))
    heads = records.groupBy("file").agg(F.min(F.struct("at", "record")).alias("head")).select("file", F.ltrim(F.col("head.record"), F.lit("\ufeff")).alias("head"), F.col("head.at").alias("_first"))
    kinds = [r["head"] for r in heads.select("head").distinct().limit(2).collect()]  # more than one is an error
    if len(kinds) > 1:
        raise ValueError("the files have different headers")
    names = [c.strip().strip('"').strip() for c in kinds[0].split(",")] if kinds else []
    lacking = [c for c in required if c not in names]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    rows = records.join(heads.select("file", "_first"), "file").filter(F.col("at") > F.col("_first"))
    return rows.select(F.from_csv("record", ", ".join(f"`{c}` string" for c in names), {"escape": '"'}).alias("_row"), F.struct("file", "at").alias("seq")).select("_row.*", "seq")


def load_lexicon(spark: SparkSession, path: str, current: DataFrame | None = None, replace_all: bool = False) -> DataFrame:
    """A sentiment lexicon from CSV, merged into the current one or replacing it."""
    raw = read_csv_rows(spark, path, ["keyword", "sentiment"])
    if "weight" not in raw.columns:
        raw = raw.withColumn("weight", F.lit(None).cast("string"))
    fresh = clean_lexicon(raw)
    if current is None or replace_all:
        return fresh
    return current.select("keyword", "sentiment", "weight").join(fresh.select("keyword"), "keyword", "left_anti").unionByName(fresh)


def apply_corrections(articles: DataFrame, rows: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bulk label corrections (A10): correction rows, patched articles, and counts per outcome.

    ``rows``: article_id, true_sentiment and the reading order; the last row per article counts."""
    tidy = rows.select("article_id", F.lower(F.trim("true_sentiment")).alias("corrected_sentiment"), F.col(seq).alias("_seq"))
    valid = keep_last(tidy.filter(F.col("corrected_sentiment").isin(*LABELS)), ["article_id"], "_seq").drop("_seq")
    current = articles.select("article_id", F.col("sentiment").alias("original_sentiment"), F.col("sentiment_score").alias("original_score"), F.lit(True).alias("_found"))
    judged = valid.join(current, "article_id", "left").withColumn(
        "outcome", F.when(F.col("_found").isNull(), "missing").when(F.col("original_sentiment").eqNullSafe(F.col("corrected_sentiment")), "same").otherwise("changed"))
    changes = judged.filter(F.col("outcome") == "changed").select("article_id", "original_sentiment", "original_score", "corrected_sentiment")
    fix = changes.select("article_id", F.col("corrected_sentiment").alias("_new"))
    patched = articles.join(fix, "article_id", "left").withColumn("sentiment", F.coalesce("_new", "sentiment")).select(*articles.columns)
    return changes, patched, judged.groupBy("outcome").agg(F.count("*").alias("cnt"))


def export_labels(articles: DataFrame, corrections: DataFrame | None = None, sentiment: str | None = None, excerpt: int | None = None) -> DataFrame:
    """Labelled articles for review, newest first, with the text or an excerpt of it (A11); write it with :func:`write_csv`."""
    df = articles.filter(F.col("sentiment").isNotNull())
    if sentiment:
        df = df.filter(F.col("sentiment") == sentiment)
    if corrections is not None:
        df = df.join(corrections.filter(F.col("used_in_finetune") == 1).select("article_id"), "article_id", "left_anti")
    return df.select("article_id", "title", (F.substring("content", 1, excerpt) if excerpt else F.col("content")).alias("content"), "sentiment", "sentiment_score", "published_at").orderBy(
        F.desc("published_at"), F.asc("article_id"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A labelled training table from CSV."""
    return read_csv(spark, path, ["article_id", "title", "clean_text", "label"])


def write_map(df: DataFrame, path: str) -> None:
    """A small name -> value dimension as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of name: value pairs as (name, value) rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
