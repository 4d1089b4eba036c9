"""Stored tables with a key, written by bucket: a write rewrites the buckets that it touches and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewire.operators import tables as tb
from tidewire.session import durable

BUCKET = "_bucket"


class KeyedTable:
    """A Parquet table under ``path`` in folders ``_bucket=n`` by a hash of its key.

    A write finds the buckets of its rows (``buckets`` numbers at most), reads only those of the table, settles the new
    content in the shared folder and swaps the folders of these buckets. A write that is cut off before the swap leaves the
    table as it was; repeated, it gives the same content. ``schema`` is that of the table, needed where it may be empty.
    """

    def __init__(self, spark: SparkSession, path: str, key: list, buckets: int = 64, schema: StructType | None = None):
        self.spark, self.path, self.key, self.buckets, self.schema = spark, path, key, buckets, schema

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        if self.schema is None:
            return self.spark.read.parquet(self.path)
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def _write(self, df: DataFrame, files: int = 1) -> None:
        salt = F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(files))
        self._bucketed(df).repartition(BUCKET, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, df: DataFrame, files: int = 1) -> KeyedTable:
        """Write a first content, each bucket in at most ``files`` files."""
        self.schema = df.schema
        self._write(df, files)
        return self

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _rewrite(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        marked = durable(self._bucketed(rows))
        touched = sorted(r[0] for r in marked.select(BUCKET).distinct().collect())  # ``buckets`` rows at most
        if touched:
            old = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._write(durable(change(old, marked.drop(BUCKET))))
        return touched

    def upsert(self, rows: DataFrame, seq: str) -> list[int]:
        """Rows replace those of equal key or are added; the last by ``seq`` wins. Returns the buckets rewritten."""
        return self._rewrite(rows, lambda old, new: tb.upsert(old, new, self.key, seq).select(*old.columns))

    def patch(self, rows: DataFrame, columns: list, seq: str | None = None) -> list[int]:
        """Set ``columns`` by key (see :func:`tidewire.operators.tables.patch`). Returns the buckets rewritten."""
        return self._rewrite(rows, lambda old, new: tb.patch(old, new, self.key, columns, seq))
