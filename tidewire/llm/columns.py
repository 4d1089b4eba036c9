"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which the optimiser moves neither filters nor expressions: what was
    computed once is not computed again for each of its uses."""
    return df.select(F.explode(F.array(F.struct(*[F.col(c) for c in df.columns]))).alias("_settled")).select("_settled.*")
