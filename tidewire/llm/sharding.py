"""Shards that all hold the same mixture: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ranking import number_rows


def interleave(rows: DataFrame, stratum: str, key: str, n_shards: int, seed: int = 0) -> DataFrame:
    """Every row with its ``shard`` (0 up) and ``slot`` (0 up without gaps in each shard).

    Rows are shuffled by a seeded hash inside their stratum; the r-th of n gets the fraction (2r - 1) / 2n. Sorted by
    that fraction the strata interleave in proportion, so equal cuts of the order have the mixture of the whole and
    sizes at most one apart. Both rankings are range sorts, so a stratum of any size spreads over all tasks. Only the
    columns handed in travel: pass keys and sizes and join the texts at write time.

    A null stratum is a stratum of its own and a null key an ordinary value. Rows that agree in stratum and key are
    ordered by their other columns; wholly equal rows are interchangeable. Columns of the input may not begin with
    ``_il_``. An empty table gives an empty result.
    """
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    rest = [F.col(c) for c in rows.columns if c not in (stratum, key)]
    rows = rows.withColumn("_il_mixed", mixed)
    inside = number_rows(rows, [F.col(stratum), F.col("_il_mixed"), *rest], "_il_row")
    strata = inside.groupBy(F.col(stratum).alias("_il_stratum")).agg(F.count("*").alias("_il_n"), F.min("_il_row").alias("_il_first"))
    ranked = inside.join(strata, F.col(stratum).eqNullSafe(F.col("_il_stratum"))).withColumn(
        "_il_share", (2 * (F.col("_il_row") - F.col("_il_first")) + 1) / (2 * F.col("_il_n"))
    )
    ranked = ranked.drop("_il_row", "_il_stratum", "_il_first")
    order = [F.col("_il_share"), F.col("_il_mixed"), F.col(stratum), *rest]
    placed = number_rows(ranked, order, "_il_at", start=0)
    total = rows.agg(F.count("*")).scalar()
    return (
        placed.withColumn("_il_total", total)
        .withColumn("shard", F.expr(f"_il_at * {n_shards} DIV _il_total").cast("int"))
        .withColumn("slot", F.expr(f"_il_at - (shard * _il_total + {n_shards - 1}) DIV {n_shards}").cast("bigint"))
        .drop("_il_mixed", "_il_share", "_il_at", "_il_total", "_il_n")
    )
