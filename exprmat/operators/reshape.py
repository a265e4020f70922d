"""Layouts, ordinals, profiles and ordered heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import VALUE, ExprMatrix
from .sampling import RANK, global_rank


def with_ordinal(df: DataFrame, key: str | list[str], name: str = "ordinal") -> DataFrame:
    """A 0-based ordinal in key order (reset_index), computed with distributed ranks."""
    keys = [key] if isinstance(key, str) else list(key)
    return global_rank(df, keys).withColumnRenamed(RANK, name)


def matrix_profile(m: ExprMatrix) -> DataFrame:
    """One row with the shape, stored-cell count, NULL count and density."""
    n_s, n_g = m.n_samples, m.n_genes
    agg = m.cells.agg(F.count(F.lit(1)).alias("n_stored"),
                      F.count_if(F.col(VALUE).isNull()).alias("n_null"),
                      F.count_if(F.col(VALUE) != 0).alias("n_nonzero"))
    return agg.select(F.lit(n_s).cast("bigint").alias("n_samples"), F.lit(n_g).cast("bigint").alias("n_genes"),
                      "n_stored", "n_null", "n_nonzero",
                      F.try_divide(F.col("n_nonzero"), F.lit(n_s * n_g)).alias("density"))


def ordered_head(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """K4 / K5: the first n rows of an explicit total order (use ``F.desc`` to reverse)."""
    return df.orderBy(*order).limit(n)
