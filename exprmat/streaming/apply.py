"""Fitted transforms on streaming cells.

The reference has no streaming code. What carries over for free: once per-gene or
per-sample parameters are fitted on a batch table, log-normalisation (C3), variance
scaling (C5) and the upper-quartile model (X4) are stateless broadcast joins, so they
run unchanged on a Structured Streaming DataFrame of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..matrix import GENE, MAX_BROADCAST_GENES, SAMPLE, VALUE, counted_broadcast


def log_normalize_stream(cells: DataFrame, gene_totals: DataFrame, scale: float = 1e4) -> DataFrame:
    """C3 with gene totals fitted beforehand (``gene_id, total``)."""
    totals, _ = counted_broadcast(gene_totals.select(GENE, "total"), MAX_BROADCAST_GENES)
    return (cells.join(totals, GENE)
            .select(SAMPLE, GENE, fx.ln_zero_as_one(fx.guarded_div(F.col(VALUE), F.col("total"))
                                                    * F.lit(float(scale))).alias(VALUE)))


def scale_stream(cells: DataFrame, gene_stats: DataFrame, by: str = "var") -> DataFrame:
    """C5 on stored cells with fitted ``gene_id, mean, var``.

    Only cells that arrive are scaled: the −mean/var of a pair that is not stored is not
    produced, so this is the stored part of C5's dense output.
    """
    div = F.col("var") if by == "var" else F.sqrt("var")
    st, _ = counted_broadcast(gene_stats.select(GENE, "mean", div.alias("_div")), MAX_BROADCAST_GENES)
    return cells.join(st, GENE).select(SAMPLE, GENE, F.try_divide(F.col(VALUE) - F.col("mean"), F.col("_div")).alias(VALUE))
