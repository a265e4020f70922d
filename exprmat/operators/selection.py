"""Top-k gene selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE, ExprMatrix, cache_small
from .stats import gene_stats


def top_variance_genes(m: ExprMatrix, n: int, tie_break: str = GENE) -> DataFrame:
    """K2/K3: ``(gene_id, var)`` of the n genes of largest sample variance.

    Variances come from exact sums, so genes of equal values tie exactly; ties are broken by
    ``tie_break`` ascending. The input is the gene-statistics table (one row per gene), so the
    top-k is a TakeOrdered over at most n_genes rows, never over the cells.
    """
    st = gene_stats(m)
    return st.orderBy(F.col("var").desc_nulls_last(), F.col(tie_break)).limit(n).select(GENE, "var")


def highly_variable_genes(m: ExprMatrix, n: int = 2000, with_stats: bool = False):
    """C4: restrict ``m`` to its n most variable genes.

    With ``with_stats`` also returns the selected genes' ``gene_id, mean, var``; they
    are statistics over the same samples, so a following scaling step (C5) can reuse
    them instead of another pass over the cells.
    """
    st = cache_small(gene_stats(m))
    top = cache_small(st.orderBy(F.col("var").desc_nulls_last(), F.col(GENE)).limit(n).select(GENE, "mean", "var"))
    out = m.restrict_genes(top.select(GENE), min(n, m.n_genes))     # count known: no second pin
    return (out, top) if with_stats else out
