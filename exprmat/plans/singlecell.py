"""Single-cell preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..matrix import SAMPLE, VALUES, ExprMatrix
from ..operators.baseline import BaselineMatrix, scale_sparse
from ..operators.selection import highly_variable_genes
from ..operators.transforms import log_normalize, scale_by_variance
from ..sources.positions import read_rows_by_position


def single_cell_pipeline(m: ExprMatrix, n_top: int = 2000, scale: float = 1e4,
                         by: str = "var") -> DataFrame:
    """Log-normalise (C3) → n_top most variable genes (C4) → scale.

    Returns the dense scaled matrix ``(sample_id, gene_id, value)`` over the
    selected genes. Statistics are global over all cells (the pandas path), not per
    partition (Q1, Q2). The result stays distributed; the reference collects it.
    """
    ln = log_normalize(m, scale)
    hv, hv_stats = highly_variable_genes(ln, n_top, with_stats=True)
    return scale_by_variance(hv, by, stats=hv_stats)


def single_cell_pipeline_path(spark: SparkSession, path: str, n_top: int = 2000, scale: float = 1e4, by: str = "var",
                              fmt: str | None = None) -> DataFrame:
    """C6 from a file of cells × genes without a key column (CSV or parquet, in any number of parts):
    cells are numbered by their row over all parts, which is their ``sample_id``."""
    rows, names = read_rows_by_position(spark, path, fmt)
    return single_cell_pipeline(ExprMatrix.from_row_array(rows, SAMPLE, VALUES, gene_ids=names).materialized(), n_top, scale, by)


def single_cell_pipeline_sparse(m: ExprMatrix, n_top: int = 2000, scale: float = 1e4, by: str = "var") -> BaselineMatrix:
    """C6 whose result is as sparse as its input: the same values as ``single_cell_pipeline``, held as stored
    cells and a baseline per gene, for statistics, projections and row arrays without samples × genes rows."""
    hv, hv_stats = highly_variable_genes(log_normalize(m, scale), n_top, with_stats=True)
    return scale_sparse(hv, by, stats=hv_stats)
