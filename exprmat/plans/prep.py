"""Dataset preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE, SAMPLE, VALUE, ExprMatrix, cache_small
from ..operators.filters import select_coding_genes
from ..operators.joins import attach_filename, match_samples
from ..operators.sampling import RANK, seeded_rank, stratified_sample
from ..operators.selection import top_variance_genes
from ..sources.matrix_io import write_matrix


def prepare_bulk_dataset(features: ExprMatrix, labels: DataFrame, file_map: DataFrame, label_id: str,
                         label_col: str, gene_list: DataFrame | None = None, gene_list_col: str = GENE,
                         out: str | None = None, fmt: str = "parquet") -> tuple[ExprMatrix, DataFrame]:
    """Attach each label row's file name through the metadata map (J1), key the
    labels by that file's sample key, keep samples with both features and a label
    (P3 + J2), keep coding genes (P5) and optionally write both tables (S11).

    ``features`` comes from ``read_sample_files`` (keys are file or folder names);
    ``file_map`` from ``read_file_map`` (``id``, ``file_name``); ``labels`` has
    ``label_id`` and ``label_col``. Returns the matrix and ``(sample_id, label)``.
    """
    lab = (attach_filename(labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("label")),
                           file_map, "id")
           .dropna(subset=["file_name", "label"])
           .select(F.col("file_name").alias(SAMPLE), "label"))
    present = features.cells.select(SAMPLE).distinct()
    _, lab = match_samples(present, lab, SAMPLE)
    lab = cache_small(lab)
    m = features.restrict_samples(lab.select(SAMPLE), lab.count())
    if gene_list is not None:
        m = select_coding_genes(m, gene_list, gene_list_col)
    if out:
        write_matrix(m.cells, out.rstrip("/") + "/features", fmt)
        write_matrix(lab, out.rstrip("/") + "/labels", fmt)
    return m, lab


def undersample_dataset(m: ExprMatrix, labels: DataFrame, n_genes: int, n_samples: int,
                        label: str = "label", seed: int = 42, out: str | None = None) -> tuple[ExprMatrix, DataFrame]:
    """The n_genes most variable genes (K2) of a class-stratified, seeded sample
    of n_samples samples (M2); optionally written as parquet (S11)."""
    lab = cache_small(stratified_sample(labels.join(m.samples, SAMPLE, "left_semi"), label, n_samples, SAMPLE, seed))
    sub = m.restrict_samples(lab.select(SAMPLE), lab.count())
    top = cache_small(top_variance_genes(m, n_genes))
    sub = sub.restrict_genes(top.select(GENE), min(n_genes, m.n_genes))
    if out:
        write_matrix(sub.cells, out.rstrip("/") + "/features")
        write_matrix(lab, out.rstrip("/") + "/labels")
    return sub, lab


def subsample_grid(m: ExprMatrix, ns: list[int], fs: list[int], seed: int = 42, out: str | None = None) -> DataFrame:
    """C11: for every (n, f) of ns × fs, the seeded sample of n samples and f genes
    (M3), tagged ``n_samples, n_genes``; written partitioned by those two columns.

    Seeded samples are nested (the first n in one fixed order), so all grid cells come
    from one pass: each stored cell is ranked once and emitted for every (n, f) that
    contains it.
    """
    sr = cache_small(seeded_rank(m.samples, SAMPLE, seed).withColumnRenamed(RANK, "_sr")
                     .filter(F.col("_sr") < max(ns)))
    gr = cache_small(seeded_rank(m.genes, GENE, seed).withColumnRenamed(RANK, "_gr")
                     .filter(F.col("_gr") < max(fs)))
    grid = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f")) for n in ns for f in fs])
    cells = m.cells.join(m.samples_bc(sr), SAMPLE).join(m.genes_bc(gr), GENE)
    fit = F.filter(grid, lambda p: (F.col("_sr") < p["n"]) & (F.col("_gr") < p["f"]))
    res = (cells.select(SAMPLE, GENE, VALUE, F.explode(fit).alias("_p"))
           .select(F.col("_p.n").alias("n_samples"), F.col("_p.f").alias("n_genes"), SAMPLE, GENE, VALUE))
    if out:
        write_matrix(res, out, "parquet", partition_by=["n_samples", "n_genes"])
    return res
