"""Matrix transforms: upper-quartile normalisation, log transforms, log-normalisation,
variance scaling (SURVEY §2.11 C1, C3, C5 and §2.8 F1–F6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..matrix import (GENE, GENE_IDX, MAX_BROADCAST_SAMPLES, SAMPLE, VALUE, VALUES,
                      ExprMatrix, checked_broadcast, cache_small)
from .filters import drop_zero_genes
from .stats import gene_stats, gene_stats_by_batch, geometric_mean, sample_stats


def upper_quartile_factors(m: ExprMatrix, q: float = 0.75, on_empty_sample: str = "error") -> DataFrame:
    """Per-sample ``(sample_id, norm_factor, scaling_factor)`` of upper-quartile normalisation.

    Genes whose mean over all samples is ≤ 0 are left out first (P6); then per sample
    norm_factor = quantile_q / total (A4, A5), and scaling_factor = norm_factor divided
    by the geometric mean of all norm factors with zeros counted as 1 (A6).

    A sample whose total is 0 makes every factor undefined in the reference (0/0);
    ``on_empty_sample='error'`` raises, ``'drop'`` leaves such samples out.
    """
    if on_empty_sample not in ("error", "drop"):
        raise ValueError("on_empty_sample must be 'error' or 'drop'")
    fit = drop_zero_genes(m)
    per = cache_small(sample_stats(fit, q))
    n_ok = per.filter(F.col("total") != 0).count()
    if on_empty_sample == "error" and n_ok != m.n_samples:
        # Samples missing from the cells are all-zero too, so counts decide it.
        raise ValueError(f"upper_quartile: {m.n_samples - n_ok} sample(s) have no nonzero value "
                         "(pass on_empty_sample='drop' to leave them out)")
    nf = per.filter(F.col("total") != 0).select(SAMPLE, F.try_divide("quantile", "total").alias("norm_factor"))
    geo = geometric_mean(nf, "norm_factor")
    return nf.select(SAMPLE, "norm_factor", (F.col("norm_factor") / geo).alias("scaling_factor"))


def zero_factor_samples(factors: DataFrame) -> DataFrame:
    """``(sample_id)`` of the samples whose factor is 0: their upper quartile is 0 although they
    hold values, so normalisation turns all of them into 0 (Q12). Empty where none is lost."""
    return factors.filter(F.col("norm_factor") == 0).select(SAMPLE)


def upper_quartile_normalize(m: ExprMatrix, q: float = 0.75, on_empty_sample: str = "error",
                             factors: DataFrame | None = None) -> ExprMatrix:
    """Multiply every cell of the *unfiltered* matrix by its sample's scaling factor.

    As in the reference the factor is multiplied in, not divided out (Q15), and the
    genes dropped while fitting stay in the output (Q5). ``factors`` may be a table
    fitted earlier (e.g. on training samples).
    """
    if factors is None:
        factors = upper_quartile_factors(m, q, on_empty_sample)
    n_f = factors.count() if on_empty_sample == "drop" else m.n_samples
    f_bc = checked_broadcast(factors.select(SAMPLE, "scaling_factor"), n_f, MAX_BROADCAST_SAMPLES)
    cells = (m.cells.join(f_bc, SAMPLE)
             .select(SAMPLE, GENE, (F.col(VALUE) * F.col("scaling_factor")).alias(VALUE)))
    out = m.with_cells(cells)
    if on_empty_sample == "drop":
        out = out.restrict_samples(factors.select(SAMPLE), n_f)
    return out


def log2p1(m: ExprMatrix) -> ExprMatrix:
    """log2(x + 1) on every cell (0 stays 0)."""
    return m.map_values(fx.log2p1)


def log_normalize(m: ExprMatrix, scale: float = 1e4, batches: DataFrame | None = None,
                  batch: str = "batch") -> ExprMatrix:
    """X / gene_total (0 → 1e-6) × scale, then ln with 0 replaced by 1.

    Totals are per gene over all samples (the pandas path, D0.4); with ``batches``
    (``sample_id, batch``) they are per gene within each batch, the reference's
    per-partition Dask behaviour made explicit (Q1). The totals are a gene-sized
    table joined by broadcast when the gene count allows.
    """
    f = lambda v, t: fx.ln_zero_as_one(fx.guarded_div(v, t) * F.lit(float(scale)))
    if batches is None:
        totals = cache_small(gene_stats(m).select(GENE, "total"))
        cells = m.cells.join(m.genes_bc(totals), GENE)
    else:
        totals = cache_small(gene_stats_by_batch(m, batches, batch).select(batch, GENE, "total"))
        cells = (m.cells.join(m.samples_bc(batches.select(SAMPLE, batch)), SAMPLE)
                 .join(totals, [batch, GENE]))
    return m.with_cells(cells.select(SAMPLE, GENE, f(F.col(VALUE), F.col("total")).alias(VALUE)))


def scale_by_variance(m: ExprMatrix, by: str = "var", batches: DataFrame | None = None,
                      batch: str = "batch", stats: DataFrame | None = None) -> DataFrame:
    """C5 as a dense long table ``(sample_id, gene_id, value)`` with (x − mean)/var.

    The result is dense (an absent zero becomes −mean/var), so each sample's stored
    cells are first laid out as a dense row (grouped by sample; no shuffle when the
    cells are bucketed by sample), exploded, and joined to the per-gene mean and
    divisor, a gene-sized table broadcast after its size check. A constant gene has
    variance 0 and gives NULL (try_divide) where pandas gives NaN (Q14); ``by='std'``
    divides by the standard deviation (Q13). With ``batches`` the mean and variance
    are taken within each batch of samples (Q2). ``stats`` passes per-gene
    ``gene_id, mean, var`` already computed over the same samples (saves a pass).
    """
    if by not in ("var", "std"):
        raise ValueError("by must be 'var' or 'std'")
    long = m.dense_long()
    div = lambda c: c if by == "var" else F.sqrt(c)
    if batches is None:
        st = cache_small((stats if stats is not None else gene_stats(m))
                         .select(GENE, "mean", div(F.col("var")).alias("div")))
        joined = long.join(m.genes_bc(st), GENE)
    else:
        st = cache_small(gene_stats_by_batch(m, batches, batch)
                         .select(batch, GENE, "mean", div(F.col("var")).alias("div")))
        joined = (long.join(m.samples_bc(batches.select(SAMPLE, batch)), SAMPLE)
                  .join(st, [batch, GENE], "left")
                  .withColumn("mean", F.coalesce("mean", F.lit(0.0)))
                  .withColumn("div", F.coalesce("div", F.lit(0.0))))
    return joined.select(SAMPLE, GENE, F.try_divide(F.col(VALUE) - F.col("mean"), F.col("div")).alias(VALUE))


def scale_genes_rows(m: ExprMatrix, by: str = "var") -> tuple[DataFrame, DataFrame]:
    """C5 in dense row-array form ``(sample_id, values)`` plus the gene index
    ``(gene_id, gene_idx)`` giving the array positions (genes in id order).

    Built from the long result; the exploded rows keep their hash partitioning by
    sample, so gathering them back per sample adds no shuffle.
    """
    idx = cache_small(m.gene_index())
    long = scale_by_variance(m, by).join(m.genes_bc(idx), GENE)
    rows = (long.groupBy(SAMPLE)
            .agg(F.array_sort(F.collect_list(F.struct(GENE_IDX, VALUE))).alias("_e"))
            .select(SAMPLE, F.transform("_e", lambda e: e[VALUE]).alias(VALUES)))
    return rows, idx
