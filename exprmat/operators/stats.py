"""Per-gene and per-sample statistics on the sparse long matrix.

Absent cells are zeros. They add nothing to Σx and Σx², so a gene's statistics follow from
the sums over its stored cells and the number of samples n:

    mean = Σx / n            var = (n·Σx² − (Σx)²) / (n·(n − 1))          (ddof = 1)

The sums are exact integers (``exact``), so nothing cancels, equal genes have equal
statistics to the last bit, and the partitioning of the cells does not show.

Per-sample quantiles pad each sample's sorted stored values with its z zeros at the
right rank (negative values before them, positive after), so no zero is ever stored.
A missing value (a stored NULL) is skipped: n is the number of the gene's (or the
sample's) values that are not missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE, SAMPLE, VALUE, ExprMatrix, cache_small, counted_broadcast
from . import exact
from .order_stats import exact_quantiles


def gene_state(m: ExprMatrix) -> DataFrame:
    """The moment state of every gene's stored cells (``exact``), zeros for genes without any: what
    may be kept, merged with the state of further samples, or reduced by that of some.

    One partial+final hash aggregate over the cells (map-side combine shrinks each task to
    one row per gene before the shuffle), then a join with the gene table, which is
    bounded by the gene count and broadcast when that count allows.
    """
    state = m.genes_bc().join(exact.moment_state(m.cells, [GENE]), GENE, "left")
    return state.select(GENE, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in exact.STATE])


def gene_stats_from_state(state: DataFrame, n_samples: int) -> DataFrame:
    """``(gene_id, n, total, mean, var)`` of a gene state over ``n_samples`` samples."""
    rows = state.withColumn("_rows", F.lit(n_samples).cast("bigint"))
    return exact.finish(rows, [GENE], "_rows").drop("var_pop")


def gene_stats(m: ExprMatrix) -> DataFrame:
    """``(gene_id, n, total, mean, var)`` for every gene of ``m`` (A1–A3), the same bits
    however the cells are partitioned."""
    return gene_stats_from_state(gene_state(m), m.n_samples)


def gene_stats_by_batch(m: ExprMatrix, batches: DataFrame, batch: str = "batch") -> DataFrame:
    """``(batch, gene_id, n, total, mean, var)`` per batch of samples (Q1/Q2 variant).

    ``batches(sample_id, batch)`` assigns samples to batches; n is the batch's sample
    count, so zeros are padded per batch. Only (batch, gene) pairs with a stored cell
    appear; a missing pair is an all-zero gene in that batch (total = mean = var = 0).
    """
    b = batches.select(SAMPLE, batch)
    n_b, _ = counted_broadcast(b.groupBy(batch).agg(F.count(F.lit(1)).alias("_rows")))
    state = exact.moment_state(m.cells.join(m.samples_bc(b), SAMPLE), [batch, GENE]).join(n_b, batch)
    return exact.finish(state, [batch, GENE], "_rows").drop("var_pop")


def padded_quantile(sorted_vals: Column, n_zeros: Column, n_total: Column, q: float) -> Column:
    """Linear-interpolated quantile of ``sorted_vals`` plus ``n_zeros`` implicit zeros.

    ``sorted_vals`` is ascending. The merged order is: stored negatives, then the
    zeros, then the stored non-negatives; element r (0-based) of the merge is read
    back from the stored array without building the padded array.
    """
    neg = F.size(F.filter(sorted_vals, lambda x: x < 0))

    def at(r: Column) -> Column:
        return (F.when(r < neg, F.element_at(sorted_vals, (r + 1).cast("int")))
                .when(r < neg + n_zeros, F.lit(0.0))
                .otherwise(F.element_at(sorted_vals, (r - n_zeros + 1).cast("int"))))

    h = (n_total - 1).cast("double") * F.lit(float(q))
    lo = F.floor(h)
    frac = h - lo
    hi = F.least(lo + 1, n_total - 1)
    return F.when(n_total <= 0, F.lit(None).cast("double")).otherwise(
        at(lo) + frac * (at(hi) - at(lo)))


def sample_stats(m: ExprMatrix, q: float = 0.75) -> DataFrame:
    """``(sample_id, total, quantile)`` per sample over all n_genes genes (A4, A5).

    One hash aggregate keyed by sample: the sort buffer per sample holds at most
    n_genes stored values (bounded by the gene table, never by the data volume).
    Samples without stored cells are absent here; callers add them from ``samples``.
    """
    g = m.n_genes
    per = (m.cells.groupBy(SAMPLE)
           .agg(F.count(VALUE).alias("_k"),
                F.count_if(F.col(VALUE).isNull()).alias("_m"), F.array_sort(F.collect_list(VALUE)).alias("_s")))
    n = F.lit(g) - F.col("_m")
    # added up in sorted order, so the sum does not depend on the order of the cells
    total = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + x)
    return per.select(SAMPLE, total.alias("total"), padded_quantile(F.col("_s"), n - F.col("_k"), n, q).alias("quantile"))


def zero_as_one(c: Column) -> Column:
    """0 replaced by 1, as the geometric mean counts it."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def geometric_mean_zero_as_one(col: str | Column) -> Column:
    """Aggregate: exp(mean(ln(x with 0 replaced by 1)))."""
    c = F.col(col) if isinstance(col, str) else col
    return F.exp(F.avg(F.ln(zero_as_one(c))))


def geometric_mean(df: DataFrame, col: str) -> Column:
    """The same as a scalar-subquery column, with an exact mean of the logarithms."""
    return exact.exact_mean(df, F.ln(zero_as_one(F.col(col)))).select(F.exp("mean")).scalar()


def stat_quantiles(stats: DataFrame, q: float = 0.25, cols=("mean", "var")) -> DataFrame:
    """One row of exact quantiles of per-gene statistics (A7), found by narrowing (``order_stats``)."""
    got = exact_quantiles(cache_small(stats.select(*cols)), list(cols), q)
    return stats.sparkSession.range(1).select(*[F.lit(got[c]).cast("double").alias(f"q_{c}") for c in cols])
