"""Baseline-plus-sparse matrices: a dense matrix that costs what its stored cells cost.

Scaling turns an absent zero of a gene into −mean/div, the same number for every sample. A
``BaselineMatrix`` holds that number once per gene and only the cells that differ from it:

    value(s, g) = the stored cell of (s, g), or else ``baseline`` of g.

Statistics, per-sample aggregates, projections and row arrays are computed on this form; the
samples × genes rows exist only where a caller asks for them (``to_row_array``, ``dense_long``).
A gene whose scaling is undefined (variance 0) has a NULL baseline and NULL cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE, GENE_IDX, MAX_BROADCAST_GENES, SAMPLE, VALUE, VALUES, ExprMatrix, cache_small, checked_broadcast
from . import exact
from .sampling import RANK, global_rank
from .stats import gene_stats

BASELINE = "baseline"


@dataclass
class BaselineMatrix:
    """``cells(sample_id, gene_id, value)``, ``samples(sample_id)``, ``genes(gene_id, baseline)``."""

    cells: DataFrame
    samples: DataFrame
    genes: DataFrame
    n_samples: int
    n_genes: int

    def genes_bc(self, genes: DataFrame | None = None) -> DataFrame:
        return checked_broadcast(self.genes if genes is None else genes, self.n_genes, MAX_BROADCAST_GENES)

    # ---------------------------------------------------------------- statistics
    def gene_state(self) -> DataFrame:
        """The exact moment state of every gene over all samples: the stored cells' state plus
        that of the baseline, as often as the gene has no stored cell. A NULL baseline counts as missing."""
        stored = exact.moment_state(self.cells, [GENE])
        once = exact.moment_state(self.genes.select(GENE, F.col(BASELINE).alias(VALUE)), [GENE])
        both = once.select(GENE, *[F.col(c).alias(f"_{c}") for c in exact.STATE]).join(stored, GENE, "left")
        left = F.lit(self.n_samples).cast("bigint") - F.coalesce(F.col("k") + F.col("missing"), F.lit(0))
        return both.select(GENE, *[(F.coalesce(c, F.lit(0)) + left * F.col(f"_{c}")).cast("bigint").alias(c) for c in exact.STATE])

    def gene_stats(self) -> DataFrame:
        """``(gene_id, n, total, mean, var)`` of the whole matrix (A1–A3)."""
        state = self.gene_state().withColumn("_rows", F.lit(self.n_samples).cast("bigint"))
        return exact.finish(state, [GENE], "_rows").drop("var_pop")

    def sample_totals(self) -> DataFrame:
        """``(sample_id, n, total, least, greatest)`` of each sample's values over all genes, NULLs left out.

        The total is the baselines' sum, once, and the stored cells' differences from it. The
        extremes are those of the stored cells and of the baselines of the other genes. Genes are
        ranked by baseline; the least one a sample does not store is at the first gap in its
        sorted ranks, the greatest at the last.
        """
        known = cache_small(global_rank(self.genes.where(F.col(BASELINE).isNotNull()), [BASELINE, GENE], n_rows=self.n_genes))
        line = known.agg(F.count("*").cast("int").alias("_n"), F.coalesce(F.sum(BASELINE), F.lit(0.0)).alias("_sum"),
                         F.transform(F.sort_array(F.collect_list(F.struct(RANK, BASELINE))), lambda x: x[BASELINE]).alias("_base"))
        per = self.cells.join(self.genes_bc(known), GENE).groupBy(SAMPLE).agg(
            F.count_if(F.col(VALUE).isNull()).alias("_null"), F.sum(F.coalesce(VALUE, F.lit(0.0)) - F.col(BASELINE)).alias("_more"),
            F.min(VALUE).alias("_lo"), F.max(VALUE).alias("_hi"), F.sort_array(F.collect_list(F.col(RANK).cast("int"))).alias("_ranks"))
        rows = self.samples.join(per, SAMPLE, "left").withColumn("_one", F.lit(1)).join(
            F.broadcast(cache_small(line).withColumn("_one", F.lit(1))), "_one")
        ranks = F.coalesce("_ranks", F.array().cast("array<int>"))
        # different sorted numbers from 0 on: place and number agree just as far as there is no gap
        low = F.size(F.filter(ranks, lambda x, i: x == i))
        high = F.col("_n") - 1 - F.size(F.filter(F.reverse(ranks), lambda x, i: x == F.col("_n") - 1 - i))
        return rows.select(
            SAMPLE, (F.col("_n") - F.coalesce("_null", F.lit(0))).cast("bigint").alias("n"), (F.col("_sum") + F.coalesce("_more", F.lit(0.0))).alias("total"),
            F.least("_lo", F.get("_base", low)).alias("least"),
            F.greatest("_hi", F.when(high >= 0, F.get("_base", high))).alias("greatest"))

    def project(self, weights: DataFrame, component: str = "component", weight: str = "weight") -> DataFrame:
        """``(sample_id, component, value)``: each sample's values times a weight per gene, added up
        (``weights(gene_id, component, weight)``, e.g. loadings). Genes with a NULL baseline are left out."""
        known = self.genes_bc(self.genes.where(F.col(BASELINE).isNotNull()))
        w = weights.select(GENE, component, weight).join(known, GENE)
        base = w.groupBy(component).agg(F.sum(F.col(BASELINE) * F.col(weight)).alias("_base"))
        more = (self.cells.join(w, GENE).groupBy(SAMPLE, component)
                .agg(F.sum((F.coalesce(VALUE, F.lit(0.0)) - F.col(BASELINE)) * F.col(weight)).alias("_more")))
        # every sample has every component: a table of samples × components, which is the result's size
        comps = base.agg(F.collect_list(F.struct(component, "_base")).alias("_c"))
        every = self.samples.withColumn("_one", F.lit(1)).join(F.broadcast(comps.withColumn("_one", F.lit(1))), "_one")
        every = every.select(SAMPLE, F.explode("_c").alias("_e")).select(SAMPLE, f"_e.{component}", "_e._base")
        return every.join(more, [SAMPLE, component], "left").select(
            SAMPLE, component, (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias(VALUE))

    def top_values(self, k: int) -> DataFrame:
        """``(sample_id, gene_id, value)``: each sample's k stored cells of greatest value, ties by gene id."""
        best = F.struct((-F.col(VALUE)).alias("o"), F.col(GENE).alias("g"), F.col(VALUE).alias("v"))
        per = self.cells.where(F.col(VALUE).isNotNull()).groupBy(SAMPLE).agg(F.slice(F.sort_array(F.collect_list(best)), 1, k).alias("_t"))
        return per.select(SAMPLE, F.explode("_t").alias("_e")).select(SAMPLE, F.col("_e.g").alias(GENE), F.col("_e.v").alias(VALUE))

    # ---------------------------------------------------------------- dense forms, on request
    def to_row_array(self) -> tuple[DataFrame, DataFrame]:
        """``(sample_id, values)`` with every gene's value in gene id order, and the gene index.

        The baselines are one array, which every row copies; the row's stored cells replace their places.
        """
        index = cache_small(ExprMatrix(self.cells, self.samples, self.genes.select(GENE), self.n_samples, self.n_genes).gene_index())
        line = self.genes.join(index, GENE).agg(F.sort_array(F.collect_list(F.struct(GENE_IDX, BASELINE))).alias("_l"))
        line = line.select(F.lit(1).alias("_one"), F.transform("_l", lambda x: x[BASELINE]).alias("_base"))
        stored = (self.cells.join(self.genes_bc(index), GENE).groupBy(SAMPLE)
                  .agg(F.map_from_entries(F.collect_list(F.struct(GENE_IDX, VALUE))).alias("_own")))
        rows = self.samples.join(stored, SAMPLE, "left").withColumn("_one", F.lit(1)).join(F.broadcast(line), "_one")
        own = F.coalesce("_own", F.map_from_entries(F.array().cast(f"array<struct<{GENE_IDX}:int,{VALUE}:double>>")))
        rows = rows.withColumn("_own", own)
        values = F.transform("_base", lambda b, i: F.when(F.map_contains_key("_own", i), F.col("_own")[i]).otherwise(b))
        return rows.select(SAMPLE, values.alias(VALUES)), index

    def dense_long(self) -> DataFrame:
        """All samples × genes as ``(sample_id, gene_id, value)``."""
        rows, index = self.to_row_array()
        return ExprMatrix.row_array_to_long(rows, index, self.n_genes)


def scale_sparse(m: ExprMatrix, by: str = "var", stats: DataFrame | None = None) -> BaselineMatrix:
    """C5 without dense rows: stored cells become (x − mean)/div, absent ones the baseline −mean/div.

    Equal to ``scale_by_variance`` cell by cell. ``stats`` passes per-gene ``gene_id, mean, var``
    computed over the same samples.
    """
    if by not in ("var", "std"):
        raise ValueError("by must be 'var' or 'std'")
    div = F.col("var") if by == "var" else F.sqrt("var")
    st = cache_small((stats if stats is not None else gene_stats(m)).select(GENE, "mean", div.alias("div")))
    cells = m.cells.join(m.genes_bc(st), GENE).select(SAMPLE, GENE, F.try_divide(F.col(VALUE) - F.col("mean"), F.col("div")).alias(VALUE))
    genes = cache_small(st.select(GENE, F.try_divide(F.lit(0.0) - F.col("mean"), F.col("div")).alias(BASELINE)))
    return BaselineMatrix(cells, m.samples.select(SAMPLE), genes, m.n_samples, m.n_genes)
