"""Fit/transform wrappers.

``UpperQuartileNormalizer`` is an MLlib Estimator over long cells
``(sample_id, gene_id, value)``: ``fit`` learns the per-sample scaling factors (C1),
``transform`` multiplies them in. ``map_batches`` is the user hook for a pandas
function per batch (the reference's ``map_partitions``).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import (GENE, MAX_BROADCAST_GENES, MAX_BROADCAST_SAMPLES, SAMPLE, VALUE, ExprMatrix, cache_small,
                      checked_broadcast)
from .filters import drop_zero_genes
from .stats import sample_stats
from .transforms import upper_quartile_factors


class UpperQuartileNormalizer(Estimator):
    """Upper-quartile normalisation as an Estimator (fit on one table, apply to any)."""

    q = Param(Params._dummy(), "q", "upper quantile of each sample", typeConverter=TypeConverters.toFloat)
    onEmptySample = Param(Params._dummy(), "onEmptySample", "'error' or 'drop' for all-zero samples",
                          typeConverter=TypeConverters.toString)

    def __init__(self, q: float = 0.75, onEmptySample: str = "error"):
        super().__init__()
        self._setDefault(q=0.75, onEmptySample="error")
        self._set(q=q, onEmptySample=onEmptySample)

    def _fit(self, dataset: DataFrame) -> UpperQuartileModel:
        m = ExprMatrix.from_cells(dataset.select(SAMPLE, GENE, VALUE))
        q, on_empty = self.getOrDefault(self.q), self.getOrDefault(self.onEmptySample)
        genes = cache_small(drop_zero_genes(m).genes)
        return UpperQuartileModel(cache_small(upper_quartile_factors(m, q, on_empty)), genes, q, on_empty)


class UpperQuartileModel(Model):
    """Fitted per-sample factors, the genes they were fitted on and the geometric mean of
    the norm factors. ``transform`` multiplies each cell by its sample's factor; a sample
    that the model has not seen gets a factor from its own values of the fitted genes."""

    def __init__(self, factors: DataFrame, genes: DataFrame, q: float = 0.75, on_empty_sample: str = "error"):
        super().__init__()
        self.factors, self.genes, self.q, self.on_empty_sample = factors, genes, q, on_empty_sample

    def _new_factors(self, cells: DataFrame) -> DataFrame:
        """``(sample_id, scaling_factor)`` of the samples of ``cells`` that are not fitted."""
        known = checked_broadcast(self.factors.select(SAMPLE), self.factors.count(), MAX_BROADCAST_SAMPLES)
        new = cells.join(known, SAMPLE, "left_anti")
        samples = cache_small(new.select(SAMPLE).distinct())
        n_genes = self.genes.count()
        fitted = new.join(checked_broadcast(self.genes, n_genes, MAX_BROADCAST_GENES), GENE, "left_semi")
        per = sample_stats(ExprMatrix(fitted, samples, self.genes, None, n_genes), self.q).filter(F.col("total") != 0)
        per = cache_small(per)
        if self.on_empty_sample == "error" and (missing := samples.count() - per.count()):
            raise ValueError(f"upper_quartile: {missing} new sample(s) have no nonzero value of a fitted gene")
        geo = self.factors.select(F.try_divide("norm_factor", "scaling_factor").alias("g")).agg(F.max("g")).scalar()
        return per.select(SAMPLE, (F.try_divide("quantile", "total") / geo).alias("scaling_factor"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        f = cache_small(self.factors.select(SAMPLE, "scaling_factor").unionByName(self._new_factors(dataset.select(SAMPLE, GENE, VALUE))))
        f = checked_broadcast(f, f.count(), MAX_BROADCAST_SAMPLES)
        return (dataset.join(f, SAMPLE)
                .withColumn(VALUE, F.col(VALUE) * F.col("scaling_factor")).drop("scaling_factor"))


def map_batches(df: DataFrame, fn, schema, batch_col: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Run a pandas function per batch.

    With ``batch_col`` each batch is handed to one Python worker whole
    (``applyInPandas``). ``max_rows`` splits the batches into parts of about so many
    rows each (by a hash of the row), so that a large batch is no hot task; the caller
    combines the parts' results. Without ``batch_col`` the function runs on the Arrow
    batches of each partition (``mapInPandas``).
    """
    if batch_col is None:
        return df.mapInPandas(lambda it: (fn(p) for p in it), schema)
    if max_rows is None:
        return df.groupBy(batch_col).applyInPandas(fn, schema)
    parts = max(1, -(-df.count() // max_rows))
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    return df.withColumn("_part", part).groupBy(batch_col, "_part").applyInPandas(lambda p: fn(p.drop(columns="_part")), schema)
