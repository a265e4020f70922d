"""The expression matrix, held as Spark data rather than one column per gene.

Canonical form (long, sparse): ``cells(sample_id, gene_id, value)`` holds the stored
cells; a (sample, gene) pair that is not stored is 0.0. The full shape is given by two
dimension tables, ``samples(sample_id)`` and ``genes(gene_id)``, so all-zero genes and
all-zero samples still exist. Statistics that need the zeros (means, variances,
per-sample quantiles) get them analytically from the dimension counts, never by
materialising the dense product of samples and genes.

Second form (row-array): ``(sample_id, values array<double>)`` plus a gene index
``genes(gene_idx, gene_id)``; used for ML and for dense outputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = "sample_id"
GENE = "gene_id"
VALUE = "value"
GENE_IDX = "gene_idx"
VALUES = "values"

# Upper bounds for broadcasting a dimension-sized table. The row counts are checked
# (``ExprMatrix.n_samples`` / ``n_genes``) before any broadcast hint is given; above
# the bound the join is left to a shuffle join planned by Catalyst/AQE.
MAX_BROADCAST_GENES = 2_000_000
MAX_BROADCAST_SAMPLES = 2_000_000


def missing_to_null(value: Column) -> Column:
    """A missing value is NULL in this package, also where a file has NaN."""
    return F.when(~F.isnan(value), value)


def checked_broadcast(df: DataFrame, n_rows: int, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when its known row count is within ``max_rows``."""
    return F.broadcast(df) if n_rows <= max_rows else df


def counted_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_SAMPLES) -> tuple[DataFrame, int]:
    """Cache a small lookup table, count it, and broadcast it only within ``max_rows``;
    beyond that the join is left to a shuffle join. Returns (table, row count)."""
    df = df.cache()
    n = df.count()
    return checked_broadcast(df, n, max_rows), n


def materialize(df: DataFrame, name: str = "t", bucket_by: str | None = None,
                n_buckets: int | None = None) -> DataFrame:
    """Write an intermediate table under the shared checkpoint folder and read it back.

    For tables read by several passes (the stored cells of a matrix). One write job;
    the lineage is cut, so a lost executor never recomputes upstream scans, and the
    files give the optimizer real sizes. With ``bucket_by`` the table is written
    bucketed on that key (an external table at the scratch path): the shuffle is paid
    once at write time and every later aggregate or join on the key reads the
    buckets as they lie, without another exchange.
    """
    import uuid

    from .session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # Buckets: the cluster's shuffle-partition setting, but never more than four per
    # core (a small deployment with the default of 200 would only write empty files).
    n = n_buckets or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                4 * spark.sparkContext.defaultParallelism))
    table_name = f"exprmat_{name}_{uuid.uuid4().hex[:12]}"
    # Hash-partition on the bucket key first so each task writes exactly one bucket file.
    (df.repartition(n, bucket_by).write.mode("overwrite").option("path", path)
     .bucketBy(n, bucket_by).sortBy(bucket_by).saveAsTable(table_name))
    return spark.table(table_name)


def cache_small(df: DataFrame) -> DataFrame:
    """Pin a small derived table (gene-, sample- or class-sized) that is read again.

    The table is computed once (cached), written by a reliable ``checkpoint`` to the
    shared folder named by ``spark.checkpoint.dir``, and the cache is dropped. Later
    plans start from the checkpoint files: they stay shallow (analysis and cache
    matching do not grow with pipeline depth), nothing piles up in executor memory,
    and a lost executor never recomputes the upstream passes.
    """
    from .session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    df = df.cache()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


@dataclass
class ExprMatrix:
    cells: DataFrame
    samples: DataFrame
    genes: DataFrame
    _n_samples: int | None = field(default=None, repr=False)
    _n_genes: int | None = field(default=None, repr=False)

    # ---------------------------------------------------------------- construction
    @classmethod
    def from_cells(cls, cells: DataFrame, samples: DataFrame | None = None,
                   genes: DataFrame | None = None, drop_zeros: bool = False) -> ExprMatrix:
        """Build a matrix from stored cells; dimensions default to the ids seen in them.

        Cells must be unique per (sample_id, gene_id); ``drop_zeros`` removes stored
        zeros, which never changes a result but shrinks the data. A missing value (NULL
        or NaN) stays stored as NULL: statistics skip it, it is not a zero.
        """
        cells = cells.select(SAMPLE, GENE, missing_to_null(F.col(VALUE).cast("double")).alias(VALUE))
        if drop_zeros:
            cells = cells.filter((F.col(VALUE) != 0.0) | F.col(VALUE).isNull())
        if samples is None:
            samples = cache_small(cells.select(SAMPLE).distinct())
        if genes is None:
            genes = cache_small(cells.select(GENE).distinct())
        return cls(cells, samples.select(SAMPLE), genes.select(GENE))

    def materialized(self) -> ExprMatrix:
        """The same matrix with its cells written once to the checkpoint folder (for
        matrices whose cells come from an expensive plan and are read several times)."""
        return ExprMatrix(materialize(self.cells, "cells", bucket_by=SAMPLE), self.samples, self.genes,
                          self._n_samples, self._n_genes)

    # ---------------------------------------------------------------- shape
    @property
    def n_samples(self) -> int:
        if self._n_samples is None:
            self._n_samples = self.samples.count()
        return self._n_samples

    @property
    def n_genes(self) -> int:
        if self._n_genes is None:
            self._n_genes = self.genes.count()
        return self._n_genes

    def genes_bc(self, genes_df: DataFrame | None = None) -> DataFrame:
        """A gene-sized table, broadcast when the gene count allows it."""
        return checked_broadcast(self.genes if genes_df is None else genes_df,
                                 self.n_genes, MAX_BROADCAST_GENES)

    def samples_bc(self, samples_df: DataFrame | None = None) -> DataFrame:
        """A sample-sized table, broadcast when the sample count allows it."""
        return checked_broadcast(self.samples if samples_df is None else samples_df,
                                 self.n_samples, MAX_BROADCAST_SAMPLES)

    # ---------------------------------------------------------------- derivation
    def with_cells(self, cells: DataFrame) -> ExprMatrix:
        """Same shape, new stored cells."""
        return ExprMatrix(cells, self.samples, self.genes, self._n_samples, self._n_genes)

    def map_values(self, fn) -> ExprMatrix:
        """Apply an element-wise function with fn(0) == 0, so absent cells stay 0."""
        return self.with_cells(self.cells.withColumn(VALUE, fn(F.col(VALUE))))

    def restrict_genes(self, keep: DataFrame, n_keep: int | None = None) -> ExprMatrix:
        """Keep only the genes in ``keep(gene_id)`` (a left-semi join on cells and genes)."""
        keep = keep.select(GENE)
        if n_keep is None:
            keep = cache_small(keep)
            n_keep = keep.count()
        keep_bc = checked_broadcast(keep, n_keep, MAX_BROADCAST_GENES)
        cells = self.cells.join(keep_bc, GENE, "left_semi")
        genes = self.genes.join(keep_bc, GENE, "left_semi")
        return ExprMatrix(cells, self.samples, genes, self._n_samples, n_keep)

    def restrict_samples(self, keep: DataFrame, n_keep: int | None = None) -> ExprMatrix:
        """Keep only the samples in ``keep(sample_id)``."""
        keep = keep.select(SAMPLE)
        if n_keep is None:
            keep = cache_small(keep)
            n_keep = keep.count()
        keep_bc = checked_broadcast(keep, n_keep, MAX_BROADCAST_SAMPLES)
        cells = self.cells.join(keep_bc, SAMPLE, "left_semi")
        samples = self.samples.join(keep_bc, SAMPLE, "left_semi")
        return ExprMatrix(cells, samples, self.genes, n_keep, self._n_genes)

    # ---------------------------------------------------------------- layouts
    def _with_empty_samples(self, per_sample: DataFrame) -> DataFrame:
        """Per-sample rows plus a row of NULLs for every sample without a stored cell: one
        outer join on the sample key, which the grouping above already partitioned by."""
        return self.samples.select(SAMPLE).join(per_sample, SAMPLE, "left")

    def gene_index(self, order_by: str | Column = GENE) -> DataFrame:
        """``genes(gene_idx, gene_id)`` with a dense 0-based index in ``order_by`` order.

        Ranked with the distributed range-partition ranker (no single-task window);
        it only reads the gene table, never the cells.
        """
        from .operators.sampling import RANK, global_rank

        g = self.genes.select(GENE) if isinstance(order_by, str) and order_by == GENE else \
            self.genes.select(GENE, order_by.alias("_o") if not isinstance(order_by, str) else F.col(order_by).alias("_o"))
        order = [GENE] if "_o" not in g.columns else ["_o", GENE]
        return global_rank(g, order, n_rows=self.n_genes).select(GENE, F.col(RANK).cast("int").alias(GENE_IDX))

    def to_row_array(self, gene_index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Dense row-array form ``(sample_id, values)`` plus the gene index used.

        Each sample's stored cells (at most n_genes of them) are gathered in position
        order and the gaps between them filled with zeros, so a row costs O(n_genes).
        Samples with no stored cell still get a row of zeros; a stored NULL stays NULL.
        """
        if gene_index is None:
            gene_index = cache_small(self.gene_index())
        g = self.n_genes
        if g == 0:
            return self.samples.select(SAMPLE, F.array().cast("array<double>").alias(VALUES)), gene_index
        idx_bc = checked_broadcast(gene_index, g, MAX_BROADCAST_GENES)
        per_sample = (self.cells.join(idx_bc, GENE).groupBy(SAMPLE)
                      .agg(F.sort_array(F.collect_list(F.struct(F.col(GENE_IDX).alias("i"), F.col(VALUE).alias("v")))).alias("_e")))
        rows = self._with_empty_samples(per_sample)

        def zeros(n: Column) -> Column:
            return F.array_repeat(F.lit(0.0), n.cast("int"))

        # the entry before each one, by position: its end is where the gap starts
        before = F.concat(F.array(F.lit(-1)), F.transform("_e", lambda e: e["i"]))
        parts = F.zip_with("_e", F.slice(before, 1, F.size("_e")),
                           lambda e, at: F.concat(zeros(e["i"] - at - 1), F.array(e["v"])))
        tail = zeros(F.lit(g - 1) - F.element_at(before, -1))
        values = F.when(F.col("_e").isNull(), zeros(F.lit(g))).otherwise(F.concat(F.flatten(parts), tail))
        return rows.select(SAMPLE, values.alias(VALUES)), gene_index

    @staticmethod
    def row_array_to_long(rows: DataFrame, gene_index: DataFrame, n_genes: int,
                          drop_zeros: bool = False) -> DataFrame:
        """``(sample_id, values)`` → ``(sample_id, gene_id, value)`` via posexplode."""
        idx_bc = checked_broadcast(gene_index, n_genes, MAX_BROADCAST_GENES)
        long = rows.select(SAMPLE, F.posexplode(VALUES).alias(GENE_IDX, VALUE))
        if drop_zeros:
            long = long.filter((F.col(VALUE) != 0.0) | F.col(VALUE).isNull())
        return long.join(idx_bc, GENE_IDX).select(SAMPLE, GENE, VALUE)

    @classmethod
    def from_row_array(cls, rows: DataFrame, id_col: str = SAMPLE, values_col: str = VALUES,
                       gene_ids: list[str] | None = None, drop_zeros: bool = True) -> ExprMatrix:
        """Row-array input (e.g. a parquet column ``array<float>``) → long matrix.

        Gene ids are the array positions unless names are given. The gene table is
        built from the arrays' width, which all rows must share: unequal rows raise.
        Missing values (NULL, NaN) stay stored as NULL.
        """
        spark = rows.sparkSession
        base = rows.select(F.col(id_col).alias(SAMPLE),
                           F.transform(values_col, lambda x: missing_to_null(x.cast("double"))).alias(VALUES))
        least, most = base.agg(F.min(F.size(VALUES)), F.max(F.size(VALUES))).first()
        width = (most or 0) if gene_ids is None else len(gene_ids)
        if most is not None and (least != width or most != width):
            raise ValueError(f"rows hold {least} to {most} values; all must hold {width}")
        if gene_ids is None:
            gene_index = spark.range(width).select(F.col("id").cast("int").alias(GENE_IDX),
                                                   F.col("id").cast("int").alias(GENE))
        else:
            gene_index = spark.createDataFrame(list(enumerate(gene_ids)), f"{GENE_IDX} int, {GENE} string")
        cells = cls.row_array_to_long(base, gene_index, width, drop_zeros=drop_zeros)
        samples = base.select(SAMPLE)
        return cls(cells, samples, gene_index.select(GENE), None, width)

    def dense_long(self) -> DataFrame:
        """All n_samples × n_genes cells as ``(sample_id, gene_id, value)``, zeros included.

        Each sample's stored cells are laid out as a dense row (grouped by sample: no
        exchange when the cells are bucketed by sample) and exploded by position; the
        gene ids come from the broadcast gene index. One pass over the cells.
        """
        return self.dense_cells()

    def dense_cells(self) -> DataFrame:
        """All n_samples × n_genes cells, zeros included (for small outputs and checks)."""
        rows, idx = self.to_row_array()
        return self.row_array_to_long(rows, idx, self.n_genes)

