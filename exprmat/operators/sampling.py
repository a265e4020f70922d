"""Seeded sampling and splits.

Randomness is a deterministic order (D0.7): rows are ordered by the first 8 hex
digits of md5(id || '-' || seed), ties by id. Splits, folds and samples cut that order at
places found by counting (``order_stats``). Where every row needs its rank it is computed without a global single-task window: the rows are range
partitioned on the order key, numbered inside each partition, written once, and
shifted by the row count of all earlier partitions (a table with one row per partition).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_rank_key
from ..matrix import (GENE, MAX_BROADCAST_SAMPLES, SAMPLE, ExprMatrix, cache_small, checked_broadcast,
                      materialize)
from .order_stats import after_cut, rank_cuts

RANK = "_rank"


# Rows per range partition when ranking: ids sort comfortably in one task at this size.
RANK_ROWS_PER_PARTITION = 500_000


def global_rank(df: DataFrame, order: list[str], n_partitions: int | None = None,
                n_rows: int | None = None) -> DataFrame:
    """Add ``_rank`` = 0-based position of each row in ``order`` (columns).

    The rows are range-partitioned on the order columns, numbered inside each partition and
    written once, so partition sizes and positions come from the same exchange, whatever it
    sampled (a second exchange would draw other boundaries). The written rows are read back
    and shifted by the rows of all earlier partitions: nothing is joined on the order columns,
    so rows that share an id, or have none, stay as many as they were. Rows equal in all
    order columns get different ranks next to each other, in no fixed order.
    """
    spark = df.sparkSession
    if n_rows is None and n_partitions is None:
        n_rows = df.count()
    # few rows per task where rows may be wide, up to the session's partitions
    spread = min(math.ceil((n_rows or 0) / 1000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = n_partitions or max(1, spread, math.ceil(n_rows / RANK_ROWS_PER_PARTITION))
    parts = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_local", F.monotonically_increasing_id()))
    parts = materialize(parts.withColumn("_local", F.col("_local") - F.shiftleft(F.col("_pid").cast("bigint"), 33)), "ranks")
    # one row per range partition
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    return (parts.join(F.broadcast(offsets), "_pid")
            .withColumn(RANK, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))


def seeded_rank(df: DataFrame, id_col: str, seed: int = 42, within: str | None = None,
                n_rows: int | None = None) -> DataFrame:
    """``_rank`` in md5(id-seed) order; with ``within``, the rank inside each value of it.

    A rank within a group is the global rank in (group, key, id) order minus the
    group's smallest global rank, so a group holding most rows is still spread over
    all partitions instead of landing in one task.
    """
    key = hash_rank_key(F.col(id_col), seed)
    if within is None:
        return global_rank(df.withColumn("_key", key), ["_key", id_col], n_rows=n_rows).drop("_key")
    ranked = global_rank(df.withColumn("_key", key), [within, "_key", id_col], n_rows=n_rows).drop("_key")
    # the group's first rank is its smallest one: no order over the groups is needed, however many
    starts = cache_small(ranked.groupBy(F.col(within).alias("_w")).agg(F.min(RANK).alias("_start")))
    starts = checked_broadcast(starts, starts.count(), MAX_BROADCAST_SAMPLES)
    return (ranked.join(starts, F.col(within).eqNullSafe(F.col("_w")))
            .withColumn(RANK, F.col(RANK) - F.col("_start")).drop("_w", "_start"))


def _order_key(id_col: str, seed: int) -> Column:
    """The md5 order of an id as an integer; ids that are null come first."""
    return F.coalesce(hash_rank_key(F.col(id_col), seed), F.lit(-1).cast("bigint"))


def train_test_split(df: DataFrame, id_col: str = SAMPLE, test_frac: float = 0.3, seed: int = 42,
                     n_rows: int | None = None) -> DataFrame:
    """M1: add ``split`` ∈ {'train','test'}; the first ceil(test_frac·n) rows in md5 order are
    test (sklearn's test size for a fraction).

    The order is cut at one place, found by narrowing (``order_stats``): no rank is given to any
    row and nothing is shuffled but counts. Rows that share an id are on one side, so with repeated
    ids the test part may hold the rest of the last id's rows too.
    """
    n = df.count() if n_rows is None else n_rows
    n_test = math.ceil(test_frac * n)
    if n_test == 0:
        return df.withColumn("split", F.lit("train"))
    key = _order_key(id_col, seed)
    cut = rank_cuts(df, key, id_col, [n_test - 1])[0]
    return df.withColumn("split", F.when(after_cut(key, id_col, cut), "train").otherwise("test"))


def kfold(df: DataFrame, id_col: str = SAMPLE, k: int = 10, seed: int = 42,
          stratify: str | None = None, n_rows: int | None = None) -> DataFrame:
    """M4/M5: add ``fold`` (0..k-1).

    Plain: shuffled k-fold with contiguous folds in md5 order (sklearn KFold sizes), cut at
    k − 1 places found by narrowing; rows that share an id are in one fold.
    Stratified: within each value of ``stratify``, rank mod k, so every fold gets
    each class in proportion (sizes differ by at most one per class).
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    if stratify is not None:
        return (seeded_rank(df, id_col, seed, within=stratify)
                .withColumn("fold", (F.col(RANK) % k).cast("int")).drop(RANK))
    n = df.count() if n_rows is None else n_rows
    if n < k:
        raise ValueError(f"cannot split {n} rows into {k} folds")
    key = _order_key(id_col, seed)
    ends = [(j + 1) * (n // k) + min(j + 1, n % k) - 1 for j in range(k - 1)]
    after = [after_cut(key, id_col, c).cast("int") for c in rank_cuts(df, key, id_col, ends)]
    return df.withColumn("fold", sum(after[1:], after[0]))


def class_quotas(df: DataFrame, label: str, n: int) -> DataFrame:
    """``(label, n_class, quota)``: floor(n·n_c/N) per class plus one for the classes
    with the largest remainders (ties by label) until the quotas sum to n.

    Runs on the class-count table (one row per class).
    """
    counts = cache_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")))
    total = counts.agg(F.sum("n_class")).scalar()
    exact = F.lit(n) * F.col("n_class") / total
    base = counts.select(label, "n_class", F.floor(exact).alias("_b"), (-(exact - F.floor(exact))).alias("_rem"))
    extra = F.lit(n) - base.agg(F.sum("_b")).scalar()
    ranked = global_rank(base, ["_rem", label])
    return ranked.select(label, "n_class",
                         (F.col("_b") + F.when(F.col(RANK) < extra, 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, label: str, n: int, id_col: str = SAMPLE, seed: int = 42) -> DataFrame:
    """M2: n rows with class proportions kept (largest-remainder quotas), seeded."""
    quotas = class_quotas(df, label, n)
    ranked = seeded_rank(df, id_col, seed, within=label)
    quotas = checked_broadcast(cache_small(quotas.select(label, "quota")), quotas.count(), MAX_BROADCAST_SAMPLES)
    return (ranked.join(quotas, label)
            .filter(F.col(RANK) < F.col("quota")).drop(RANK, "quota"))


def sample_ids(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the first n in md5 order (all, if fewer). The rows before the
    cut are filtered; of rows that share the last id as many as are missing are taken."""
    total = df.count()
    if n >= total or n <= 0:
        return df.limit(0) if n <= 0 else df
    key = _order_key(id_col, seed)
    t, i = rank_cuts(df, key, id_col, [n - 1])[0]
    at_cut = (key == t) & F.col(id_col).eqNullSafe(F.lit(i))
    before = df.where(~after_cut(key, id_col, (t, i)) & ~at_cut)
    return before.unionByName(df.where(at_cut).limit(n - before.count()))


def sample_matrix(m: ExprMatrix, n_samples: int, n_genes: int, seed: int = 42) -> ExprMatrix:
    """M3: a seeded subset of n_samples samples and n_genes genes (two semi joins)."""
    s = cache_small(sample_ids(m.samples, SAMPLE, n_samples, seed))
    g = cache_small(sample_ids(m.genes, GENE, n_genes, seed))
    return m.restrict_samples(s, min(n_samples, m.n_samples)).restrict_genes(g, min(n_genes, m.n_genes))


def sample_with_replacement(ids: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """K draws with replacement, ``(draw, id)``.

    Draw i picks the id at rank md5(i-seed) mod N of the ids in id order; the ranked
    id table joins the k draws on that rank.
    """
    spark = ids.sparkSession
    n = ids.count()
    ranked = global_rank(ids.select(id_col), [id_col], n_rows=n)
    draws = spark.range(k).select(F.col("id").alias("draw"),
                                  (hash_rank_key(F.col("id"), seed) % F.lit(n)).alias(RANK))
    return draws.join(ranked, RANK).select("draw", id_col)
