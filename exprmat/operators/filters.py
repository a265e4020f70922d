"""Gene and sample filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..matrix import GENE, MAX_BROADCAST_GENES, ExprMatrix, cache_small, checked_broadcast, materialize
from .order_stats import exact_quantiles
from .stats import gene_stats


def drop_zero_genes(m: ExprMatrix) -> ExprMatrix:
    """Keep genes whose mean over all samples is > 0."""
    keep = cache_small(gene_stats(m).filter(F.col("mean") > 0).select(GENE))
    return m.restrict_genes(keep, keep.count())


def low_signal_thresholds(stats: DataFrame, q: float = 0.25) -> tuple[Column, Column]:
    """Exact q-quantiles of the gene means and variances (A7); ``stats`` is read a few times."""
    got = exact_quantiles(stats, ["mean", "var"], q)
    return tuple(F.lit(got[c]).cast("double") for c in ("mean", "var"))


def filter_low_signal(m: ExprMatrix, q: float = 0.25, stats_from: ExprMatrix | None = None) -> ExprMatrix:
    """Keep genes with mean > q-quantile(means) and var > q-quantile(vars).

    Both comparisons are strict and the quantiles run over all genes, all-zero ones
    included. The statistics are exact, so a gene on a threshold is on it in any partitioning. ``stats_from`` takes the statistics from another matrix (the reference's
    cluster script thresholds on the raw matrix, Q4).
    """
    stats = cache_small(gene_stats(stats_from or m))
    qm, qv = low_signal_thresholds(stats, q)
    keep = stats.filter((F.col("mean") > qm) & (F.col("var") > qv)).select(GENE)
    return m.restrict_genes(keep, keep.count())   # a filter over the pinned statistics


def keep_gene_prefix(m: ExprMatrix, prefix: str) -> ExprMatrix:
    """Keep genes whose id starts with ``prefix`` (e.g. ``ENSG``)."""
    keep = m.genes.filter(F.col(GENE).cast("string").startswith(prefix))
    return m.restrict_genes(keep)


def select_genes(m: ExprMatrix, genes: DataFrame, n_genes: int | None = None) -> ExprMatrix:
    """Projection onto a gene set (a semi join in long form)."""
    return m.restrict_genes(genes.select(GENE), n_genes)


def select_coding_genes(m: ExprMatrix, gene_list: DataFrame, list_col: str = GENE,
                        mode: str = "stable_id") -> ExprMatrix:
    """Keep genes named in ``gene_list``.

    ``mode='stable_id'`` compares ids with their ``.version`` suffix stripped on both
    sides: a broadcast left-semi equi-join. ``mode='contains'`` keeps the reference's
    substring semantics (a gene is kept when its id contains any listed id), by an
    inverted index of rare q-grams (``containing_any``): any number of genes and ids.
    """
    lst = cache_small(gene_list.select(F.col(list_col).cast("string").alias("_l")).distinct())
    if mode == "stable_id":
        lst_bc = checked_broadcast(lst.select(fx.stable_gene_id("_l").alias("_sid")).distinct(),
                                   lst.count(), MAX_BROADCAST_GENES)
        keep = (m.genes.withColumn("_sid", fx.stable_gene_id(F.col(GENE).cast("string")))
                .join(lst_bc, "_sid", "left_semi").select(GENE))
    elif mode == "contains":
        keep = containing_any(m.genes.withColumn("_text", F.col(GENE).cast("string")), "_text", lst, "_l").select(GENE)
    else:
        raise ValueError("mode must be 'stable_id' or 'contains'")
    return m.restrict_genes(keep)


def _grams(text: Column, size: int) -> Column:
    """The different substrings of ``size`` characters."""
    n = F.char_length(text)
    places = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: text.substr(i, F.lit(size))))


def containing_any(df: DataFrame, text_col: str, listed: DataFrame, list_col: str, q: int = 5) -> DataFrame:
    """P5: the rows of ``df`` whose text contains at least one of the listed strings.

    An inverted index: every listed string is posted once, under its *rarest* q-gram (by the number
    of texts that hold it); a string that is shorter than q is its own only gram. Texts meet the
    postings by an equi-join on grams, and ``contains`` verifies the few pairs that meet. A
    string with a gram that no text holds is dropped before. Nothing is broadcast but what
    the planner's own size check allows, and no text is compared with every string. An empty
    string is contained in every text; NULL in none.
    """
    lst = listed.select(F.col(list_col).alias("_p")).where("_p is not null").distinct()
    sizes = sorted(r[0] for r in lst.select(F.least(F.char_length("_p"), F.lit(q)).alias("n")).distinct().collect())  # at most q + 1
    if sizes and sizes[0] == 0:
        return df.where(F.col(text_col).isNotNull())
    if not sizes:
        return df.limit(0)
    texts = df.select(F.col(text_col).alias("_t")).where("_t is not null").distinct()
    held = materialize(texts.select("_t", F.explode(F.concat(*[_grams(F.col("_t"), s) for s in sizes])).alias("_g")), "grams")
    often = held.groupBy("_g").agg(F.count("*").alias("_n"))
    own = F.when(F.char_length("_p") >= q, _grams(F.col("_p"), q)).otherwise(F.array("_p"))
    posted = (lst.select("_p", F.explode(own).alias("_g")).join(often, "_g", "left").groupBy("_p")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r"))
              .where("_r.n > 0").select("_p", F.col("_r.g").alias("_g")))
    hit = held.join(posted, "_g").where(F.contains("_t", "_p")).select("_t").distinct()
    return df.join(hit, F.col(text_col) == F.col("_t"), "left_semi")
