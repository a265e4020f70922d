"""Evaluation and descriptive statistics.

Every metric is an aggregate over a DataFrame of (truth, prediction) rows or of
per-gene statistics; only class-sized or bin-sized tables are ever built.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import GENE, ExprMatrix
from .stats import gene_stats


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row ``(n, accuracy)``."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def r2(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """One row ``(n, r2)`` = 1 − Σ(y−p)² / (n·var_pop(y)); one pass, no Σy² cancellation."""
    ss_res = F.sum((F.col(y) - F.col(p)) ** 2)
    ss_tot = F.count(F.col(y)) * F.var_pop(y)
    return df.agg(F.count(F.lit(1)).alias("n"), (F.lit(1.0) - F.try_divide(ss_res, ss_tot)).alias("r2"))


def cv_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """A10: ``(n_folds, mean_cv, var_cv, std_cv)``. The reference reports np.var (ddof 0)
    under the name ``std``; both are given."""
    return scores.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(score).alias("mean_cv"),
                      F.var_pop(score).alias("var_cv"), F.stddev_pop(score).alias("std_cv"))


def classes_of(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Distinct classes over truth ∪ prediction, ``(cls)``."""
    return df.select(F.col(label).alias("cls")).union(df.select(F.col(pred).alias("cls"))).distinct()


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _pair_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    return (df.groupBy(F.col(label).alias("_t"), F.col(pred).alias("_p"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     normalize: bool = False) -> DataFrame:
    """``(label, prediction, n[, rate])`` for every pair of classes, zeros kept.

    Pair counts are one partial+final aggregate over the rows; the k×k frame (k =
    number of classes) comes from exploding the class list once per true class.
    ``normalize`` adds the row-normalised rate n / support.
    """
    counts = _pair_counts(df, label, pred)
    cls = classes_of(df, label, pred)
    all_cls = cls.agg(F.array_sort(F.collect_list("cls"))).scalar()
    frame = cls.select(F.col("cls").alias("_t"), F.explode(all_cls).alias("_p"))
    out = (frame.join(counts, ["_t", "_p"], "left")
           .select(F.col("_t").alias(label), F.col("_p").alias(pred),
                   F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
    if normalize:
        sup = out.groupBy(label).agg(F.sum("n").alias("_s"))
        out = out.join(sup, label).withColumn("rate", F.try_divide(F.col("n"), F.col("_s"))).drop("_s")
    return out


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class ``(cls, precision, recall, f1, support)``; an undefined ratio is 0
    (the library's zero_division default also reports 0)."""
    counts = _pair_counts(df, label, pred)
    tp = counts.filter(F.col("_t") == F.col("_p")).select(F.col("_t").alias("cls"), F.col("n").alias("tp"))
    sup = counts.groupBy(F.col("_t").alias("cls")).agg(F.sum("n").alias("support"))
    npred = counts.groupBy(F.col("_p").alias("cls")).agg(F.sum("n").alias("n_pred"))
    cls = classes_of(df, label, pred)
    t = (cls.join(tp, "cls", "left").join(sup, "cls", "left").join(npred, "cls", "left")
         .select("cls", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("tp", "support", "n_pred")]))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return (t.select("cls", p.alias("precision"), r.alias("recall"), F.col("support").cast("bigint").alias("support"))
            .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                      F.col("precision") + F.col("recall")), F.lit(0.0))))


# ---------------------------------------------------------------------------- A17
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| ≥ |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, dof)], dtype="float64")


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares fit of y on x: one row ``(n, slope, intercept, r, p_value, stderr)``.

    slope/intercept/r are Spark's regression aggregates; stderr follows from r and the
    population moments; the two-sided p-value of the slope is a t-test evaluated on the
    single result row (a one-row Arrow UDF; no per-row Python on the data).
    """
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                 F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"),
                 F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    dof = F.col("n") - 2
    stderr = F.sqrt(F.try_divide((F.lit(1.0) - F.col("r") ** 2) * F.col("_vy"), F.col("_vx") * dof))
    t = F.try_divide(F.col("r") * F.sqrt(dof.cast("double")), F.sqrt((1 - F.col("r")) * (1 + F.col("r"))))
    return agg.select("n", "slope", "intercept", "r",
                      _p_value(F.coalesce(t, F.lit(float("inf"))), dof.cast("double")).alias("p_value"),
                      stderr.alias("stderr"))


def gene_trend(m: ExprMatrix, log10: bool = False) -> DataFrame:
    """Regression of each gene's mean (optionally log10(mean+1), F3) on its position."""
    st = gene_stats(m).join(m.genes_bc(m.gene_index()), GENE)
    yv = F.log10(F.col("mean") + 1.0) if log10 else F.col("mean")
    return linear_trend(st.select(F.col("gene_idx").cast("double").alias("x"), yv.alias("y")), "x", "y")


# ---------------------------------------------------------------------------- A18
def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram ``(bin, lo, hi, n)`` between min and max, the max in the
    last bin (numpy's rule); empty bins appear with n = 0."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    lo, hi = rng.select("_lo").scalar(), rng.select("_hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)) * bins),
                F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def gene_mean_histogram(m: ExprMatrix, bins: int = 10) -> DataFrame:
    """Histogram of the per-gene means."""
    return histogram(gene_stats(m), "mean", bins)
