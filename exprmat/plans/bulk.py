"""Bulk-tissue preprocessing."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..matrix import SAMPLE, VALUES, ExprMatrix, materialize
from ..operators import ml
from ..operators.filters import filter_low_signal
from ..operators.metrics import cv_summary
from ..operators.transforms import log2p1, upper_quartile_normalize
from ..sources.positions import pair_by_position, read_labels_by_position, read_rows_by_position


def feature_preprocessing(m: ExprMatrix, q_uq: float = 0.75, q_filter: float = 0.25,
                          threshold_on: str = "normalized", on_empty_sample: str = "error") -> ExprMatrix:
    """Upper-quartile normalise (C1) → keep genes with mean and variance above
    their q_filter-quantiles (P7) → log2(x + 1) (F1).

    The normalised matrix is read twice (statistics, then the filtered output); only
    its small per-gene statistics are materialised, the cells stay a plan.
    ``threshold_on='raw'`` takes the statistics from the input matrix (Q4).
    """
    if threshold_on not in ("normalized", "raw"):
        raise ValueError("threshold_on must be 'normalized' or 'raw'")
    uq = upper_quartile_normalize(m, q_uq, on_empty_sample)
    kept = filter_low_signal(uq, q_filter, stats_from=m if threshold_on == "raw" else None)
    return log2p1(kept)


def bulk_pipeline(m: ExprMatrix, labels, task: str = "classification", label: str = "label",
                  grid: dict | None = None, kind: str = "rf", k: int = 10, seed: int = 42,
                  parallelism: int = 8, stratify: bool = False, metric: str | None = None, **est_params):
    """Preprocess (C2) → dense rows → pre-ML (C7) → cross-validated scores on the
    training split (L7, or nested CV with a grid search, L9 + L8) → fit on train and
    score the test split (A8 accuracy / A9 R², or another ``metric`` of the task).

    A ``grid`` may go with either task (Q17); the grid is searched by the same metric. With
    ``stratify`` the (outer) folds keep the classes' proportions (Q18). Returns one row ``(task,
    n_train, n_test, n_folds, mean_cv, var_cv, std_cv, eval_score)``; ``var_cv`` is what the
    reference calls its standard deviation (np.var).
    """
    task = ml.normalize_task(task)
    rows, _ = feature_preprocessing(m).to_row_array()
    return score_rows(rows, labels, task, label, grid, kind, k, seed, parallelism, stratify, metric, **est_params)


def score_rows(rows, labels, task: str = "classification", label: str = "label", grid: dict | None = None,
               kind: str = "rf", k: int = 10, seed: int = 42, parallelism: int = 8, stratify: bool = False,
               metric: str | None = None, **est_params):
    """The learning half of C8 on preprocessed row arrays."""
    task = ml.normalize_task(task)
    if stratify and task != ml.CLASSIFICATION:
        raise ValueError("only classes can be stratified")
    prepared = ml.pre_ml(rows, labels, task, label, seed=seed)
    train = prepared.filter(F.col("split") == "train")
    est = ml.make_estimator(task, kind, seed, **est_params)
    by = label if stratify else None
    if grid:
        scores = ml.nested_cv(train, est, grid, task, 5, 2, seed, parallelism, by, metric)
        model, _ = ml.grid_search(train, est, grid, task, 2, seed, parallelism, metric)
        pred = model.bestModel.transform(prepared.filter(F.col("split") == "test"))
        eval_score = float(ml.evaluator(task, metric).evaluate(pred))
    else:
        scores = ml.cross_validate(train, est, task, k, seed, parallelism, by, metric=metric)
        _, _, eval_score = ml.fit_and_score(prepared, est, task, metric)
    n = prepared.groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in n}
    summary = cv_summary(scores)
    return summary.select(F.lit(task).alias("task"), F.lit(counts.get("train", 0)).cast("bigint").alias("n_train"),
                          F.lit(counts.get("test", 0)).cast("bigint").alias("n_test"), "n_folds", "mean_cv",
                          "var_cv", "std_cv", F.lit(eval_score).alias("eval_score"))


def bulk_pipeline_path(spark: SparkSession, features: str, labels: str, label_col: str = "label", task: str = "classification",
                       **options):
    """C8 from files without keys: one row per sample in ``features`` (one column per gene), the label of
    the same row in column ``label_col`` of ``labels``; CSV or parquet, each in any number of parts.
    Rows are numbered across the parts and paired by number; ``options`` are those of ``bulk_pipeline``."""
    rows, names = read_rows_by_position(spark, features)
    lab = read_labels_by_position(spark, labels, label_col)
    paired = materialize(pair_by_position(rows, lab), "paired")
    m = ExprMatrix.from_row_array(paired, SAMPLE, VALUES, gene_ids=names)
    if task in ("regression", "regress"):
        paired = paired.withColumn("label", F.col("label").cast("double"))
    return bulk_pipeline(m, paired.select(SAMPLE, "label"), task, "label", **options)
