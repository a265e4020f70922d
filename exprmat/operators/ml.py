"""Machine-learning operators on Spark MLlib.

Rows are ``(sample_id, values array<double>)``; labels are joined by key (D0.3).
Training runs on MLlib's distributed tree learners; cross-validation folds are
separate Spark jobs submitted from a small driver thread pool.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE_IDX, SAMPLE, VALUE, VALUES, cache_small, materialize
from .exact import finish, merge_states, moment_state, subtract_state
from .joins import join_labels
from .sampling import kfold, train_test_split

ML_PARTITION_BYTES = 64 * 1024 * 1024

CLASSIFICATION, REGRESSION = "classification", "regression"
_TASKS = {"classification": CLASSIFICATION, "class": CLASSIFICATION,
          "regression": REGRESSION, "regress": REGRESSION}


def normalize_task(task: str) -> str:
    """The reference's task names, normalised once (fixes Q6); others raise."""
    t = _TASKS.get(str(task).lower())
    if t is None:
        raise ValueError(f"Invalid ML task: {task!r}")
    return t


# ---------------------------------------------------------------------------- L1
def fit_label_encoder(train: DataFrame, label: str = "label"):
    """L1: classes sorted alphabetically, fit on the training rows; an unseen label in
    later data is an error (as with the reference's encoder)."""
    return StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(train)


# ---------------------------------------------------------------------------- L2
def _positions_state(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """Moment states per position of the row arrays (and per value of the ``by`` columns)."""
    return moment_state(rows.select(*by, F.posexplode(values).alias(GENE_IDX, VALUE)), [*by, GENE_IDX])


def _scaler_rows(state: DataFrame, by: list[str]) -> DataFrame:
    """``by, means, scales`` from position states, two arrays in position order per group."""
    st = finish(state.withColumn("_rows", F.col("k") + F.col("missing")), [*by, GENE_IDX], "_rows")
    scale = F.when(F.col("var_pop") > 0, F.sqrt("var_pop")).otherwise(1.0)
    by_place = F.sort_array(F.collect_list(F.struct(GENE_IDX, F.coalesce("mean", F.lit(0.0)).alias("m"), scale.alias("s"))))
    return st.groupBy(*by).agg(by_place.alias("_p")).select(*by, F.transform("_p", lambda x: x["m"]).alias("means"),
                                                           F.transform("_p", lambda x: x["s"]).alias("scales"))


def fit_standard_scaler(train: DataFrame, values: str = VALUES) -> DataFrame:
    """L2 fit: one row ``(means, scales)``, per position the mean and population standard
    deviation over training rows.

    One aggregate over the exploded arrays (partial aggregation leaves one row per
    position per task before the shuffle), gathered into two arrays of length n_genes
    in position order. They stay in Spark: nothing per gene enters the plan or the
    driver. A zero deviation becomes 1, so a constant column is only centred. The sums are
    exact, so the scaler does not depend on the partitioning.
    """
    return cache_small(_scaler_rows(_positions_state(train, [], values), []))


def fit_fold_scalers(folded: DataFrame, fold: str = "fold", values: str = VALUES) -> DataFrame:
    """``(fold, means, scales)``: for every fold the scaler of all *other* folds' rows (L2 within L7, L9).

    One pass over the table gives the state of each fold. The state of the training rows of a
    fold is the whole table's less the fold's, exactly, so every scaler equals a refit
    without its fold, bit for bit, and nothing of the held-out rows is left in it.
    """
    own = materialize(_positions_state(folded, [fold], values), "fold_states")
    whole = merge_states([own], [GENE_IDX])
    folds = [F.lit(r[0]) for r in own.select(fold).distinct().collect()]  # k numbers
    # fold × position: the fold's own state, taken out of the whole's
    every = whole.withColumn(fold, F.explode(F.array(*folds)))
    return cache_small(_scaler_rows(subtract_state(every, own, [fold, GENE_IDX]), [fold]))


def scale_by_fold(df: DataFrame, scalers: DataFrame, held_out: int, values: str = VALUES) -> DataFrame:
    """Rows scaled by the statistics of all folds but ``held_out`` (its own rows included)."""
    out = apply_standard_scaler(df, scalers.where(F.col("fold") == held_out), values)
    return out.withColumn("features", array_to_vector(values))


def apply_standard_scaler(df: DataFrame, scaler: DataFrame, values: str = VALUES) -> DataFrame:
    """L2 transform: (x − mean) / scale per position; the fitted row joins every row on a
    constant key (a broadcast of exactly one row)."""
    one = scaler.select(F.lit(1).alias("_one"), F.col("means").alias("_means"), F.col("scales").alias("_scales"))
    scaled = F.zip_with(F.zip_with(values, "_means", lambda x, m: x - m), "_scales", lambda d, s: d / s)
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
            .withColumn(values, scaled).drop("_one", "_means", "_scales"))


# ---------------------------------------------------------------------------- C7
def repartition_by_size(df, target_bytes, n_rows, row_bytes):
    from ..sources.matrix_io import repartition_by_size as _rbs
    return _rbs(df, target_bytes, n_rows=n_rows, row_bytes=row_bytes)


def pre_ml(rows: DataFrame, labels: DataFrame, task: str = CLASSIFICATION, label: str = "label",
           test_frac: float = 0.3, seed: int = 42) -> DataFrame:
    """Join features and labels by key (J3) → seeded train/test split (M1) →
    label encoding fit on train (L1) → standard scaling fit on train (L2).

    Returns ``(sample_id, split, label, label_idx, values, features)``; ``label_idx`` is
    the encoded class (classification) or the numeric target (regression).
    """
    task = normalize_task(task)
    # joined rows are written once: the split ranks their ids and every later step reads them
    j = materialize(join_labels(rows.select(SAMPLE, VALUES), labels.select(SAMPLE, label)), "ml_rows")
    s = train_test_split(j, SAMPLE, test_frac, seed)
    train = s.filter(F.col("split") == "train")
    if task == CLASSIFICATION:
        s = fit_label_encoder(train, label).transform(s)
    else:
        s = s.withColumn("label_idx", F.col(label).cast("double"))
    scaler = fit_standard_scaler(train)
    width, n = scaler.select(F.size("means")).first()[0], s.count()
    s = apply_standard_scaler(s, scaler).withColumn("features", array_to_vector(VALUES))
    # The ML table is read by every fit, fold and score: pinned once, with partitions
    # sized to ~64 MB (S12) so tree learners do not schedule hundreds of tiny tasks.
    return cache_small(repartition_by_size(s, ML_PARTITION_BYTES, n_rows=n, row_bytes=64 + 16 * max(0, width)))


# ---------------------------------------------------------------------------- L3–L6
def make_estimator(task: str = CLASSIFICATION, kind: str = "rf", seed: int = 42, **params) -> Estimator:
    """Tree ensembles on ``features`` → ``label_idx``.

    ``kind='gbt'``: boosted trees (multi-class through one-vs-rest, since Spark's GBT
    is binary); ``kind='rf'``: random forest (multi-class natively, the fast option).
    """
    task = normalize_task(task)
    common = dict(featuresCol="features", labelCol="label_idx")
    if task == CLASSIFICATION:
        if kind == "rf":
            return RandomForestClassifier(seed=seed, **common, **params)
        if kind == "gbt":
            return OneVsRest(classifier=GBTClassifier(seed=seed, **common, **params), **common)
    else:
        if kind == "rf":
            return RandomForestRegressor(seed=seed, **common, **params)
        if kind == "gbt":
            return GBTRegressor(seed=seed, **common, **params)
    raise ValueError("kind must be 'rf' or 'gbt'")


METRICS = {CLASSIFICATION: ("accuracy", "f1", "weightedPrecision", "weightedRecall"),
           REGRESSION: ("r2", "rmse", "mse", "mae", "var")}


def evaluator(task: str, metric: str | None = None):
    """A8 / A9 as MLlib evaluators: accuracy for classes and R² for targets unless another
    metric of the task is named; a metric of the other task raises."""
    task = normalize_task(task)
    metric = metric or METRICS[task][0]
    if metric not in METRICS[task]:
        raise ValueError(f"{metric!r} does not score a {task} task")
    kind = MulticlassClassificationEvaluator if task == CLASSIFICATION else RegressionEvaluator
    return kind(labelCol="label_idx", predictionCol="prediction", metricName=metric)


# ---------------------------------------------------------------------------- L7
def _folds(df: DataFrame, k: int, seed: int, stratify: str | None = None) -> DataFrame:
    """Fold numbers (M4; M5 with ``stratify``), pinned in as many partitions as the input has."""
    n_parts = df.rdd.getNumPartitions()
    base = df.drop("fold") if "fold" in df.columns else df
    return cache_small(kfold(base, SAMPLE, k, seed, stratify).coalesce(max(1, n_parts)))


def cross_validate(df: DataFrame, estimator: Estimator, task: str = CLASSIFICATION, k: int = 10,
                   seed: int = 42, parallelism: int = 4, stratify: str | None = None,
                   scale: bool = False, metric: str | None = None) -> DataFrame:
    """K shuffled folds (M4; with ``stratify`` each fold keeps that column's proportions,
    M5); per fold fit on the rest and score on the fold by ``metric``. With ``scale`` the raw
    ``values`` are scaled within each fold by statistics of its training rows (one pass for
    all folds); without it ``features`` are taken as they are.

    Returns ``(fold, n_train, n_test, score)``, one row per fold — every fold is
    computed (Q9). Folds run as concurrent Spark jobs from ``parallelism`` threads.
    """
    spark = df.sparkSession
    folded = _folds(df, k, seed, stratify)
    ev = evaluator(task, metric)

    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    n = sum(sizes.values())
    scalers = fit_fold_scalers(folded) if scale else None

    def one(f: int):
        rows = scale_by_fold(folded, scalers, f) if scale else folded
        model = estimator.fit(rows.filter(F.col("fold") != f))
        score = float(ev.evaluate(model.transform(rows.filter(F.col("fold") == f))))
        return (f, n - sizes.get(f, 0), sizes.get(f, 0), score)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, range(k)))
    return spark.createDataFrame(rows, "fold int, n_train bigint, n_test bigint, score double")


# ---------------------------------------------------------------------------- L8, L9
def param_grid(estimator: Estimator, grid: dict[str, list]) -> list:
    """ParamMaps from ``{param_name: [values]}`` (for one-vs-rest, the base learner's)."""
    target = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    b = ParamGridBuilder()
    for name, vals in grid.items():
        b = b.addGrid(target.getParam(name), list(vals))
    return b.build()


def grid_search(train: DataFrame, estimator: Estimator, grid: dict[str, list], task: str = CLASSIFICATION,
                folds: int = 2, seed: int = 42, parallelism: int = 4, metric: str | None = None):
    """Grid search with ``folds``-fold CV scored by ``metric`` (default accuracy for
    classes, r2 for targets); the best parameters are refit on all of ``train``. Returns (CrossValidatorModel, table
    ``(params, avg_metric)``)."""
    maps = param_grid(estimator, grid)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator(task, metric),
                        numFolds=folds, seed=seed, parallelism=parallelism)
    model = cv.fit(train)
    rows = [(json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a))
            for m, a in zip(maps, model.avgMetrics)]
    return model, train.sparkSession.createDataFrame(rows, "params string, avg_metric double")


def nested_cv(df: DataFrame, estimator: Estimator, grid: dict[str, list], task: str = CLASSIFICATION,
              outer: int = 5, inner: int = 2, seed: int = 42, parallelism: int = 2,
              stratify: str | None = None, metric: str | None = None, scale: bool = False) -> DataFrame:
    """``outer`` shuffled folds (stratified with ``stratify``); in each, a grid search
    (L8) on the rest and the refit best model scored on the fold by ``metric``; with ``scale``
    the values are scaled within each outer fold as in ``cross_validate``. Returns ``(fold, n_test, score, best_params)``."""
    spark = df.sparkSession
    folded = _folds(df, outer, seed, stratify)
    ev = evaluator(task, metric)

    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}

    scalers = fit_fold_scalers(folded) if scale else None

    def one(f: int):
        rows = scale_by_fold(folded, scalers, f) if scale else folded
        tr, te = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        model, table = grid_search(tr, estimator, grid, task, inner, seed, 1, metric)
        best = table.orderBy(F.col("avg_metric").desc() if ev.isLargerBetter() else F.col("avg_metric"),
                             "params").first()["params"]
        return (f, sizes.get(f, 0), float(ev.evaluate(model.bestModel.transform(te))), best)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, range(outer)))
    return spark.createDataFrame(rows, "fold int, n_test bigint, score double, best_params string")


def fit_and_score(prepared: DataFrame, estimator: Estimator, task: str = CLASSIFICATION, metric: str | None = None):
    """L6 + A8/A9: fit on the train split, predict the test split, score it by ``metric``."""
    train = prepared.filter(F.col("split") == "train")
    test = prepared.filter(F.col("split") == "test")
    model = estimator.fit(train)
    pred = model.transform(test)
    return model, pred, float(evaluator(task, metric).evaluate(pred))

