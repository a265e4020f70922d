"""Metrics and report tables against hand-computed values."""

import pytest

from exprmat.operators import metrics, report


def preds(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "a")]
    return spark.createDataFrame(rows, "label string, prediction string")


def test_accuracy_and_confusion(spark):
    df = preds(spark)
    assert metrics.accuracy(df).collect()[0]["accuracy"] == pytest.approx(4 / 6)
    cm = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cm) == 9 and sum(cm.values()) == 6
    assert cm[("a", "a")] == 2 and cm[("c", "a")] == 1 and cm[("c", "c")] == 0
    rates = {(r["label"], r["prediction"]): r["rate"] for r in metrics.confusion_matrix(df, normalize=True).collect()}
    assert rates[("a", "a")] == pytest.approx(2 / 3)


def test_class_report(spark):
    rep = {r["cls"]: r for r in metrics.class_report(preds(spark)).collect()}
    assert rep["a"]["precision"] == pytest.approx(2 / 3) and rep["a"]["recall"] == pytest.approx(2 / 3)
    assert rep["b"]["precision"] == pytest.approx(2 / 3) and rep["b"]["recall"] == pytest.approx(1.0)
    assert rep["b"]["f1"] == pytest.approx(0.8)
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1"] == 0.0 and rep["c"]["support"] == 1


def test_r2_and_cv_summary(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    assert metrics.r2(df).collect()[0]["r2"] == pytest.approx(1 - 0.5 / 2.0)
    sc = spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, score double")
    r = metrics.cv_summary(sc).collect()[0]
    assert r["mean_cv"] == pytest.approx(0.6) and r["var_cv"] == pytest.approx(0.01) and r["std_cv"] == pytest.approx(0.1)


def test_linear_trend_and_p_value(spark):
    xs = list(range(10))
    ys = [2.0 * x + 1 + (0.5 if x % 2 else -0.5) for x in xs]
    df = spark.createDataFrame(list(zip([float(x) for x in xs], ys)), "x double, y double")
    r = metrics.linear_trend(df, "x", "y").collect()[0]
    assert r["slope"] == pytest.approx(2.0303030303) and r["intercept"] == pytest.approx(0.8636363636)
    assert r["p_value"] < 1e-8
    assert metrics.t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)


def test_histogram_fills_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "v double")
    h = metrics.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 1]


def test_report_tables(spark):
    res = spark.createDataFrame([("n200", "Dask", 3.0, 1), ("n200", "Dask", 2.0, 2), ("n200", "SPE", 5.0, 3),
                                 ("n600", "Scientific Python Ecnvironment", 9.0, 4)],
                                "dimension string, framework string, value double, pos int")
    best = {(r[0], r[1]): r[2] for r in report.best_of_repeats(res).collect()}
    assert best[("n200", "Dask")] == 2.0
    piv = {r["dimension"]: r for r in report.pivot_results(res, ["Dask", "SPE"], order="pos").collect()}
    assert piv["n200"]["Dask"] == 2.0 and piv["n600"]["Dask"] is None
    panel = {r["dimension"]: r.asDict() for r in report.benchmark_report(
        res, ["Dask", "SPE", "Scientific Python Environment"]).collect()}
    assert panel["n600"]["Scientific Python Environment"] == 9.0
    long = report.unpivot_results(report.pivot_results(res, ["Dask", "SPE"]), frameworks=["Dask", "SPE"])
    assert long.count() == 4
