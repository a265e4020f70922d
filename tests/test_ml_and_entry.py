"""ML operators on the embeddings table and the driver contract."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from exprmat.operators import ml
from exprmat.plans import bindings as B


@pytest.fixture(scope="module")
def prepared(spark):
    rows = B.embedding_rows(spark, SF_SMALL)
    return ml.pre_ml(rows.select("sample_id", "values"), rows.select("sample_id", "label"), "class")


def test_task_names():
    assert ml.normalize_task("Class") == "classification"
    assert ml.normalize_task("regress") == "regression"
    with pytest.raises(ValueError):
        ml.normalize_task("clustering")


def test_pre_ml_scaling_on_train(spark, prepared):
    train = prepared.filter("split = 'train'")
    st = train.select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"),
                                                                             F.stddev_pop("v").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1.0) < 1e-9 for r in st)
    n = prepared.count()
    assert prepared.filter("split = 'test'").count() == -(-3 * n // 10)


def test_rf_and_cv_repeatable(spark, prepared):
    est = ml.make_estimator("classification", "rf", 42, numTrees=10, maxDepth=4)
    _, _, s1 = ml.fit_and_score(prepared, est)
    _, _, s2 = ml.fit_and_score(prepared, est)
    assert s1 == s2 and 0.0 <= s1 <= 1.0
    cv = ml.cross_validate(prepared.filter("split = 'train'"), est, k=4).collect()
    assert len(cv) == 4 and sum(r["n_test"] for r in cv) == prepared.filter("split = 'train'").count()


def test_grid_and_nested(spark, prepared):
    train = prepared.filter("split = 'train'")
    est = ml.make_estimator("classification", "rf", 42)
    model, table = ml.grid_search(train, est, {"numTrees": [5, 10]}, folds=2)
    assert table.count() == 2
    nested = ml.nested_cv(train, est, {"numTrees": [5]}, outer=3, inner=2).collect()
    assert len(nested) == 3


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_oracle_rounds_are_sign_normalised():
    from exprmat.plans.catalog import positive_zero_rounds
    sql = "SELECT round(log2(round(x, 2) + 1), 6) AS a, myround(y) AS b FROM t ORDER BY round(v, 9)"
    assert positive_zero_rounds(sql) == ("SELECT (round(log2((round(x, 2) + 0.0) + 1), 6) + 0.0) AS a, "
                                         "myround(y) AS b FROM t ORDER BY (round(v, 9) + 0.0)")
    import duckdb
    assert str(duckdb.sql(positive_zero_rounds("SELECT round(-1e-9, 6) AS z")).fetchall()[0][0]) == "0.0"
