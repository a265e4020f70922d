"""Estimator wrapper, pandas batch hook and streaming application of fitted transforms."""

import os

import pandas as pd

from conftest import GOLDEN, as_dict, golden_matrix
from exprmat.operators import estimators, stats, transforms
from exprmat.streaming import log_normalize_stream


def test_uq_estimator_matches_function(spark):
    m = golden_matrix(spark)
    model = estimators.UpperQuartileNormalizer(q=0.75).fit(m.cells)
    got = as_dict(model.transform(m.cells))
    want = as_dict(transforms.upper_quartile_normalize(m).cells)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_map_batches(spark):
    m = golden_matrix(spark)
    df = m.cells.withColumn("batch", m.cells.sample_id.substr(2, 1).cast("int") % 2)

    def total(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [int(p["batch"].iloc[0])], "total": [float(p["value"].sum())]})

    out = {r["batch"]: r["total"] for r in estimators.map_batches(df, total, "batch int, total double", "batch").collect()}
    assert out == {1: float(sum(GOLDEN["s1"]) + sum(GOLDEN["s3"])), 0: float(sum(GOLDEN["s2"]) + sum(GOLDEN["s4"]))}


def test_log_normalize_on_stream(spark, tmp_dir):
    m = golden_matrix(spark)
    src = os.path.join(tmp_dir, "cells")
    m.cells.write.parquet(src)
    totals = stats.gene_stats(m).select("gene_id", "total")
    stream = spark.readStream.schema(m.cells.schema).parquet(src)
    q = (log_normalize_stream(stream, totals).writeStream.format("memory").queryName("ln_stream")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = as_dict(spark.sql("SELECT * FROM ln_stream"))
    want = as_dict(transforms.log_normalize(m).cells)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
