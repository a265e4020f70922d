import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").appName("exprmat-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="exprmat-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="exprmat-test-")


# FIXTURES.md §3: 4 samples × 6 genes; g1 all zero, g5 constant, s3 has upper quartile 0.
GOLDEN = {
    "s1": [0, 4, 10, 0, 6, 1],
    "s2": [0, 8, 2, 3, 6, 5],
    "s3": [0, 0, 0, 0, 6, 0],
    "s4": [0, 1, 7, 9, 6, 2],
}
GENES = ["g1", "g2", "g3", "g4", "g5", "g6"]


def golden_matrix(spark, store_zeros=False):
    from exprmat.matrix import ExprMatrix

    rows = [(s, g, float(v)) for s, vals in GOLDEN.items() for g, v in zip(GENES, vals) if store_zeros or v != 0]
    cells = spark.createDataFrame(rows, "sample_id string, gene_id string, value double")
    samples = spark.createDataFrame([(s,) for s in GOLDEN], "sample_id string")
    genes = spark.createDataFrame([(g,) for g in GENES], "gene_id string")
    return ExprMatrix.from_cells(cells, samples, genes)


def as_dict(df, key=("sample_id", "gene_id"), val="value"):
    return {tuple(r[k] for k in key): r[val] for r in df.collect()}
