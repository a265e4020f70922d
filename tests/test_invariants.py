"""Invariants and independent numpy checks (SURVEY §5 (c)–(f))."""

import numpy as np
import pytest

from exprmat.matrix import ExprMatrix
from exprmat.operators import stats, transforms


def random_matrix(spark, n=12, g=9, density=0.5, seed=3, signed=False, partitions=None):
    rng = np.random.default_rng(seed)
    dense = rng.integers(1, 20, size=(n, g)).astype(float)
    if signed:
        dense = dense - 10.0
    dense[rng.random((n, g)) > density] = 0.0
    rows = [(f"s{i:02d}", f"g{j:02d}", float(dense[i, j])) for i in range(n) for j in range(g) if dense[i, j] != 0]
    cells = spark.createDataFrame(rows, "sample_id string, gene_id string, value double")
    if partitions:
        cells = cells.repartition(partitions)
    samples = spark.createDataFrame([(f"s{i:02d}",) for i in range(n)], "sample_id string")
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(g)], "gene_id string")
    return ExprMatrix.from_cells(cells, samples, genes), dense


@pytest.mark.parametrize("signed", [False, True])
def test_gene_stats_match_numpy(spark, signed):
    m, dense = random_matrix(spark, signed=signed)
    st = {r["gene_id"]: r for r in stats.gene_stats(m).collect()}
    for j in range(dense.shape[1]):
        r = st[f"g{j:02d}"]
        assert r["total"] == pytest.approx(dense[:, j].sum())
        assert r["mean"] == pytest.approx(dense[:, j].mean())
        assert r["var"] == pytest.approx(dense[:, j].var(ddof=1))


@pytest.mark.parametrize("q", [0.25, 0.5, 0.75, 0.9])
@pytest.mark.parametrize("signed", [False, True])
def test_padded_quantile_matches_numpy(spark, q, signed):
    m, dense = random_matrix(spark, density=0.4, seed=11, signed=signed)
    got = {r["sample_id"]: r for r in stats.sample_stats(m, q).collect()}
    for i in range(dense.shape[0]):
        s = f"s{i:02d}"
        if s not in got:        # no stored cell: all-zero sample
            assert not dense[i].any()
            continue
        assert got[s]["quantile"] == pytest.approx(np.quantile(dense[i], q))
        assert got[s]["total"] == pytest.approx(dense[i].sum())


def test_partition_invariance(spark):
    a, _ = random_matrix(spark, partitions=1)
    b, _ = random_matrix(spark, partitions=7)
    fa = {r["sample_id"]: round(r["scaling_factor"], 12) for r in transforms.upper_quartile_factors(a).collect()}
    fb = {r["sample_id"]: round(r["scaling_factor"], 12) for r in transforms.upper_quartile_factors(b).collect()}
    assert fa == fb


def test_uq_factors_geometric_mean_is_one(spark):
    m, _ = random_matrix(spark, density=0.9, seed=5)
    f = [r["scaling_factor"] for r in transforms.upper_quartile_factors(m).collect()]
    assert all(x > 0 for x in f)
    assert float(np.exp(np.mean(np.log(f)))) == pytest.approx(1.0, abs=1e-12)


def test_scale_by_variance_moments(spark):
    m, dense = random_matrix(spark, density=0.7, seed=9)
    out = transforms.scale_by_variance(m)
    by_gene = {}
    for r in out.collect():
        by_gene.setdefault(r["gene_id"], []).append(r["value"])
    for j in range(dense.shape[1]):
        v = np.array(by_gene[f"g{j:02d}"])
        var = dense[:, j].var(ddof=1)
        assert len(v) == dense.shape[0]
        assert v.mean() == pytest.approx(0.0, abs=1e-12)
        assert v.var(ddof=1) == pytest.approx(1.0 / var)


def test_layout_round_trip(spark):
    m, dense = random_matrix(spark)
    rows, idx = m.to_row_array()
    got = {r["sample_id"]: r["values"] for r in rows.collect()}
    for i in range(dense.shape[0]):
        assert got[f"s{i:02d}"] == pytest.approx(list(dense[i]))
    long = ExprMatrix.row_array_to_long(rows, idx, m.n_genes, drop_zeros=True)
    assert long.count() == int((dense != 0).sum())


def test_zero_genes_never_survive_low_signal_filter(spark):
    from exprmat.operators.filters import filter_low_signal
    m, dense = random_matrix(spark, density=0.3, seed=2)
    kept = {r["gene_id"] for r in filter_low_signal(m).genes.collect()}
    zero = {f"g{j:02d}" for j in range(dense.shape[1]) if not dense[:, j].any()}
    assert not kept & zero


def test_per_batch_statistics_match_numpy(spark):
    """C3/C5 with batches equal the global computation run on each batch alone."""
    m, dense = random_matrix(spark, n=10, g=6, density=0.6, seed=21)
    batch_of = {f"s{i:02d}": i % 2 for i in range(10)}
    batches = spark.createDataFrame(list(batch_of.items()), "sample_id string, batch int")
    got = {(r["sample_id"], r["gene_id"]): r["value"]
           for r in transforms.scale_by_variance(m, batches=batches).collect()}
    ln = {(r["sample_id"], r["gene_id"]): r["value"]
          for r in transforms.log_normalize(m, batches=batches).cells.collect()}
    for b in (0, 1):
        rows = [i for i in range(10) if i % 2 == b]
        sub = dense[rows]
        mean, var = sub.mean(axis=0), sub.var(axis=0, ddof=1)
        tot = sub.sum(axis=0)
        for r_i, i in enumerate(rows):
            for j in range(6):
                key = (f"s{i:02d}", f"g{j:02d}")
                if var[j] == 0:
                    assert got[key] is None
                else:
                    assert got[key] == pytest.approx((sub[r_i, j] - mean[j]) / var[j])
                if sub[r_i, j] != 0:
                    x = sub[r_i, j] / tot[j] * 1e4
                    assert ln[key] == pytest.approx(np.log(x))


def test_dense_output_includes_samples_without_cells(spark):
    """A sample with no stored cell still gets a full dense row (-mean/var per gene)."""
    m, dense = random_matrix(spark, n=6, g=5, density=0.8, seed=4)
    samples = m.samples.union(spark.createDataFrame([("s99",)], "sample_id string"))
    m2 = ExprMatrix.from_cells(m.cells, samples, m.genes)
    full = np.vstack([dense, np.zeros((1, dense.shape[1]))])
    got = {(r["sample_id"], r["gene_id"]): r["value"] for r in transforms.scale_by_variance(m2).collect()}
    assert len(got) == 7 * 5
    mean, var = full.mean(axis=0), full.var(axis=0, ddof=1)
    for j in range(5):
        assert got[("s99", f"g{j:02d}")] == pytest.approx(-mean[j] / var[j])
    rows, _ = m2.to_row_array()
    z = {r["sample_id"]: r["values"] for r in rows.collect()}
    assert z["s99"] == [0.0] * 5


def test_missing_values_are_skipped(spark):
    """A NULL is neither a zero nor a value: 2, NULL, 4 has mean 3 and variance 2."""
    from pyspark.sql import functions as F

    from exprmat.matrix import ExprMatrix
    from exprmat.operators.stats import gene_stats, sample_stats

    rows = spark.createDataFrame([("a", [2.0, 1.0]), ("b", [None, 0.0]), ("c", [4.0, float("nan")])], "sample_id string, values array<double>")
    m = ExprMatrix.from_row_array(rows, gene_ids=["g", "h"])
    got = {r.gene_id: (r.n, r.mean, r["var"]) for r in gene_stats(m).collect()}
    assert got == {"g": (2, 3.0, 2.0), "h": (2, 0.5, 0.5)}
    q = {r.sample_id: (r.total, r.quantile) for r in sample_stats(m, 0.5).collect()}
    assert q["a"] == (3.0, 1.5) and q["b"] == (0.0, 0.0) and q["c"] == (4.0, 4.0)
    assert m.cells.where(F.col("value").isNull()).count() == 2
    back = {r.sample_id: list(r["values"]) for r in m.to_row_array()[0].collect()}
    assert back == {"a": [2.0, 1.0], "b": [None, 0.0], "c": [4.0, None]}


def test_unequal_rows_raise(spark):
    import pytest

    from exprmat.matrix import ExprMatrix

    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0, 5.0])], "sample_id string, values array<double>")
    with pytest.raises(ValueError, match="2 to 3"):
        ExprMatrix.from_row_array(rows)


def test_tiny_variances_rank_by_size(spark):
    from exprmat.matrix import ExprMatrix
    from exprmat.operators.selection import top_variance_genes

    cells = [(s, g, v * i) for g, v in (("a", 1e-6), ("b", 2e-6), ("c", 9e-6)) for i, s in enumerate("xyz")]
    m = ExprMatrix.from_cells(spark.createDataFrame(cells, "sample_id string, gene_id string, value double"))
    assert [r.gene_id for r in top_variance_genes(m, 2).collect()] == ["c", "b"]
