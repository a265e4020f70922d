"""FIXTURES.md §3 golden values for C1–C5 on the 4 × 6 matrix."""

import pytest

from conftest import GENES, GOLDEN, as_dict, golden_matrix
from exprmat.operators import filters, selection, stats, transforms
from exprmat.plans.bulk import feature_preprocessing
from exprmat.plans.singlecell import single_cell_pipeline


@pytest.mark.parametrize("store_zeros", [False, True])
def test_c1_factors(spark, store_zeros):
    m = golden_matrix(spark, store_zeros)
    f = {r["sample_id"]: r for r in transforms.upper_quartile_factors(m).collect()}
    assert [round(f[s]["norm_factor"], 6) for s in GOLDEN] == [0.285714, 0.25, 0.0, 0.28]
    assert [round(f[s]["scaling_factor"], 6) for s in GOLDEN] == [0.759757, 0.664787, 0.0, 0.744561]


def test_c1_geometric_mean(spark):
    m = golden_matrix(spark)
    f = transforms.upper_quartile_factors(m)
    r = f.filter("scaling_factor <> 0").selectExpr("first(norm_factor / scaling_factor) AS g").collect()
    assert round(r[0]["g"], 6) == 0.37606


@pytest.mark.parametrize("store_zeros", [False, True])
def test_c2_feature_preprocessing(spark, store_zeros):
    out = feature_preprocessing(golden_matrix(spark, store_zeros))
    assert sorted(r["gene_id"] for r in out.genes.collect()) == ["g2", "g3", "g4", "g5"]
    got = as_dict(out.cells)
    expect = {
        ("s1", "g2"): 2.014008, ("s1", "g3"): 3.103928, ("s1", "g4"): 0.0, ("s1", "g5"): 2.474706,
        ("s2", "g2"): 2.659536, ("s2", "g3"): 1.220066, ("s2", "g4"): 1.582248, ("s2", "g5"): 2.318670,
        ("s3", "g2"): 0.0, ("s3", "g3"): 0.0, ("s3", "g4"): 0.0, ("s3", "g5"): 0.0,
        ("s4", "g2"): 0.802864, ("s4", "g3"): 2.635042, ("s4", "g4"): 2.945056, ("s4", "g5"): 2.450847,
    }
    for k, v in expect.items():
        assert round(got.get(k, 0.0), 6) == pytest.approx(v, abs=1e-6), k


def test_c2_statistics(spark):
    uq = transforms.upper_quartile_normalize(golden_matrix(spark))
    st = {r["gene_id"]: r for r in stats.gene_stats(uq).collect()}
    assert [round(st[g]["mean"], 6) for g in GENES] == [0, 2.275471, 3.534767, 2.173853, 3.253657, 1.393204]
    assert [round(st[g]["var"], 6) for g in GENES] == [0, 5.787751, 12.225554, 9.99301, 4.767473, 2.026398]


def test_c3_log_normalize(spark):
    got = as_dict(transforms.log_normalize(golden_matrix(spark)).cells)
    expect = {"s1": [0, 8.031685, 8.568486, 0, 7.824046, 7.130899],
              "s2": [0, 8.724833, 6.959049, 7.824046, 7.824046, 8.740337],
              "s3": [0, 0, 0, 0, 7.824046, 0],
              "s4": [0, 6.645391, 8.211812, 8.922658, 7.824046, 7.824046]}
    for s, vals in expect.items():
        for g, v in zip(GENES, vals):
            assert round(got.get((s, g), 0.0), 6) == pytest.approx(v, abs=1e-6), (s, g)


def test_c4_top_genes(spark):
    ln = transforms.log_normalize(golden_matrix(spark))
    top = selection.top_variance_genes(ln, 4).collect()
    assert [r["gene_id"] for r in top] == ["g4", "g3", "g6", "g2"]
    assert [round(r["var"], 6) for r in top] == [23.572167, 16.130674, 16.030769, 15.959853]


def test_c5_on_top_three(spark):
    out = single_cell_pipeline(golden_matrix(spark), n_top=3)
    got = as_dict(out)
    expect = {"s1": [-0.177611, 0.163270, 0.075298], "s2": [0.154308, 0.063495, 0.175694],
              "s3": [-0.177611, -0.367922, -0.369528], "s4": [0.200914, 0.141158, 0.118536]}
    for s, vals in expect.items():
        for g, v in zip(["g4", "g3", "g6"], vals):
            assert round(got[(s, g)], 6) == pytest.approx(v, abs=1e-6), (s, g)
    assert len(got) == 12


def test_c5_constant_gene_is_null(spark):
    out = transforms.scale_by_variance(golden_matrix(spark))
    g5 = [r["value"] for r in out.filter("gene_id = 'g5'").collect()]
    assert len(g5) == 4 and all(v is None for v in g5)


def test_all_zero_sample_raises_or_drops(spark):
    from exprmat.matrix import ExprMatrix
    m = golden_matrix(spark)
    samples = m.samples.union(spark.createDataFrame([("s5",)], "sample_id string"))
    m5 = ExprMatrix.from_cells(m.cells, samples, m.genes)
    with pytest.raises(ValueError):
        transforms.upper_quartile_factors(m5)
    f = transforms.upper_quartile_factors(m5, on_empty_sample="drop")
    assert sorted(r["sample_id"] for r in f.collect()) == ["s1", "s2", "s3", "s4"]


def test_p6_drops_all_zero_gene(spark):
    kept = filters.drop_zero_genes(golden_matrix(spark))
    assert sorted(r["gene_id"] for r in kept.genes.collect()) == ["g2", "g3", "g4", "g5", "g6"]
