"""Exact sums and moment states: against fractions, in any partitioning, merged and subtracted."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprmat.matrix import ExprMatrix
from exprmat.operators import exact, ml, selection, stats, transforms
from exprmat.operators.filters import filter_low_signal


def values(seed, n=400):
    rng = random.Random(seed)
    return [rng.choice([rng.gauss(0, 1), rng.random() * 1e9, 0.1, -1e-7 * rng.random(), 3.0, 2.0 ** rng.randint(-25, 40)]) for _ in range(n)]


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "g string, value double").repartition(parts)


def finished(df):
    state = exact.moment_state(df, ["g"])
    rows = state.withColumn("rows", F.col("k") + F.col("missing") + F.when(F.col("g") == "zeros", 5).otherwise(0))
    return {r.g: tuple(r)[1:] for r in exact.finish(rows, ["g"], "rows").collect()}


def test_equals_fractions(spark):
    rows = [("a", v) for v in values(1)] + [("zeros", v) for v in values(2, 30)] + [("one", 0.3), ("none", None), ("a", None)]
    got = finished(frame(spark, rows, 5))
    for g, zeros in (("a", 0), ("zeros", 5), ("one", 0)):
        x = [Fraction(v) for k, v in rows if k == g and v is not None] + [Fraction(0)] * zeros
        n, s = len(x), sum(x)
        spread = sum(v * v for v in x) - s * s / n
        want = (n, float(s), float(s / n), float(spread / (n - 1)) if n > 1 else None, float(spread / n))
        assert got[g] == want
    assert got["none"] == (0, 0.0, None, None, None)


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_ties_in_any_partitioning(spark, parts):
    """Genes with the same values in another order, or the same sum from other values, tie exactly."""
    v = values(3, 60)
    rng = random.Random(4)
    rows = []
    for g in ("a", "b", "c"):
        rows += [(g, x) for x in rng.sample(v, len(v))]
    rows += [("halves", x) for x in [0.5] * 8] + [("ones", 1.0)] * 4 + [("tenths", x) for x in (0.1, 0.2, 0.3)] + [("tenths2", x) for x in (0.3, 0.2, 0.1)]
    got = finished(frame(spark, rows, parts))
    assert got["a"] == got["b"] == got["c"] == finished(frame(spark, rows, 1))["a"]
    assert got["halves"][1] == got["ones"][1] == 4.0 and got["tenths"] == got["tenths2"]


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_thresholds_and_top_genes_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(7)
    base = rng.gamma(2.0, 3.0, 24)
    rows = []
    for g in range(8):  # genes 2k and 2k + 1 hold the same values in another order
        for s, v in enumerate(rng.permutation(base * (1 + g // 2))):
            rows.append((f"s{s:02d}", f"g{g}", float(v)))
    m = ExprMatrix.from_cells(spark.createDataFrame(rows, "sample_id string, gene_id string, value double").repartition(parts))
    st = {r.gene_id: (r.total, r["mean"], r["var"]) for r in stats.gene_stats(m).collect()}
    assert all(st[f"g{2 * k}"] == st[f"g{2 * k + 1}"] for k in range(4))
    assert [r.gene_id for r in selection.top_variance_genes(m, 3).collect()] == ["g6", "g7", "g4"]
    # the 3/7 quantile lies exactly on genes 2 and 3 (both equal): a strict comparison drops both
    assert sorted(r.gene_id for r in filter_low_signal(m, 3 / 7).genes.collect()) == ["g4", "g5", "g6", "g7"]
    f = {r.sample_id: r.scaling_factor for r in transforms.upper_quartile_factors(m).collect()}
    one = ExprMatrix.from_cells(spark.createDataFrame(rows, "sample_id string, gene_id string, value double").repartition(1))
    assert f == {r.sample_id: r.scaling_factor for r in transforms.upper_quartile_factors(one).collect()}


def test_states_merge_and_subtract_without_error(spark):
    old, new = [(random.Random(i).choice("ab"), v) for i, v in enumerate(values(5))], [("a", v) for v in values(6, 50)] + [("c", 1.5)]
    a, b = (exact.moment_state(frame(spark, r, 3), ["g"]) for r in (old, new))
    whole = exact.moment_state(frame(spark, old + new, 4), ["g"])

    def rows(s):
        return {r.g: tuple(exact.finish(s.withColumn("n_rows", F.col("k")), ["g"], "n_rows").where(F.col("g") == r.g).first()) for r in s.select("g").collect()}

    both = exact.merge_states([a, b], ["g"])
    assert rows(both) == rows(whole)
    back = exact.subtract_state(both, b, ["g"])
    assert {k: v for k, v in rows(back).items() if v[1]} == rows(a)
    assert rows(back)["c"] == ("c", 0, 0.0, None, None, None)


def test_written_state_of_a_matrix_grows_with_its_samples(spark, tmp_path):
    def matrix(lo, hi):
        cells = [(s, g, float((s * 7 + g * 3) % 11) / 3) for s in range(lo, hi) for g in range(6) if (s + g) % 3]
        return ExprMatrix.from_cells(spark.createDataFrame(cells, "sample_id long, gene_id long, value double"),
                                     spark.range(lo, hi).select(F.col("id").alias("sample_id")), spark.range(6).select(F.col("id").alias("gene_id")))

    stats.gene_state(matrix(0, 40)).write.parquet(f"{tmp_path}/state")
    kept = spark.read.parquet(f"{tmp_path}/state")
    grown = exact.merge_states([kept, stats.gene_state(matrix(40, 55))], ["gene_id"])
    got = {tuple(r) for r in stats.gene_stats_from_state(grown, 55).collect()}
    assert got == {tuple(r) for r in stats.gene_stats(matrix(0, 55)).collect()}


def test_out_of_range_raises(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        finished(frame(spark, [("a", 1e300)], 1))


def test_fold_scalers_equal_refits_and_hold_no_leak(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 4), [float(x) for x in rng.normal(i % 4, 1, 5)]) for i in range(80)]
    rows[3][2][2] = None
    df = spark.createDataFrame(rows, "sample_id long, fold int, values array<double>").repartition(6)
    got = {r.fold: (r.means, r.scales) for r in ml.fit_fold_scalers(df).collect()}
    for f in range(4):
        r = ml.fit_standard_scaler(df.where(F.col("fold") != f)).first()
        assert got[f] == (r.means, r.scales)
    # rows of the held-out fold may change as they like
    other = df.withColumn("values", F.when(F.col("fold") == 1, F.transform("values", lambda x: x * 1000 + 5)).otherwise(F.col("values")))
    again = {r.fold: (r.means, r.scales) for r in ml.fit_fold_scalers(other).collect()}
    assert again[1] == got[1] and again[0] != got[0]
    assert all(math.isfinite(x) for x in got[0][1])


def test_fold_states_read_the_table_once(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("sample_id"), (F.col("id") % 3).cast("int").alias("fold"),
                                  F.array(F.col("id").cast("double"), F.rand(1)).alias("values"))
    rows.write.parquet(f"{tmp_path}/t")
    plan = ml._positions_state(spark.read.parquet(f"{tmp_path}/t"), ["fold"], "values")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan parquet") <= 2  # once, in the initial and the adaptive plan


def test_baseline_matrix_equals_the_dense_one(spark):
    from exprmat.operators.baseline import scale_sparse
    from exprmat.operators.transforms import scale_by_variance

    rng = random.Random(8)
    cells = [(s, g, rng.choice([None, rng.random() * 9, rng.random()])) for s in range(20) for g in range(7) if rng.random() < 0.3 and g != 5]
    cells += [(s, 6, 2.0) for s in range(20) if (s, 6) not in {(a, b) for a, b, _ in cells}]
    cells = [(s, g, 2.0 if g == 6 else v) for s, g, v in cells]  # gene 6 is constant, gene 5 has no cell
    m = ExprMatrix.from_cells(spark.createDataFrame(cells, "sample_id long, gene_id long, value double"),
                              spark.range(22).select(F.col("id").alias("sample_id")), spark.range(7).select(F.col("id").alias("gene_id")))
    for by in ("var", "std"):
        z = scale_sparse(m, by)
        dense = scale_by_variance(m, by)
        want = {(r.sample_id, r.gene_id): r.value for r in dense.collect()}
        assert {(r.sample_id, r.gene_id): r.value for r in z.dense_long().collect()} == want and len(want) == 22 * 7
        assert z.cells.count() == len(cells)
        full = ExprMatrix.from_cells(dense, m.samples, m.genes)
        assert {tuple(r) for r in z.gene_stats().collect()} == {tuple(r) for r in stats.gene_stats(full).collect()}
        for r in z.sample_totals().collect():
            v = [x for (s, _), x in want.items() if s == r.sample_id and x is not None]
            assert (r.n, r.least, r.greatest) == (len(v), min(v), max(v)) and r.total == pytest.approx(sum(v))
        w = spark.createDataFrame([(g, c, float(g * 3 + c)) for g in range(7) for c in range(2)], "gene_id long, component int, weight double")
        for r in z.project(w).collect():
            v = sum(x * (g * 3 + r.component) for (s, g), x in want.items() if s == r.sample_id and x is not None)
            assert r.value == pytest.approx(v)
        top = [(r.gene_id, r.value) for r in z.top_values(2).collect() if r.sample_id == 3]
        own = sorted(((want[3, g], g) for s, g, v in cells if s == 3 and want[3, g] is not None), key=lambda x: (-x[0], x[1]))
        assert sorted(top) == sorted((g, x) for x, g in own[:2])
    plan = scale_sparse(m).gene_stats()._jdf.queryExecution().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan
