"""Order statistics, row-safe splits, rare-gram containment and positional pairing."""

import csv
import math
import random

import pytest
from pyspark.sql import functions as F

from exprmat.operators import order_stats, sampling
from exprmat.operators.filters import containing_any
from exprmat.operators.joins import join_labels
from exprmat.plans import bulk, singlecell
from exprmat.sources import positions


@pytest.mark.parametrize("listed", [10_000, 3])
def test_order_statistics_equal_a_sort(spark, listed):
    rng = random.Random(1)
    x = [rng.choice([0.0, -5.0, 1e-300, 1e308, -1e308, rng.random(), rng.gauss(0, 1e6), 7.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v, float(int(v)) if abs(v) < 1e9 else None) for v in x] + [(None, float("nan"))], "a double, b double").repartition(7)
    a, b = sorted(x), sorted(float(int(v)) for v in x if abs(v) < 1e9)
    ranks = [0, 1, 17, 1499, 1500, 2998]
    got = order_stats.order_statistics(df, {"a": ranks, "b": [0, len(b) - 1, len(b) // 2]}, listed)
    assert [got["a", r] for r in ranks] == [a[r] for r in ranks]
    assert [got["b", r] for r in (0, len(b) - 1, len(b) // 2)] == [b[0], b[-1], b[len(b) // 2]]


def test_quantiles_equal_percentile(spark):
    df = spark.range(1, 5000).select((F.pow("id", F.lit(1.7)) % 977).alias("x"), F.lit(2.5).alias("y"), F.lit(None).cast("double").alias("z")).cache()
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        want = df.agg(F.percentile("x", F.lit(q)), F.percentile("y", F.lit(q))).first()
        got = order_stats.exact_quantiles(df, ["x", "y", "z"], q)
        assert (got["x"], got["y"], got["z"]) == (want[0], want[1], None)


def rows_with_repeats(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f")], "sample_id long, payload string").repartition(3)


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = rows_with_repeats(spark)
    for out in (sampling.train_test_split(df, "sample_id", 0.3), sampling.kfold(df, "sample_id", 3), sampling.seeded_rank(df, "sample_id"),
                sampling.kfold(df, "sample_id", 2, stratify="sample_id"), sampling.global_rank(df, ["sample_id"])):
        assert sorted(r.payload for r in out.collect()) == list("abcdef")
    assert sorted(r["_rank"] for r in sampling.seeded_rank(df, "sample_id").collect()) == list(range(6))
    for n in range(8):
        assert sampling.sample_ids(df, "sample_id", n).count() == min(n, 6)
    split = sampling.train_test_split(df, "sample_id", 0.3).collect()
    sides: dict = {}
    for r in split:
        sides.setdefault(r.sample_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())


def test_splits_equal_ranks(spark):
    df = spark.range(997).select(F.concat(F.lit("id"), "id").alias("sample_id"))
    order = [r.sample_id for r in sampling.seeded_rank(df, "sample_id").orderBy("_rank").collect()]
    test = {r.sample_id for r in sampling.train_test_split(df).where("split = 'test'").collect()}
    assert test == set(order[:math.ceil(0.3 * 997)])
    folds = {r.sample_id: r.fold for r in sampling.kfold(df, k=7).collect()}
    sizes = [997 // 7 + (j < 997 % 7) for j in range(7)]
    assert [folds[i] for i in order] == [j for j, s in enumerate(sizes) for _ in range(s)]
    assert {r.sample_id for r in sampling.sample_ids(df, "sample_id", 100).collect()} == set(order[:100])


def test_labels_must_be_unique(spark):
    feats = spark.createDataFrame([(1,), (1,), (2,)], "sample_id long")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, label string")
    assert join_labels(feats, labels).count() == 3
    with pytest.raises(ValueError, match="more than once"):
        join_labels(feats, labels.union(labels))


def test_containing_any_equals_nested_loop(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ABCG0é") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    listed = [w[1:] if len(w) > 3 else w for w in rng.sample(words, 25)] + ["A0", "zzz", None, "not there at all", "ABCABC"]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, -1), ("", -2)], "t string, n int")
    lst = spark.createDataFrame([(x,) for x in listed], "p string")
    for pick in (listed, [x for x in listed if x and len(x) > 5]):
        got = {r.n for r in containing_any(df, "t", lst.where(F.col("p").isin([x for x in pick if x])), "p").collect()}
        assert got == {i for i, w in enumerate(words) if any(x in w for x in pick if x)}
    assert containing_any(df, "t", spark.createDataFrame([("",)], "p string"), "p").count() == len(words) + 1
    assert containing_any(df, "t", lst.limit(0), "p").count() == 0


def test_containing_any_joins_without_a_nested_loop(spark):
    genes = spark.range(20_000).select(F.format_string("ENSG%011d.%d", "id", F.col("id") % 9).alias("g"))
    listed = spark.range(0, 1_000_000).select(F.format_string("ENSG%011d", F.col("id") * 4).alias("p"))
    out = containing_any(genes, "g", listed, "p")
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert out.count() == 5000


# ------------------------------------------------------------------ positions


def write_parts(folder, header, rows, sizes):
    folder.mkdir()
    at = 0
    for k, n in enumerate(sizes):
        with open(folder / f"part-{k:03d}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(header)
            w.writerows(rows[at:at + n])
        at += n
    assert at == len(rows)
    return str(folder)


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    rows = [[f"name, {i}" if i % 3 else 'say "hi"', i, "x,y" if i % 5 == 0 else ""] for i in range(900)]
    rows[400] = ["label", "n", "note"]  # equal to the header
    path = write_parts(tmp_path / "t", ["label", "n", "note"], rows, [1, 500, 0, 399])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got, names = positions.csv_rows(spark, path)
        assert got.rdd.getNumPartitions() > 4
        table = {r.position: r.fields for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert names == ["label", "n", "note"]
    assert [table[i] for i in range(900)] == [[str(x) for x in r] for r in rows]


def test_bad_files_raise(spark, tmp_path):
    path = write_parts(tmp_path / "a", ["x", "y"], [[1, 2], [3, 4]], [2])
    (tmp_path / "a" / "part-9.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        positions.csv_rows(spark, path)
    (tmp_path / "b.csv").write_text("x,y\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="a row has 3 fields"):
        positions.csv_rows(spark, str(tmp_path / "b.csv"))[0].collect()


def test_pairs_csv_and_parquet_by_row(spark, tmp_path):
    n = 300
    path = write_parts(tmp_path / "f", ["g1", "g2"], [[i, i * 2] for i in range(n)], [100, 150, 50])
    labels = spark.range(0, n, 1, 7).select(F.concat(F.lit("c"), F.col("id") % 4).alias("y"))
    labels.write.parquet(str(tmp_path / "l.parquet"))
    rows, names = positions.read_rows_by_position(spark, path)
    lab = positions.read_labels_by_position(spark, str(tmp_path / "l.parquet"), "y")
    got = {r.sample_id: (r["values"], r.label) for r in positions.pair_by_position(rows, lab).collect()}
    assert names == ["g1", "g2"] and got == {i: ([float(i), 2.0 * i], f"c{i % 4}") for i in range(n)}
    with pytest.raises(ValueError, match="cannot pair"):
        positions.pair_by_position(rows, lab.limit(5))


def test_path_pipelines_equal_the_keyed_ones(spark, tmp_path):
    rng = random.Random(5)
    n, g = 90, 12
    data = [[round(rng.random() * 20 * (k + 1), 3) if rng.random() < 0.7 else 0 for k in range(g)] for _ in range(n)]
    names = [f"g{k:02d}" for k in range(g)]
    path = write_parts(tmp_path / "x", names, data, [40, 50])
    wide = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in names)).coalesce(1)
    wide.write.option("maxRecordsPerFile", 35).parquet(str(tmp_path / "x.parquet"))
    from exprmat.matrix import ExprMatrix

    cells = [(i, names[k], float(v)) for i, r in enumerate(data) for k, v in enumerate(r)]
    m = ExprMatrix.from_cells(spark.createDataFrame(cells, "sample_id long, gene_id string, value double"), drop_zeros=True)
    want = {(r.sample_id, r.gene_id): r.value for r in singlecell.single_cell_pipeline(m, 5).collect()}
    for p in (path, str(tmp_path / "x.parquet")):
        assert {(r.sample_id, r.gene_id): r.value for r in singlecell.single_cell_pipeline_path(spark, p, 5).collect()} == want

    y = [[f"c{int(sum(r) > 600)}", sum(r)] for r in data]
    labels = write_parts(tmp_path / "y", ["cls", "target"], y, [10, 30, 50])
    keyed = spark.createDataFrame([(i, c, float(t)) for i, (c, t) in enumerate(y)], "sample_id long, cls string, target double")
    a = bulk.bulk_pipeline_path(spark, path, labels, "cls", k=3, stratify=True, metric="f1", numTrees=2, bootstrap=False, featureSubsetStrategy="all").first()
    b = bulk.bulk_pipeline(m, keyed.select("sample_id", F.col("cls").alias("label")), k=3, stratify=True, metric="f1", numTrees=2, bootstrap=False, featureSubsetStrategy="all").first()
    assert a == b
    r = bulk.bulk_pipeline_path(spark, path, labels, "target", "regression", grid={"maxDepth": [1, 3]}, numTrees=4, metric="rmse").first()
    assert r.n_folds == 5 and r.n_train + r.n_test == n and r.eval_score > 0
    with pytest.raises(ValueError, match="stratified"):
        bulk.bulk_pipeline(m, keyed, "regression", "target", stratify=True)
