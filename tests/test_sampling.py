"""Seeded ranks, splits, folds and stratified samples."""

import math

from pyspark.sql import functions as F

from exprmat.operators import sampling


def ids(spark, n, labels=None):
    rows = [(i, (labels[i % len(labels)] if labels else "x")) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, label string")


def test_global_rank_is_permutation(spark):
    df = ids(spark, 257)
    r = sampling.seeded_rank(df, "sample_id", 42).select("_rank").collect()
    assert sorted(x[0] for x in r) == list(range(257))


def test_rank_independent_of_partitioning(spark):
    df = ids(spark, 300)
    a = {r[0]: r[1] for r in sampling.seeded_rank(df.repartition(1), "sample_id").select("sample_id", "_rank").collect()}
    b = {r[0]: r[1] for r in sampling.seeded_rank(df.repartition(13), "sample_id").select("sample_id", "_rank").collect()}
    assert a == b


def test_train_test_split_sizes(spark):
    for n in (10, 101, 362):
        s = sampling.train_test_split(ids(spark, n), "sample_id", 0.3, 42)
        c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
        assert c["test"] == math.ceil(0.3 * n) and c["test"] + c["train"] == n
        assert s.select("sample_id").distinct().count() == n


def test_kfold_sizes(spark):
    n, k = 103, 10
    f = sampling.kfold(ids(spark, n), "sample_id", k, 42)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert len(sizes) == k and sum(sizes) == n and sizes[-1] - sizes[0] <= 1


def test_stratified_kfold_balances_classes(spark):
    f = sampling.kfold(ids(spark, 200, ["a", "a", "a", "b"]), "sample_id", 5, 42, stratify="label")
    per = f.groupBy("fold", "label").count().collect()
    for lab in ("a", "b"):
        counts = [r["count"] for r in per if r["label"] == lab]
        assert max(counts) - min(counts) <= 1


def test_stratified_sample_quotas(spark):
    df = ids(spark, 1000, ["a"] * 6 + ["b"] * 3 + ["c"])
    s = sampling.stratified_sample(df, "label", 77, "sample_id", 42)
    c = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert sum(c.values()) == 77
    assert c == {"a": 46, "b": 23, "c": 8}


def test_hot_label_is_spread(spark, monkeypatch):
    """A label holding most rows is ranked across partitions, not in one task
    (ranking partitions sized small here so 2,000 rows need several)."""
    monkeypatch.setattr(sampling, "RANK_ROWS_PER_PARTITION", 100)
    df = ids(spark, 2000, ["hot"] * 9 + ["cold"])
    r = sampling.seeded_rank(df, "sample_id", 42, within="label")
    parts = r.filter(F.col("label") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    got = sorted(x[0] for x in r.filter(F.col("label") == "hot").select("_rank").collect())
    assert got == list(range(1800))


def test_sample_with_replacement_repeatable(spark):
    df = ids(spark, 50)
    a = sampling.sample_with_replacement(df, "sample_id", 80, 42).orderBy("draw").collect()
    b = sampling.sample_with_replacement(df.repartition(3), "sample_id", 80, 42).orderBy("draw").collect()
    assert a == b and len(a) == 80 and len({r["sample_id"] for r in a}) < 80


def test_ranks_of_two_million_rows_with_payload(spark):
    """Beyond one range partition the ranks are 0..n-1 and the split is exact."""
    n = 2_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("sample_id"), (F.col("id") % 97).alias("payload"))
    r = sampling.seeded_rank(df, "sample_id", 42).agg(F.min("_rank"), F.max("_rank"), F.count_distinct("_rank"), F.sum("payload")).first()
    assert tuple(r) == (0, n - 1, n, df.agg(F.sum("payload")).first()[0])
    s = sampling.train_test_split(df, "sample_id", 0.3, 42)
    assert {x["split"]: x["count"] for x in s.groupBy("split").count().collect()} == {"test": 600_000, "train": 1_400_000}


def test_many_strata(spark):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") / 3).cast("int").alias("label"))
    r = sampling.seeded_rank(df, "sample_id", within="label").groupBy("label").agg(F.sort_array(F.collect_list("_rank")).alias("r"))
    assert r.where("r = array(0, 1, 2)").count() == 1000
