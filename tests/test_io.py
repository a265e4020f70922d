"""Readers and writers: round trips in a temp folder."""

import gzip
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import GENES, GOLDEN, as_dict, golden_matrix
from exprmat.sources import files, matrix_io


def test_detect_format():
    assert matrix_io.detect_format("/a/b/x.parquet") == "parquet"
    assert matrix_io.detect_format("/a/b/x.csv") == "csv"
    assert matrix_io.detect_format("/a/parquet_dir/x.csv") == "csv"
    assert matrix_io.detect_format("/a/parquet_dir/x.csv", rule="anywhere") == "parquet"


def test_csv_round_trip(spark, tmp_dir):
    m = golden_matrix(spark)
    rows, idx = m.to_row_array()
    names = [r["gene_id"] for r in idx.orderBy("gene_idx").collect()]
    path = os.path.join(tmp_dir, "m.csv")
    matrix_io.write_matrix(rows, path, "csv", gene_names=names)
    back = matrix_io.read_matrix(spark, path, fmt="csv", id_col="sample_id")
    assert as_dict(back.cells) == as_dict(m.cells)


def test_csv_without_key_widens_ints(spark, tmp_dir):
    path = os.path.join(tmp_dir, "plain.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c\n1,2,3\n4,x,6\n")
    rows, genes = matrix_io.read_matrix_csv(spark, path)
    vals = sorted(r["values"] for r in rows.collect())
    assert genes == ["a", "b", "c"]
    assert vals[0] == [1.0, 2.0, 3.0] and vals[1][0] == 4.0 and vals[1][1] is None


def test_wide_parquet_arrow_path(spark, tmp_dir):
    path = os.path.join(tmp_dir, "wide.parquet")
    cols = {g: [float(GOLDEN[s][j]) for s in GOLDEN] for j, g in enumerate(GENES)}
    cols["sid"] = list(GOLDEN)
    pq.write_table(pa.table(cols), path, row_group_size=2)
    for limit in (100, 2):   # array(*cols) path, then the pyarrow row-group path
        rows, genes = matrix_io.read_wide_parquet(spark, path, id_col="sid", max_array_columns=limit)
        got = {r["sample_id"]: r["values"] for r in rows.collect()}
        assert genes == GENES
        assert got == {s: [float(v) for v in vals] for s, vals in GOLDEN.items()}
    nokey = os.path.join(tmp_dir, "nokey.parquet")
    pq.write_table(pa.table({g: cols[g] for g in GENES}), nokey, row_group_size=3)
    for limit in (100, 2):
        rows, _ = matrix_io.read_wide_parquet(spark, nokey, None, max_array_columns=limit)
        assert sorted(r["sample_id"] for r in rows.collect()) == [f"nokey.parquet:{i}" for i in range(4)]


def test_sample_files_tree(spark, tmp_dir):
    """One folder per sample, plain and gz, footer rows, genes in another order, a
    second matching file (the first by path wins) and a non-matching file."""
    root = os.path.join(tmp_dir, "tree")
    data = {"A": [("ENSG1", 1.0), ("ENSG2", 2.0), ("__no_feature", 9.0)],
            "B": [("ENSG2", 5.0), ("ENSG1", 4.0), ("__ambiguous", 1.0)]}
    for s, rows in data.items():
        os.makedirs(os.path.join(root, s))
        text = "".join(f"{g}\t{v}\n" for g, v in rows)
        if s == "A":
            with open(os.path.join(root, s, "a.htseq.counts.tsv"), "w") as fh:
                fh.write(text)
            with open(os.path.join(root, s, "z.counts.tsv"), "w") as fh:
                fh.write("ENSG1\t100\n")
        else:
            with gzip.open(os.path.join(root, s, "b.FPKM.txt.gz"), "wt") as fh:
                fh.write(text)
        with open(os.path.join(root, s, "annotations.txt"), "w") as fh:
            fh.write("ENSG1\t777\n")
    m = files.read_sample_files(spark, root)
    got = as_dict(m.cells)
    assert got == {("a.htseq.counts.tsv", "ENSG1"): 1.0, ("a.htseq.counts.tsv", "ENSG2"): 2.0,
                   ("b.FPKM.txt.gz", "ENSG1"): 4.0, ("b.FPKM.txt.gz", "ENSG2"): 5.0}
    draws = files.read_sample_files(spark, root, n_subsamples=5, key="folder")
    assert draws.samples.count() == 5


def test_file_map_last_duplicate_wins(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cart.json")
    cart = [{"file_name": "f1", "associated_entities": [{"entity_submitter_id": "TCGA-1", "case_id": "c1"}]},
            {"file_name": "f2", "associated_entities": [{"entity_submitter_id": "X-2", "case_id": "c2"}]},
            {"file_name": "f3", "associated_entities": [{"entity_submitter_id": "TCGA-1", "case_id": "c1"}]}]
    with open(path, "w") as fh:
        json.dump(cart, fh, indent=1)
    by_case = {r["id"]: r["file_name"] for r in files.read_file_map(spark, path, "case_id").collect()}
    assert by_case == {"c1": "f3", "c2": "f2"}
    tcga = {r["id"]: r["file_name"] for r in
            files.read_file_map(spark, path, "entity_submitter_id", contains="TCGA").collect()}
    assert tcga == {"TCGA-1": "f3"}


def test_labels_na_marker(spark, tmp_dir):
    path = os.path.join(tmp_dir, "exposure.tsv")
    with open(path, "w") as fh:
        fh.write("case_id\tcigarettes_per_day\tother\nc1\t3.5\tx\nc2\t'--\ty\n")
    df = files.read_labels(spark, path, ["case_id", "cigarettes_per_day"])
    got = {r[0]: r[1] for r in df.collect()}
    assert got == {"c1": "3.5", "c2": None}
    assert df.dropna().count() == 1


def test_gene_list_and_versioned_ids(spark, tmp_dir):
    from exprmat.matrix import ExprMatrix
    from exprmat.operators.filters import select_coding_genes
    path = os.path.join(tmp_dir, "genes.txt")
    with open(path, "w") as fh:
        fh.write("gene_id\nENSG00000000001\nENSG00000000003\n")
    lst = files.read_gene_list(spark, path)
    cells = spark.createDataFrame([("s", "ENSG00000000001.5", 1.0), ("s", "ENSG00000000002.1", 2.0),
                                   ("s", "ENSG00000000003.12", 3.0)], "sample_id string, gene_id string, value double")
    m = select_coding_genes(ExprMatrix.from_cells(cells), lst)
    assert sorted(r["gene_id"] for r in m.genes.collect()) == ["ENSG00000000001.5", "ENSG00000000003.12"]
    m2 = select_coding_genes(ExprMatrix.from_cells(cells), lst, mode="contains")
    assert m2.n_genes == 2


def test_matrix_market_size_line(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m.mtx")
    with open(path, "w") as fh:
        fh.write("%%MatrixMarket matrix coordinate real general\n% comment\n3 4 3\n1 1 5\n3 4 2\n3 4 1\n")
    m = matrix_io.read_coo(spark, path)
    assert m.n_samples == 3 and m.n_genes == 4
    assert as_dict(m.cells) == {(0, 0): 5.0, (2, 3): 3.0}


def test_results_round_trip_and_append(spark, tmp_dir):
    df = spark.createDataFrame([("n200", "Dask", 1.5), ("n200", "SPE", 2.5)], "dimension string, framework string, value double")
    path = os.path.join(tmp_dir, "res")
    files.write_results(df, path)
    files.write_results(df, path, mode="append")
    back = files.read_results(spark, path)
    assert back.count() == 4 and sorted(r["value"] for r in back.collect()) == [1.5, 1.5, 2.5, 2.5]


def test_repartition_by_size_minimum_one(spark):
    df = spark.range(10)
    assert matrix_io.repartition_by_size(df, 10**12).rdd.getNumPartitions() == 1
    assert matrix_io.repartition_by_size(df, 16).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_long_formats(spark, tmp_dir, fmt):
    m = golden_matrix(spark)
    path = os.path.join(tmp_dir, f"long.{fmt}")
    matrix_io.write_matrix(m.cells, path, fmt, target_file_bytes=200)
    if fmt == "parquet":
        back = spark.read.parquet(path)
    else:
        back = spark.read.option("header", True).schema("sample_id string, gene_id string, value double").csv(path)
    assert as_dict(back) == as_dict(m.cells)


def test_sample_files_are_opened_once(spark, tmp_dir):
    """The matrix read from a tree of small files stands on rows written once, not on the files."""
    from exprmat.sources.files import read_sample_files

    for s in ("s1", "s2"):
        os.makedirs(f"{tmp_dir}/{s}")
        for name, v in (("a.counts.tsv", 1), ("b.counts.tsv", 2)):
            with open(f"{tmp_dir}/{s}/{name}", "w") as f:
                f.write(f"ENSG1\t{v}.5\nENSG1\t1\nENSG2\t\n__no_feature\t9\n")
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    m = read_sample_files(spark, tmp_dir, key="folder")
    assert sorted(m.cells.collect()) == [(s, g, v) for s in ("s1", "s2") for g, v in (("ENSG1", 2.5), ("ENSG2", None))]
    assert not [f for df in (m.cells, m.samples, m.genes) for f in df.inputFiles() if tmp_dir in f]
    assert spark.conf.get(setting) == before


def test_sample_tree_has_one_file_a_sample(spark, tmp_dir):
    from exprmat.plans import bindings as B
    from exprmat.plans import catalog

    sf = "/root/testdata/sf0.001"
    catalog._write_sample_tree(spark, sf, f"file:{tmp_dir}/tree")
    want = {}
    for r in B.tpch_matrix(spark, sf).cells.collect():
        want.setdefault(f"sample_id={r.sample_id}", ["__no_feature\t1.0"]).append(f"{r.gene_id}\t{r.value}")
    got = {}
    for folder in os.listdir(f"{tmp_dir}/tree"):
        assert os.listdir(f"{tmp_dir}/tree/{folder}") == ["part-0.csv"]
        with open(f"{tmp_dir}/tree/{folder}/part-0.csv") as f:
            got[folder] = sorted(f.read().splitlines())
    assert got == {k: sorted(v) for k, v in want.items()}
