"""The pipeline: each stage's decisions take effect, and run() equals the stages by hand."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp
    from exprmat.llm.decontaminate import decontaminate
    from exprmat.llm.jaccard import jaccard_components
    from exprmat.llm.token_ids import Encoder

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        held[name] = docs
    assert held["quality"].count() <= 200
    found = jaccard_components(held["near_duplicates"])
    assert found.where("component_id <> doc_id").count() == 0
    want = {r.component_id for r in jaccard_components(held["quality"]).collect()}
    assert want == {r.doc_id for r in held["near_duplicates"].collect()}
    assert decontaminate(held["decontaminate"], spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0 and 20 * n_hit >= n_words").count() == 0
    out = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in cp.STAGES[-1][1](spark, docs, SF).collect())
    library, at, rows = Encoder(cp.tokenizer_path()).library, 0, []
    for r in docs.orderBy("doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        rows.append((at, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert out == rows
    whole = cp.run(spark, SF)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in whole.collect()) == rows


def test_stages_decide_by_row(spark):
    """Repeated ids of different texts, null ids, equal rows, null and empty texts, and no rows at all."""
    import corpus_pipeline as cp

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta"))
    rows = [(5, a), (5, b), (3, b), (None, a + " more"), (None, "only here " + a[:300]), (None, item), (7, None), (8, ""), (9, b), (9, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def texts(df):
        assert df.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    kept = texts(cp.near_duplicate_stage(spark, docs, SF))
    assert kept == sorted([(5, a), (3, b), (None, "only here " + a[:300]), (None, item), (7, None), (8, "")], key=repr)
    clean = texts(cp.decontamination_stage(spark, docs, SF))
    assert clean == sorted([r for r in rows if r[1] != item], key=repr)
    for _, stage in cp.STAGES[1:3]:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_a_null_id_links_its_neighbours(spark):
    from exprmat.llm.jaccard import jaccard_components

    words = [f"w{k}" for k in range(100)]
    first, second = words[:], words[:]
    first[:6], second[-6:] = [f"x{k}" for k in range(6)], [f"y{k}" for k in range(6)]
    rows = [(1, " ".join(first)), (None, " ".join(words)), (3, " ".join(second)), (None, "alone " * 3)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (3, 1)]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]


def test_entry_registers_llm_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
