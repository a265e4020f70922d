"""Corpus preparation in five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
reread as the next stage's documents. All but the last return the columns of ``documents``.

1. quality: documents that the co-trained quality classifier rejects go.
2. near_duplicates: of each group linked by 5-word shingles at a similarity of 0.75, the smallest id stays.
3. decontaminate: documents of which a twentieth or more of the words lies in benchmark windows go.
4. mix: documents are kept, dropped or repeated by the rates that match the target token weights.
5. token_ids: what is left is encoded and written to Simple-8b shard files; the rows read back are returned.

Cases: stages 2 and 3 decide row by row: rows that share an id but not a text, and rows without an id,
are documents of their own; of equal rows one stays. Null and empty texts are no near duplicates, have no
words and encode to the end id alone. An empty table stays empty through every stage.

The classifiers and the tokenizer leave no SQL for ``run``, so ``ORACLE_SQL`` is None; the stages are
tested one by one and end to end in ``tests/llm/test_pipeline.py``.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from exprmat.llm import decontaminate as contamination
from exprmat.llm import jaccard, mixing, quality, token_ids
from exprmat.llm.common import fresh_folder, pin, small_side, table
from exprmat.llm.queries import TARGETS, label_domains, tokenizer_path
from exprmat.operators.sampling import RANK, global_rank


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``row_key`` of its own for every row, in doc_id order (null last): the id where all
    ids are there and differ, else the row's rank by id and text."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("row_key", F.col("doc_id").cast("long"))
    ordered = docs.withColumn("_no_id", F.col("doc_id").isNull()).withColumn("_text_hash", F.xxhash64("text"))
    ranked = global_rank(ordered, ["_no_id", "doc_id", "_text_hash"], n_rows=n)
    return ranked.withColumnRenamed(RANK, "row_key").drop("_no_id", "_text_hash")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(with_row_key(docs), "row_key").drop("row_key")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = with_row_key(docs)
    found = contamination.decontaminate(keyed, table(spark, sf_dir, "benchmark"), "row_key")
    dirty = found.where(contamination.contaminated(F.col("n_words"), F.col("n_hit")))
    dirty = pin(dirty.select(F.col("doc_id").alias("dirty_key")).distinct(), "pipeline-contaminated")
    return keyed.join(small_side(dirty, dirty.count()), F.col("row_key") == F.col("dirty_key"), "left_anti").drop("row_key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, label_domains(spark, sf_dir), TARGETS, whole=True)
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return mixed.where("copies > 0").select("whole", F.explode(copies)).select("whole.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = token_ids.write_token_ids(docs, tokenizer_path())
    return token_ids.read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("token_ids", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared scratch folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
