"""Bindings of the driver tables to the reference's data roles.

* long matrix: lineitem ⋈ part — sample = supplier, gene = ``p_brand|p_type``,
  value = Σ l_quantity; samples are all suppliers, genes all brand|type pairs of part;
* the same with further genes that no cell has (``none|p_type``), so that some are all zero;
* class label: the supplier's region (5 classes); regression target: s_acctbal;
* row-array matrix with class label: embeddings (vec_id, embedding, label).

SQL text for the same bindings (used by the DuckDB oracles) sits next to each one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import GENE, SAMPLE, VALUE, VALUES, ExprMatrix, cache_small



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def gene_col() -> F.Column:
    return F.concat_ws("|", "p_brand", "p_type")


def tpch_matrix(spark: SparkSession, sf_dir: str, sparse: bool = False) -> ExprMatrix:
    """Long matrix from lineitem ⋈ part; only the three needed lineitem columns are read."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", gene_col().alias(GENE))
    cells = (li.join(part, li.l_partkey == part.p_partkey)
             .groupBy(F.col("l_suppkey").alias(SAMPLE), GENE)
             .agg(F.sum("l_quantity").alias(VALUE)))
    samples = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE))
    genes = table(spark, sf_dir, "part").select(gene_col().alias(GENE)).distinct()
    if sparse:
        genes = genes.union(table(spark, sf_dir, "part").select(F.concat_ws("|", F.lit("none"), "p_type")).distinct())
    genes = cache_small(genes)
    return ExprMatrix.from_cells(cells, samples, genes).materialized()


def customer_part_matrix(spark: SparkSession, sf_dir: str) -> ExprMatrix:
    """A sparse, single-cell-shaped matrix: sample = customer, gene = part,
    value = Σ l_quantity over the customer's orders (15,000 × 20,000 at sf0.1)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy(F.col("o_custkey").alias(SAMPLE), F.col("l_partkey").alias(GENE))
             .agg(F.sum("l_quantity").alias(VALUE)))
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(SAMPLE))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(GENE))
    return ExprMatrix.from_cells(cells, samples, genes).materialized()


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, label)``: the region name of each supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias(SAMPLE), F.col("r_name").alias("label")))


def acctbal_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, target)``: supplier account balance."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE),
                                                   F.col("s_acctbal").cast("double").alias("target"))


def embedding_rows(spark: SparkSession, sf_dir: str, absolute: bool = False) -> DataFrame:
    """``(sample_id, values array<double>, label)`` from embeddings (float → double first)."""
    e = table(spark, sf_dir, "embeddings")
    vals = F.transform("embedding", lambda x: F.abs(x.cast("double")) if absolute else x.cast("double"))
    return e.select(F.col("vec_id").alias(SAMPLE), vals.alias(VALUES), F.col("label").cast("string").alias("label"))


def embedding_matrix(spark: SparkSession, sf_dir: str, absolute: bool = True) -> ExprMatrix:
    """Embeddings as a long matrix (genes = array positions 0..63)."""
    rows = embedding_rows(spark, sf_dir, absolute)
    return ExprMatrix.from_row_array(rows, SAMPLE, VALUES, drop_zeros=True)


# ------------------------------------------------------------------ SQL (DuckDB oracle)
def sql_cells() -> str:
    return """SELECT l_suppkey AS sample_id, p_brand || '|' || p_type AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def sql_matrix_ctes(sparse: bool = False) -> str:
    """CTEs ``cells, samples, genes, dense`` for the long binding; ``dense`` zero-fills."""
    more = "\n  UNION SELECT DISTINCT 'none|' || p_type FROM part" if sparse else ""
    return f"""cells AS ({sql_cells()}),
samples AS (SELECT s_suppkey AS sample_id FROM supplier),
genes AS (SELECT DISTINCT p_brand || '|' || p_type AS gene_id FROM part{more}),
dense AS (SELECT s.sample_id, g.gene_id, coalesce(c.value, 0.0) AS value
  FROM samples s CROSS JOIN genes g LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.gene_id = g.gene_id)"""


def sql_customer_part_ctes() -> str:
    return """cells AS (SELECT o_custkey AS sample_id, l_partkey AS gene_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
samples AS (SELECT c_custkey AS sample_id FROM customer),
genes AS (SELECT p_partkey AS gene_id FROM part),
dense AS (SELECT s.sample_id, g.gene_id, coalesce(c.value, 0.0) AS value
  FROM samples s CROSS JOIN genes g LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.gene_id = g.gene_id)"""


SQL_REGION_LABELS = """SELECT s_suppkey AS sample_id, r_name AS label FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
