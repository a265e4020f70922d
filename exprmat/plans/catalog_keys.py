"""Registered queries of positional keys, exact states, order statistics and gram joins.

Registered like those of ``catalog``: every query reads whole driver tables and has its DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import GENE, SAMPLE, VALUES, materialize
from ..operators import exact, filters, ml, order_stats, sampling, stats, transforms
from ..session import scratch_path
from . import bindings as B
from .catalog import CTE, CTE_EMB, SQL_C6_CUSTOMERS, _sql_c8, _sql_lognorm, _sql_uq_factors, r6, register, sql_key

# ---------------------------------------------------------------------------- S1, J3, C6, C8 by position
# Matrices written without their key, in row order, in many parts; row i of the key order is
# then row i of the files.


def _in_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartitionByRange(parts, key).sortWithinPartitions(key)


def _write_keyless_csv(df: DataFrame, key: str, columns: list[str], path: str, parts: int) -> None:
    """Records of ``columns`` without the key, each file under the header; fields in quotes."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    line = F.concat_ws(",", *quoted)
    header = ",".join(f'"{c}"' for c in columns)
    # one string column named like the header line; a tab never occurs, so nothing is quoted again
    (_in_parts(df.select(key, line.alias(header)), key, parts).drop(key)
     .write.option("header", True).option("sep", "\t").option("quote", "").csv(path))


def _write_keyless_rows(rows: DataFrame, width: int, path: str, fmt: str, parts: int) -> None:
    """Row arrays as one column per gene (g000, g001, …), without their ids."""
    names = [f"g{i:03d}" for i in range(width)]
    flat = rows.select(SAMPLE, *[F.col(VALUES)[i].alias(n) for i, n in enumerate(names)])
    if fmt == "csv":
        _write_keyless_csv(flat, SAMPLE, names, path, parts)
    else:
        _in_parts(flat, SAMPLE, parts).drop(SAMPLE).write.parquet(path)


SQL_J3_POSITION = """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS sample_id, c_mktsegment AS label, c_comment_like AS note
FROM (SELECT *, c_name || ', "' || c_mktsegment || '"' AS c_comment_like FROM customer)"""


@register("j3_positional_labels", SQL_J3_POSITION)
def q_positional_labels(spark, sf_dir):
    """Customers' notes (CSV with quotes and commas, 5 parts) paired by row with their segments (parquet, 3 parts)."""
    from ..sources.positions import csv_rows, pair_by_position, read_labels_by_position

    c = B.table(spark, sf_dir, "customer")
    note = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    notes, labels = scratch_path(spark, "notes"), scratch_path(spark, "segments") + ".parquet"
    _write_keyless_csv(c.select("c_custkey", note.alias("note")), "c_custkey", ["note"], notes, 5)
    _in_parts(c.select("c_custkey", "c_mktsegment"), "c_custkey", 3).drop("c_custkey").write.parquet(labels)
    rows, _ = csv_rows(spark, notes)
    rows = rows.select(F.col("position").alias(SAMPLE), F.col("fields")[0].alias("note"))
    return pair_by_position(rows, read_labels_by_position(spark, labels, "c_mktsegment")).select(SAMPLE, "label", "note")


_SQL_EMB_HVG = f"""WITH {CTE_EMB},
ln AS ({_sql_lognorm('dense')}),
hv AS (SELECT gene_id, var_samp(value) AS var FROM ln GROUP BY gene_id ORDER BY var DESC, gene_id LIMIT 20),
sel AS (SELECT ln.* FROM ln JOIN hv USING (gene_id)),
st AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM sel GROUP BY gene_id),
pos AS (SELECT vec_id AS sample_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)"""
SQL_C6_PATH = _SQL_EMB_HVG + """
SELECT place AS sample_id, 'g' || lpad(CAST(gene_id AS VARCHAR), 3, '0') AS gene_id,
       round(CASE WHEN v = 0 THEN NULL ELSE (value - m) / v END, 6) AS value
FROM sel JOIN st USING (gene_id) JOIN pos USING (sample_id)"""


def _c6_path(spark, sf_dir, fmt):
    from .singlecell import single_cell_pipeline_path

    path = scratch_path(spark, "cells") + f".{fmt}"
    _write_keyless_rows(B.embedding_rows(spark, sf_dir, absolute=True), 64, path, fmt, 7)
    return r6(single_cell_pipeline_path(spark, path, n_top=20))


@register("c6_single_cell_pipeline_path", SQL_C6_PATH)
def q_c6_path_csv(spark, sf_dir):
    """C6 from CSV without a key column in seven parts."""
    return _c6_path(spark, sf_dir, "csv")


@register("c6_single_cell_pipeline_path_parquet", SQL_C6_PATH)
def q_c6_path_parquet(spark, sf_dir):
    """C6 from parquet without a key column in seven parts."""
    return _c6_path(spark, sf_dir, "parquet")


def _c8_path(spark, sf_dir, task, label, **options):
    from .bulk import bulk_pipeline_path

    rows, idx = B.tpch_matrix(spark, sf_dir).to_row_array()
    path, labels = scratch_path(spark, "features"), scratch_path(spark, "labels") + ".parquet"
    _write_keyless_rows(materialize(rows, "rows"), idx.count(), path, "csv", 6)
    lab = (B.region_labels(spark, sf_dir) if task == "classification" else B.acctbal_target(spark, sf_dir))
    _in_parts(lab, SAMPLE, 4).drop(SAMPLE).write.parquet(labels)
    out = bulk_pipeline_path(spark, path, labels, label, task, **options)
    return out.select("task", "n_train", "n_test", F.col("n_folds").cast("bigint").alias("n_folds"),
                      ((F.col("mean_cv") <= 1) & (F.col("eval_score") <= 1) & (F.col("var_cv") >= 0)).alias("bounded"))


@register("c8_bulk_pipeline_path", _sql_c8("classification", 3))
def q_c8_path(spark, sf_dir):
    """C8 from keyless CSV features and parquet labels, folds stratified, scored by f1."""
    return _c8_path(spark, sf_dir, "classification", "label", k=3, stratify=True, metric="f1", numTrees=5, maxDepth=3)


@register("c8_bulk_pipeline_path_regression_grid", _sql_c8("regression", 5))
def q_c8_path_grid(spark, sf_dir):
    """C8 regression with a grid search from keyless files (Q17)."""
    return _c8_path(spark, sf_dir, "regression", "target", grid={"maxDepth": [2, 3]}, numTrees=3)


# ---------------------------------------------------------------------------- A1–A3 by states
SQL_STATE_MERGED = f"""WITH {CTE}
SELECT gene_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var
FROM dense GROUP BY gene_id"""
SQL_STATE_TAKEN = f"""WITH {CTE}
SELECT gene_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var
FROM dense WHERE sample_id % 3 <> 0 GROUP BY gene_id"""


def _written_state(m, which):
    part = m.restrict_samples(m.samples.where(which))
    return materialize(stats.gene_state(part), "gene_state"), part.n_samples


@register("a1_a3_gene_stats_appended", SQL_STATE_MERGED)
def q_state_merged(spark, sf_dir):
    """Gene statistics from the written state of two thirds of the suppliers and that of the new third."""
    m = B.tpch_matrix(spark, sf_dir)
    (old, a), (new, b) = _written_state(m, "sample_id % 3 <> 0"), _written_state(m, "sample_id % 3 = 0")
    return r6(stats.gene_stats_from_state(exact.merge_states([old, new], [GENE]), a + b))


@register("a1_a3_gene_stats_removed", SQL_STATE_TAKEN)
def q_state_subtracted(spark, sf_dir):
    """The same after a third of the suppliers went, from the whole state and theirs."""
    m = B.tpch_matrix(spark, sf_dir)
    gone, n = _written_state(m, "sample_id % 3 = 0")
    return r6(stats.gene_stats_from_state(exact.subtract_state(stats.gene_state(m), gone, [GENE]), m.n_samples - n))


# ---------------------------------------------------------------------------- L2 within L7: scalers of all folds
SQL_FOLD_SCALERS = f"""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk, count(*) OVER () AS n FROM embeddings),
f AS (SELECT vec_id, CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
                          ELSE n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM r),
x AS (SELECT fold, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings JOIN f USING (vec_id), range(1, 65) t(i))
SELECT CAST(o.fold AS INTEGER) AS fold, CAST(x.place AS INTEGER) AS place, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale
FROM range(5) o(fold), x WHERE x.fold <> o.fold GROUP BY ALL"""


@register("l2_fold_scalers", SQL_FOLD_SCALERS)
def q_fold_scalers(spark, sf_dir):
    """Scalers of five folds' training rows from one pass over the embeddings."""
    rows = sampling.kfold(B.embedding_rows(spark, sf_dir), SAMPLE, 5, 42)
    out = ml.fit_fold_scalers(rows)
    return r6(out.select("fold", F.posexplode(F.arrays_zip("means", "scales")).alias("place", "e"))
              .select("fold", "place", F.col("e.means").alias("mean"), F.col("e.scales").alias("scale")))


# ---------------------------------------------------------------------------- A7, M1 by narrowing
SQL_QUANTILES = "\nUNION ALL ".join(
    f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(l_extendedprice::DOUBLE, {q}), 6) AS price, "
    f"round(quantile_cont(l_quantity::DOUBLE, {q}), 6) AS quantity FROM lineitem" for q in (0.01, 0.25, 0.5, 0.999))


@register("a7_quantiles_lineitem", SQL_QUANTILES)
def q_quantiles(spark, sf_dir):
    """Exact quantiles of two columns over every line item."""
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    rows = []
    for q in (0.01, 0.25, 0.5, 0.999):
        got = order_stats.exact_quantiles(li, ["price", "quantity"], q)
        rows.append((q, got["price"], got["quantity"]))
    return r6(spark.createDataFrame(rows, "q double, price double, quantity double"))


SQL_SPLIT_REPEATED = f"""WITH r AS (SELECT l_orderkey, {sql_key('l_orderkey')} AS k FROM lineitem),
cut AS (SELECT k, l_orderkey FROM r ORDER BY k, l_orderkey LIMIT 1 OFFSET (SELECT CAST(ceil(0.3 * count(*)) AS BIGINT) - 1 FROM lineitem))
SELECT r.l_orderkey AS sample_id, CASE WHEN (r.k, r.l_orderkey) <= (cut.k, cut.l_orderkey) THEN 'test' ELSE 'train' END AS split,
       CAST(count(*) AS BIGINT) AS n FROM r, cut GROUP BY ALL"""


@register("m1_split_repeated_ids", SQL_SPLIT_REPEATED)
def q_split_repeated(spark, sf_dir):
    """A split of all line items by order: an order's rows are on one side, and every row is kept once."""
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(SAMPLE), "l_linenumber")
    return sampling.train_test_split(rows, SAMPLE, 0.3, 42).groupBy(SAMPLE, "split").agg(F.count("*").alias("n"))


SQL_ORDINAL_REPEATED = """SELECT l_suppkey AS sample_id, CAST(min(rk) AS BIGINT) AS first, CAST(max(rk) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS rk FROM lineitem) GROUP BY l_suppkey"""


@register("p12_ordinal_repeated_keys", SQL_ORDINAL_REPEATED)
def q_ordinal_repeated(spark, sf_dir):
    """Ordinals of all line items in supplier order: a key's rows get neighbouring ordinals, none is multiplied."""
    from ..operators.reshape import with_ordinal

    rows = with_ordinal(B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias(SAMPLE), "l_quantity"), SAMPLE)
    return rows.groupBy(SAMPLE).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))


# ---------------------------------------------------------------------------- P5 by rare grams
SQL_GRAMS = """SELECT c_custkey FROM customer WHERE EXISTS (
  SELECT 1 FROM (SELECT DISTINCT substr(s_name, 10) AS p FROM supplier
                 UNION SELECT DISTINCT substr(s_name, -2) FROM supplier WHERE s_nationkey = 7) WHERE contains(c_name, p))"""


@register("p5_contains_customers", SQL_GRAMS)
def q_grams(spark, sf_dir):
    """Customers whose name contains any supplier's number, or the last two digits (shorter than a gram)
    of a supplier of nation 7."""
    s = B.table(spark, sf_dir, "supplier")
    listed = s.select(F.substring("s_name", 10, 100).alias("p")).union(s.where("s_nationkey = 7").select(F.substring("s_name", -2, 2)))
    return filters.containing_any(B.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", listed, "p").select("c_custkey")


# ---------------------------------------------------------------------------- C5/C6 as baseline plus sparse cells
_SCALED = SQL_C6_CUSTOMERS.rsplit("SELECT sample_id, gene_id", 1)[0] + """, z AS (
SELECT sample_id, gene_id, CASE WHEN v = 0 THEN NULL ELSE (value - m) / v END AS value FROM sel JOIN st USING (gene_id))"""
SQL_C6_GENES = _SCALED + """
SELECT gene_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var FROM z GROUP BY gene_id"""
SQL_C6_SAMPLES = _SCALED + """
SELECT sample_id, CAST(count(value) AS BIGINT) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS greatest
FROM z GROUP BY sample_id"""


def _sparse_customers(spark, sf_dir):
    from .singlecell import single_cell_pipeline_sparse

    return single_cell_pipeline_sparse(B.customer_part_matrix(spark, sf_dir), n_top=1000)


@register("c6_scaled_gene_checks", SQL_C6_GENES)
def q_c6_genes(spark, sf_dir):
    """Mean and variance of every gene of the scaled customer × part matrix, without its dense rows."""
    return r6(_sparse_customers(spark, sf_dir).gene_stats().select("gene_id", "n", "mean", "var"))


@register("c6_scaled_sample_checks", SQL_C6_SAMPLES)
def q_c6_samples(spark, sf_dir):
    """Count, sum and extremes of every customer's scaled values, without the dense rows."""
    return r6(_sparse_customers(spark, sf_dir).sample_totals())


# ---------------------------------------------------------------------------- C1: samples that normalisation empties (Q12)
SQL_ZERO_FACTORS = _sql_uq_factors(B.sql_customer_part_ctes()) + """
SELECT sample_id FROM nf WHERE norm_factor = 0"""


@register("c1_zero_factor_samples", SQL_ZERO_FACTORS)
def q_zero_factors(spark, sf_dir):
    """Customers whose upper quartile over all parts is 0 though they bought some."""
    factors = transforms.upper_quartile_factors(B.customer_part_matrix(spark, sf_dir), 0.75, on_empty_sample="drop")
    return transforms.zero_factor_samples(factors)
