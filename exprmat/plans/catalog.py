"""Registered queries: one per operator of SURVEY §2, each with its DuckDB oracle.

Every query reads the driver tables at ``sf_dir`` (through ``bindings``) and runs
over all of their rows. Doubles are rounded to 6 decimals and counts cast to bigint
on both sides so that the engines' outputs compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import GENE, SAMPLE, VALUE
from ..operators import filters, stats, transforms
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = positive_zero_rounds(sql.strip())
        return fn
    return deco


def positive_zero_rounds(sql: str) -> str:
    """Write every ``round(...)`` of the oracle SQL as ``(round(...) + 0.0)``.

    DuckDB rounds a tiny negative number to -0.0 where Spark's ``round`` gives 0.0;
    adding 0.0 turns -0.0 into 0.0 and leaves every other value unchanged, so the
    two engines' rounded doubles are bit-identical.
    """
    import re

    starts = [m.start() for m in re.finditer(r"(?<![A-Za-z_])round\(", sql)]
    for st in reversed(starts):
        depth, i = 0, st + len("round")
        while i < len(sql):
            if sql[i] == "(":
                depth += 1
            elif sql[i] == ")":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        sql = sql[:st] + "(" + sql[st:i + 1] + " + 0.0)" + sql[i + 1:]
    return sql


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (output hygiene for the comparison)."""
    return df.select([F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                      else F.col(f.name) for f in df.schema.fields])


CTE = B.sql_matrix_ctes(False)
CTE_SPARSE = B.sql_matrix_ctes(True)

# ---------------------------------------------------------------------------- A1–A3
SQL_GENE_STATS = f"""WITH {CTE}
SELECT gene_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
       round(var_samp(value), 6) AS var
FROM dense GROUP BY gene_id"""


@register("a1_a3_gene_stats", SQL_GENE_STATS)
def q_gene_stats(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(stats.gene_stats(m))


# ---------------------------------------------------------------------------- A4–A5
SQL_SAMPLE_STATS = f"""WITH {CTE}
SELECT sample_id, round(sum(value), 6) AS total, round(quantile_cont(value, 0.75), 6) AS quantile
FROM dense GROUP BY sample_id"""


@register("a4_a5_sample_quantile", SQL_SAMPLE_STATS)
def q_sample_stats(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(stats.sample_stats(m, 0.75))


# ---------------------------------------------------------------------------- P6
SQL_P6 = f"""WITH {CTE_SPARSE}
SELECT gene_id FROM dense GROUP BY gene_id HAVING avg(value) > 0"""


@register("p6_drop_zero_genes", SQL_P6)
def q_drop_zero_genes(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir, sparse=True)
    return filters.drop_zero_genes(m).genes


# ---------------------------------------------------------------------------- A6 / C1
def _sql_uq_factors(cte: str) -> str:
    return f"""WITH {cte},
gm AS (SELECT gene_id FROM dense GROUP BY gene_id HAVING avg(value) > 0),
nf AS (SELECT sample_id, quantile_cont(value, 0.75) / sum(value) AS norm_factor
       FROM dense JOIN gm USING (gene_id) GROUP BY sample_id),
geo AS (SELECT exp(avg(ln(CASE WHEN norm_factor = 0 THEN 1 ELSE norm_factor END))) AS g FROM nf)"""


SQL_A6 = _sql_uq_factors(CTE_SPARSE) + """
SELECT sample_id, round(norm_factor, 6) AS norm_factor, round(norm_factor / g, 6) AS scaling_factor
FROM nf, geo"""


@register("a6_uq_factors", SQL_A6)
def q_uq_factors(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir, sparse=True)
    return r6(transforms.upper_quartile_factors(m, 0.75))


SQL_C1 = _sql_uq_factors(CTE) + """
SELECT c.sample_id, c.gene_id, round(c.value * nf.norm_factor / geo.g, 6) AS value
FROM cells c JOIN nf USING (sample_id), geo"""


@register("c1_upper_quartile", SQL_C1)
def q_upper_quartile(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(transforms.upper_quartile_normalize(m, 0.75).cells)


SQL_C1_SPARSE = _sql_uq_factors(CTE_SPARSE) + """
SELECT c.sample_id, c.gene_id, round(c.value * nf.norm_factor / geo.g, 6) AS value
FROM cells c JOIN nf USING (sample_id), geo"""


@register("c1_upper_quartile_sparse", SQL_C1_SPARSE)
def q_upper_quartile_sparse(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir, sparse=True)
    return r6(transforms.upper_quartile_normalize(m, 0.75).cells)


# ---------------------------------------------------------------------------- P7 / C2
def _sql_normalized(cte: str) -> str:
    return _sql_uq_factors(cte) + """,
norm AS (SELECT d.sample_id, d.gene_id, d.value * nf.norm_factor / geo.g AS value
         FROM dense d JOIN nf USING (sample_id), geo),
gs AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM norm GROUP BY gene_id),
th AS (SELECT quantile_cont(m, 0.25) AS qm, quantile_cont(v, 0.25) AS qv FROM gs),
keep AS (SELECT gene_id FROM gs, th WHERE m > qm AND v > qv)"""


SQL_P7 = _sql_normalized(CTE) + "\nSELECT gene_id FROM keep"


@register("p7_filter_low_signal", SQL_P7)
def q_filter_low_signal(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return filters.filter_low_signal(transforms.upper_quartile_normalize(m)).genes


SQL_C2 = _sql_normalized(CTE) + """
SELECT c.sample_id, c.gene_id, round(log2(c.value * nf.norm_factor / geo.g + 1), 6) AS value
FROM cells c JOIN keep USING (gene_id) JOIN nf USING (sample_id), geo"""


@register("c2_feature_preprocessing", SQL_C2)
def q_feature_preprocessing(spark, sf_dir):
    from .bulk import feature_preprocessing
    m = B.tpch_matrix(spark, sf_dir)
    return r6(feature_preprocessing(m).cells)


# ---------------------------------------------------------------------------- C3 / K / C4–C6
def _sql_lognorm(src: str) -> str:
    """log-normalised values of relation ``src`` (sample_id, gene_id, value) using dense gene sums."""
    return f"""SELECT x.sample_id, x.gene_id,
       ln(CASE WHEN x.value / (CASE WHEN gs.s = 0 THEN 1e-6 ELSE gs.s END) * 10000 = 0 THEN 1
               ELSE x.value / (CASE WHEN gs.s = 0 THEN 1e-6 ELSE gs.s END) * 10000 END) AS value
FROM {src} x JOIN (SELECT gene_id, sum(value) AS s FROM dense GROUP BY gene_id) gs USING (gene_id)"""


SQL_C3 = f"""WITH {CTE}
SELECT sample_id, gene_id, round(value, 6) AS value FROM ({_sql_lognorm('cells')})"""


@register("c3_log_normalize", SQL_C3)
def q_log_normalize(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(transforms.log_normalize(m).cells)


SQL_K2 = f"""WITH {CTE}
SELECT gene_id, round(var_samp(value), 6) AS var FROM dense GROUP BY gene_id
ORDER BY (count(*) * sum(value::HUGEINT * value::HUGEINT) - sum(value::HUGEINT) * sum(value::HUGEINT)) DESC, gene_id LIMIT 20"""


@register("k2_top_variance_genes", SQL_K2)
def q_top_variance(spark, sf_dir):
    from ..operators.selection import top_variance_genes
    return r6(top_variance_genes(B.tpch_matrix(spark, sf_dir), 20))


_SQL_HVG = f"""WITH {CTE},
ln AS ({_sql_lognorm('dense')}),
hv AS (SELECT gene_id, var_samp(value) AS var FROM ln GROUP BY gene_id ORDER BY var DESC, gene_id LIMIT 20)"""

SQL_C4 = _SQL_HVG + "\nSELECT gene_id, round(var, 6) AS var FROM hv"


@register("c4_highly_variable_genes", SQL_C4)
def q_hvg(spark, sf_dir):
    from ..operators.selection import highly_variable_genes
    _, top = highly_variable_genes(transforms.log_normalize(B.tpch_matrix(spark, sf_dir)), 20, with_stats=True)
    return r6(top.select("gene_id", "var"))


SQL_C5 = f"""WITH {CTE},
st AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM dense GROUP BY gene_id)
SELECT d.sample_id, d.gene_id, round(CASE WHEN v = 0 THEN NULL ELSE (d.value - m) / v END, 6) AS value
FROM dense d JOIN st USING (gene_id)"""


@register("c5_scale_by_variance", SQL_C5)
def q_scale(spark, sf_dir):
    return r6(transforms.scale_by_variance(B.tpch_matrix(spark, sf_dir)))


SQL_C6 = _SQL_HVG + """,
sel AS (SELECT ln.* FROM ln JOIN hv USING (gene_id)),
st AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM sel GROUP BY gene_id)
SELECT sample_id, gene_id, round(CASE WHEN v = 0 THEN NULL ELSE (value - m) / v END, 6) AS value
FROM sel JOIN st USING (gene_id)"""


@register("c6_single_cell_pipeline", SQL_C6)
def q_single_cell(spark, sf_dir):
    from .singlecell import single_cell_pipeline
    m = B.tpch_matrix(spark, sf_dir)
    return r6(single_cell_pipeline(m, n_top=20))


# ---------------------------------------------------------------------------- M1–M5, S7
def sql_key(col: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR) || '-{seed}'), 1, 8))::BIGINT"


SQL_M1 = f"""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk FROM embeddings)
SELECT vec_id AS sample_id, CASE WHEN rk < ceil(0.3 * (SELECT count(*) FROM embeddings)) THEN 'test' ELSE 'train' END AS split
FROM r"""


@register("m1_train_test_split", SQL_M1)
def q_split(spark, sf_dir):
    from ..operators.sampling import train_test_split
    rows = B.embedding_rows(spark, sf_dir).select(SAMPLE)
    return train_test_split(rows, SAMPLE, 0.3, 42)


SQL_M4 = f"""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk,
                  count(*) OVER () AS n FROM embeddings),
p AS (SELECT *, n // 10 + 1 AS big, n % 10 AS rem, n // 10 AS small FROM r)
SELECT vec_id AS sample_id,
       CAST(CASE WHEN rk < rem * big THEN rk // big ELSE rem + (rk - rem * big) // small END AS INTEGER) AS fold
FROM p"""


@register("m4_kfold", SQL_M4)
def q_kfold(spark, sf_dir):
    from ..operators.sampling import kfold
    rows = B.embedding_rows(spark, sf_dir).select(SAMPLE)
    return kfold(rows, SAMPLE, 10, 42)


SQL_M5 = f"""SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label,
  CAST((row_number() OVER (PARTITION BY CAST(label AS VARCHAR) ORDER BY {sql_key('vec_id')}, vec_id) - 1) % 10 AS INTEGER) AS fold
FROM embeddings"""


@register("m5_stratified_kfold", SQL_M5)
def q_strat_kfold(spark, sf_dir):
    from ..operators.sampling import kfold
    rows = B.embedding_rows(spark, sf_dir).select(SAMPLE, "label")
    return kfold(rows, SAMPLE, 10, 42, stratify="label")


SQL_M2 = f"""WITH l AS ({B.SQL_REGION_LABELS}),
c AS (SELECT label, count(*) AS n_class FROM l GROUP BY label),
b AS (SELECT label, n_class, floor(50 * n_class / (SELECT sum(n_class) FROM c)) AS b,
             50 * n_class / (SELECT sum(n_class) FROM c) - floor(50 * n_class / (SELECT sum(n_class) FROM c)) AS rem FROM c),
q AS (SELECT label, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                  <= 50 - (SELECT sum(b) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT l.*, row_number() OVER (PARTITION BY label ORDER BY {sql_key('sample_id')}, sample_id) - 1 AS rk FROM l)
SELECT sample_id, label FROM r JOIN q USING (label) WHERE rk < quota"""


@register("m2_stratified_sample", SQL_M2)
def q_strat_sample(spark, sf_dir):
    from ..operators.sampling import stratified_sample
    return stratified_sample(B.region_labels(spark, sf_dir), "label", 50, SAMPLE, 42)


SQL_M3 = f"""WITH {CTE},
s AS (SELECT sample_id FROM samples ORDER BY {sql_key('sample_id')}, sample_id LIMIT 40),
g AS (SELECT gene_id FROM genes ORDER BY {sql_key('gene_id')}, gene_id LIMIT 30)
SELECT c.sample_id, c.gene_id, round(c.value, 6) AS value FROM cells c JOIN s USING (sample_id) JOIN g USING (gene_id)"""


@register("m3_sample_matrix", SQL_M3)
def q_sample_matrix(spark, sf_dir):
    from ..operators.sampling import sample_matrix
    return r6(sample_matrix(B.tpch_matrix(spark, sf_dir), 40, 30, 42).cells)


SQL_S7 = f"""WITH r AS (SELECT s_suppkey AS sample_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS rk FROM supplier),
d AS (SELECT range AS draw, {sql_key('range')} % (SELECT count(*) FROM supplier) AS rk FROM range(200))
SELECT draw, sample_id FROM d JOIN r USING (rk)"""


@register("s7_sample_with_replacement", SQL_S7)
def q_with_replacement(spark, sf_dir):
    from ..operators.sampling import sample_with_replacement
    ids = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE))
    return sample_with_replacement(ids, SAMPLE, 200, 42)


# ---------------------------------------------------------------------------- P1, P4, P5
SQL_P1 = f"""WITH {CTE},
g AS (SELECT DISTINCT p_brand || '|' || p_type AS gene_id FROM part WHERE p_retailprice > 995)
SELECT sample_id, gene_id, round(value, 6) AS value FROM cells JOIN g USING (gene_id)"""


@register("p1_select_genes", SQL_P1)
def q_select_genes(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    g = B.table(spark, sf_dir, "part").filter("p_retailprice > 995").select(B.gene_col().alias(GENE)).distinct()
    return r6(filters.select_genes(m, g).cells)


SQL_P4 = f"""WITH {CTE}
SELECT sample_id, gene_id, round(value, 6) AS value FROM cells WHERE starts_with(gene_id, 'Brand#1')"""


@register("p4_keep_gene_prefix", SQL_P4)
def q_gene_prefix(spark, sf_dir):
    return r6(filters.keep_gene_prefix(B.tpch_matrix(spark, sf_dir), "Brand#1").cells)


SQL_P5 = f"""WITH {CTE},
lst AS (SELECT DISTINCT p_brand || '|' || p_type || '.' || CAST(p_size % 3 AS VARCHAR) AS l FROM part WHERE p_size > 45)
SELECT sample_id, gene_id, round(value, 6) AS value FROM cells
WHERE split_part(gene_id, '.', 1) IN (SELECT split_part(l, '.', 1) FROM lst)"""


def _versioned_gene_list(spark, sf_dir):
    """A coding-gene list with versioned ids (``id.version``) derived from part."""
    return (B.table(spark, sf_dir, "part").filter("p_size > 45")
            .select(F.concat(B.gene_col(), F.lit("."), (F.col("p_size") % 3).cast("string")).alias("l"))
            .distinct())


@register("p5_select_coding_genes", SQL_P5)
def q_coding_genes(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(filters.select_coding_genes(m, _versioned_gene_list(spark, sf_dir), "l").cells)


SQL_P5_CONTAINS = f"""WITH {CTE},
lst AS (SELECT DISTINCT p_brand || '|' AS l FROM part WHERE p_size = 7)
SELECT sample_id, gene_id, round(value, 6) AS value FROM cells
WHERE EXISTS (SELECT 1 FROM lst WHERE contains(cells.gene_id, lst.l))"""


@register("p5_select_genes_contains", SQL_P5_CONTAINS)
def q_coding_genes_contains(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    lst = B.table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat("p_brand", F.lit("|")).alias("l"))
    return r6(filters.select_coding_genes(m, lst, "l", mode="contains").cells)


# ---------------------------------------------------------------------------- P2, P3, J1, J2, J3, U1, U2
SQL_P2_P3 = """SELECT d.doc_id AS sample_id, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NOT NULL"""


@register("p2_p3_rename_dropna", SQL_P2_P3)
def q_rename_dropna(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id")
    lab = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id", "left").withColumnRenamed("doc_id", SAMPLE)
            .withColumnRenamed("quality", "label").dropna(subset=["label"]))


def _file_map(spark, sf_dir):
    """(doc_id, file_name): a per-document file name made from its source."""
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".counts.tsv")).alias("file_name"))


SQL_J1 = """SELECT l.doc_id, d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.counts.tsv' AS file_name
FROM (SELECT doc_id FROM labels UNION ALL SELECT -doc_id FROM labels) l
LEFT JOIN documents d USING (doc_id)"""


@register("j1_attach_filename", SQL_J1)
def q_attach_filename(spark, sf_dir):
    from ..operators.joins import attach_filename
    lab = B.table(spark, sf_dir, "labels").select("doc_id")
    ids = lab.unionByName(lab.select((-F.col("doc_id")).alias("doc_id")))   # every label id, and an unmatched twin
    return attach_filename(ids, _file_map(spark, sf_dir), "doc_id")


SQL_J2 = """SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""


@register("j2_match_samples", SQL_J2)
def q_match_samples(spark, sf_dir):
    from ..operators.joins import match_samples
    f, _ = match_samples(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"),
                         B.table(spark, sf_dir, "labels"), "doc_id")
    return f


SQL_J3 = f"""WITH {CTE}
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_stored, round(sum(value), 6) AS total, label
FROM cells JOIN ({B.SQL_REGION_LABELS}) USING (sample_id) GROUP BY sample_id, label"""


@register("j3_join_labels", SQL_J3)
def q_join_labels(spark, sf_dir):
    from ..operators.joins import join_labels
    m = B.tpch_matrix(spark, sf_dir)
    per = m.cells.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_stored"), F.sum(VALUE).alias("total"))
    return r6(join_labels(per, B.region_labels(spark, sf_dir)))


SQL_U1 = f"""WITH {CTE}, sparse AS ({B.sql_cells()})
SELECT sample_id, gene_id, round(value, 6) AS value FROM cells
UNION ALL SELECT sample_id, gene_id, round(value, 6) AS value FROM sparse"""


@register("u1_append_rows", SQL_U1)
def q_union(spark, sf_dir):
    """Bag union of two whole matrices' cells (all parts, and the parts of size ≤ 5)."""
    from ..operators.joins import append_rows
    full = B.tpch_matrix(spark, sf_dir).cells
    sparse = B.tpch_matrix(spark, sf_dir, sparse=True).cells
    return r6(append_rows(full, sparse))


SQL_U2 = """SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"""


@register("u2_common_ids", SQL_U2)
def q_intersect(spark, sf_dir):
    from ..operators.joins import common_ids
    return common_ids(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels"), "doc_id")


# ---------------------------------------------------------------------------- J4, J5
SQL_J4 = f"""WITH {CTE},
st AS (SELECT gene_id, avg(value) AS m FROM dense GROUP BY gene_id)
SELECT sample_id, gene_id, round(value - m, 6) AS value FROM cells JOIN st USING (gene_id)"""


@register("j4_gene_vector_join", SQL_J4)
def q_gene_vector(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    st = stats.gene_stats(m).select(GENE, "mean")
    return r6(m.cells.join(m.genes_bc(st), GENE).select(SAMPLE, GENE, (F.col(VALUE) - F.col("mean")).alias(VALUE)))


SQL_J5 = f"""WITH {CTE},
st AS (SELECT sample_id, sum(value) AS t FROM cells GROUP BY sample_id)
SELECT sample_id, gene_id, round(value / t, 6) AS value FROM cells JOIN st USING (sample_id)"""


@register("j5_sample_vector_join", SQL_J5)
def q_sample_vector(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    st = stats.sample_stats(m).select(SAMPLE, "total")
    return r6(m.cells.join(m.samples_bc(st), SAMPLE)
              .select(SAMPLE, GENE, F.try_divide(F.col(VALUE), F.col("total")).alias(VALUE)))


# ---------------------------------------------------------------------------- P10–P15, K1, K4, K5
SQL_P10 = f"""WITH {CTE}
SELECT sample_id, CAST(count(*) AS INTEGER) AS n_values,
       string_agg(CAST(value AS VARCHAR), ',' ORDER BY gene_id) AS values_csv
FROM dense GROUP BY sample_id"""


@register("p10_to_row_array", SQL_P10)
def q_row_array(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    rows, _ = m.to_row_array()
    return rows.select(SAMPLE, F.size("values").alias("n_values"),
                       F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values_csv"))


SQL_P11 = """SELECT vec_id AS sample_id, CAST(i - 1 AS INTEGER) AS gene_id, round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, range(1, 65) t(i)"""


@register("p11_to_long", SQL_P11)
def q_long(spark, sf_dir):
    from ..matrix import ExprMatrix
    rows = B.embedding_rows(spark, sf_dir)
    m = ExprMatrix.from_row_array(rows, SAMPLE, "values", drop_zeros=False)
    return r6(m.cells)


SQL_P12 = """SELECT s_suppkey AS sample_id, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS ordinal FROM supplier"""


@register("p12_ordinal_index", SQL_P12)
def q_ordinal(spark, sf_dir):
    from ..operators.reshape import with_ordinal
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE), "s_name")
    return with_ordinal(s, ["s_name", SAMPLE])


SQL_P13 = """SELECT page_id, regexp_extract(url, '[^/]*$') AS file_name, lower(split_part(url, ':', 1)) AS scheme FROM pages"""


@register("p13_derived_columns", SQL_P13)
def q_derived(spark, sf_dir):
    from ..functions.scalar import basename
    p = B.table(spark, sf_dir, "pages")
    return p.select("page_id", basename("url").alias("file_name"),
                    F.lower(F.split("url", ":").getItem(0)).alias("scheme"))


SQL_P15 = f"""WITH {CTE_SPARSE}
SELECT (SELECT count(*) FROM samples) AS n_samples, (SELECT count(*) FROM genes) AS n_genes,
       count(*) AS n_stored, count(*) - count(value) AS n_null, count(*) FILTER (WHERE value <> 0) AS n_nonzero,
       round(count(*) FILTER (WHERE value <> 0) / ((SELECT count(*) FROM samples) * (SELECT count(*) FROM genes)), 6) AS density
FROM cells"""


@register("p15_matrix_profile", SQL_P15)
def q_profile(spark, sf_dir):
    from ..operators.reshape import matrix_profile
    return r6(matrix_profile(B.tpch_matrix(spark, sf_dir, sparse=True)))


SQL_K1 = """SELECT s_suppkey AS sample_id, s_acctbal FROM supplier ORDER BY sample_id"""


@register("k1_sort_by_key", SQL_K1)
def q_sort(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE), "s_acctbal").orderBy(SAMPLE)


SQL_K4 = f"""WITH {CTE}
SELECT sample_id, round(sum(value), 6) AS total FROM cells GROUP BY sample_id ORDER BY sum(value) DESC, sample_id LIMIT 10"""


@register("k4_head", SQL_K4)
def q_head(spark, sf_dir):
    from ..operators.reshape import ordered_head
    per = B.tpch_matrix(spark, sf_dir).cells.groupBy(SAMPLE).agg(F.sum(VALUE).alias("total"))
    return r6(ordered_head(per, 10, [F.desc("total"), SAMPLE]))


SQL_K5 = """SELECT l_returnflag, l_linestatus, round(min(l_extendedprice), 6) AS value FROM lineitem
GROUP BY ALL ORDER BY l_returnflag DESC, l_linestatus DESC"""


@register("k5_reverse_order", SQL_K5)
def q_reverse(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    return r6(li.groupBy("l_returnflag", "l_linestatus").agg(F.min("l_extendedprice").alias("value"))
              .orderBy(F.desc("l_returnflag"), F.desc("l_linestatus")))


# ---------------------------------------------------------------------------- A8–A14, A17, A18
def _readout(spark, sf_dir):
    """(sample_id, label, prediction, fold): embeddings with a fixed linear readout as the
    "model" — the position of the largest of the first ten components — and its
    10-fold assignment, so every metric below has a deterministic SQL oracle."""
    from ..operators.sampling import kfold
    e = B.table(spark, sf_dir, "embeddings")
    head = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 10)
    rows = e.select(F.col("vec_id").alias(SAMPLE), F.col("label").cast("string").alias("label"),
                    (F.array_position(head, F.array_max(head)) - 1).cast("string").alias("prediction"))
    return kfold(rows, SAMPLE, 10, 42)


_SQL_READOUT = f"""r0 AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS label,
         CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS VARCHAR) AS prediction,
         row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk, count(*) OVER () AS n FROM embeddings),
ro AS (SELECT sample_id, label, prediction,
         CAST(CASE WHEN rk < (n % 10) * (n // 10 + 1) THEN rk // (n // 10 + 1)
              ELSE n % 10 + (rk - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS fold FROM r0)"""

SQL_A8 = f"""WITH {_SQL_READOUT}
SELECT count(*) AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ro"""


@register("a8_accuracy", SQL_A8)
def q_accuracy(spark, sf_dir):
    from ..operators.metrics import accuracy
    return r6(accuracy(_readout(spark, sf_dir)))


SQL_A9 = """WITH p AS (SELECT s_acctbal AS y, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS p FROM supplier)
SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (count(y) * var_pop(y)), 6) AS r2 FROM p"""


@register("a9_r2", SQL_A9)
def q_r2(spark, sf_dir):
    """R² of a nation-mean predictor of supplier account balance."""
    from ..matrix import counted_broadcast
    from ..operators.metrics import r2
    s = B.table(spark, sf_dir, "supplier")
    means, _ = counted_broadcast(s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("p")))
    p = s.join(means, "s_nationkey").select(F.col("s_acctbal").alias("y"), "p")
    return r6(r2(p, "y", "p"))


SQL_A10 = f"""WITH {_SQL_READOUT},
f AS (SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS score FROM ro GROUP BY fold)
SELECT count(*) AS n_folds, round(avg(score), 6) AS mean_cv, round(var_pop(score), 6) AS var_cv,
       round(stddev_pop(score), 6) AS std_cv FROM f"""


@register("a10_cv_summary", SQL_A10)
def q_cv_summary(spark, sf_dir):
    from ..operators.metrics import cv_summary
    ro = _readout(spark, sf_dir)
    scores = ro.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    return r6(cv_summary(scores))


SQL_A11 = f"""WITH {_SQL_READOUT},
cls AS (SELECT label AS c FROM ro UNION SELECT prediction FROM ro),
cnt AS (SELECT label, prediction, count(*) AS n FROM ro GROUP BY ALL)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c"""


@register("a11_confusion_matrix", SQL_A11)
def q_confusion(spark, sf_dir):
    from ..operators.metrics import confusion_matrix
    return confusion_matrix(_readout(spark, sf_dir))


SQL_A12 = f"""WITH {_SQL_READOUT},
cls AS (SELECT label AS cls FROM ro UNION SELECT prediction FROM ro),
s AS (SELECT cls,
        (SELECT count(*) FROM ro WHERE label = cls AND prediction = cls) AS tp,
        (SELECT count(*) FROM ro WHERE label = cls) AS support,
        (SELECT count(*) FROM ro WHERE prediction = cls) AS n_pred FROM cls),
m AS (SELECT cls, support, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS p,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r FROM s)
SELECT cls, round(p, 6) AS precision, round(r, 6) AS recall, CAST(support AS BIGINT) AS support,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m"""


@register("a12_class_report", SQL_A12)
def q_class_report(spark, sf_dir):
    from ..operators.metrics import class_report
    return r6(class_report(_readout(spark, sf_dir)))


SQL_A13 = f"""WITH {_SQL_READOUT} SELECT label AS cls FROM ro UNION SELECT prediction FROM ro"""


@register("a13_classes", SQL_A13)
def q_classes(spark, sf_dir):
    from ..operators.metrics import classes_of
    return classes_of(_readout(spark, sf_dir))


SQL_A14 = f"""SELECT label, count(*) AS n FROM ({B.SQL_REGION_LABELS}) GROUP BY label"""


@register("a14_class_counts", SQL_A14)
def q_class_counts(spark, sf_dir):
    from ..operators.metrics import class_counts
    return class_counts(B.region_labels(spark, sf_dir))


SQL_A17 = f"""WITH {CTE},
st AS (SELECT gene_id, avg(value) AS m FROM dense GROUP BY gene_id),
xy AS (SELECT CAST(row_number() OVER (ORDER BY gene_id) - 1 AS DOUBLE) AS x, m AS y FROM st)
SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(corr(x, y), 6) AS r,
       round(sqrt((1 - corr(x, y) * corr(x, y)) * var_pop(y) / (var_pop(x) * (count(*) - 2))), 6) AS stderr FROM xy"""


@register("a17_gene_trend", SQL_A17)
def q_gene_trend(spark, sf_dir):
    from ..operators.metrics import gene_trend
    return r6(gene_trend(B.tpch_matrix(spark, sf_dir)).drop("p_value"))


# Student's t with integer degrees of freedom nu has finite series; with theta = atan(t / sqrt(nu)):
# even nu: A = sin * sum_k prod(2i-1)/(2i) cos^2k; odd nu: A = 2/pi (theta + sin * sum_k prod(2i)/(2i+1) cos^(2k+1)).
SQL_A17_P = f"""WITH {CTE},
st AS (SELECT gene_id, log10(avg(value) + 1) AS m FROM dense GROUP BY gene_id),
xy AS (SELECT CAST(row_number() OVER (ORDER BY gene_id) - 1 AS DOUBLE) AS x, m AS y FROM st),
fit AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r,
               sqrt((1 - corr(x, y) * corr(x, y)) * var_pop(y) / (var_pop(x) * (count(*) - 2))) AS stderr FROM xy),
th AS (SELECT *, n - 2 AS nu, atan(abs(slope / stderr) / sqrt(n - 2)) AS theta FROM fit),
k AS (SELECT unnest(range(0, greatest(nu // 2, 1))) AS k, nu, theta FROM th),
c AS (SELECT k, nu, theta,
             exp(sum(CASE WHEN k = 0 THEN 0 WHEN nu % 2 = 0 THEN ln((2.0 * k - 1) / (2.0 * k)) ELSE ln((2.0 * k) / (2.0 * k + 1)) END)
                 OVER (ORDER BY k)) AS p FROM k),
a AS (SELECT sum(CASE WHEN nu % 2 = 0 THEN p * pow(cos(theta), 2 * k)
                      WHEN k <= (nu - 3) // 2 THEN p * pow(cos(theta), 2 * k + 1) ELSE 0 END) AS total FROM c)
SELECT n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r,
       round(1 - CASE WHEN nu % 2 = 0 THEN sin(theta) * total ELSE 2 / pi() * (theta + sin(theta) * total) END, 6) AS p_value,
       round(stderr, 6) AS stderr
FROM th, a"""


@register("a17_gene_trend_pvalue", SQL_A17_P)
def q_gene_trend_p(spark, sf_dir):
    """A17 on log10(mean + 1), with the p-value."""
    from ..operators.metrics import gene_trend
    return r6(gene_trend(B.tpch_matrix(spark, sf_dir), log10=True))


SQL_A18 = f"""WITH {CTE},
st AS (SELECT gene_id, avg(value) AS m FROM dense GROUP BY gene_id),
r AS (SELECT min(m) AS lo, max(m) AS hi FROM st),
b AS (SELECT CAST(least(floor(coalesce(CASE WHEN hi = lo THEN NULL ELSE (m - lo) / (hi - lo) END, 0) * 10), 9) AS INTEGER) AS bin
      FROM st, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(f.range AS INTEGER) AS bin, round(lo + f.range * (hi - lo) / 10, 6) AS lo,
       round(lo + (f.range + 1) * (hi - lo) / 10, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(10) f CROSS JOIN r LEFT JOIN c ON c.bin = f.range"""


@register("a18_gene_mean_histogram", SQL_A18)
def q_histogram(spark, sf_dir):
    from ..operators.metrics import gene_mean_histogram
    return r6(gene_mean_histogram(B.tpch_matrix(spark, sf_dir), 10))


# ---------------------------------------------------------------------------- A15, A16, S16, C12
def _results(spark, sf_dir):
    """Result rows from lineitem: dimension = return flag, framework = line status,
    one repeat per line, value = extended price, pos = its order in the file."""
    li = B.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("framework"),
                     F.col("l_extendedprice").alias("value"),
                     (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))


SQL_A15 = """SELECT l_returnflag AS dimension, l_linestatus AS framework, round(min(l_extendedprice), 6) AS value
FROM lineitem GROUP BY ALL"""


@register("a15_best_of_repeats", SQL_A15)
def q_best(spark, sf_dir):
    from ..operators.report import best_of_repeats
    return r6(best_of_repeats(_results(spark, sf_dir)))


SQL_A16 = """SELECT l_returnflag AS dimension,
  round(arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) FILTER (WHERE l_linestatus = 'F'), 6) AS F,
  round(arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) FILTER (WHERE l_linestatus = 'O'), 6) AS O
FROM lineitem GROUP BY l_returnflag"""


@register("a16_pivot_results", SQL_A16)
def q_pivot(spark, sf_dir):
    from ..operators.report import pivot_results
    return r6(pivot_results(_results(spark, sf_dir), ["F", "O"], order="pos"))


SQL_S16 = """SELECT dimension, framework, round(value, 6) AS value FROM (
  SELECT l_returnflag AS dimension, min(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS F,
         min(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1)
UNPIVOT (value FOR framework IN (F, O))"""


@register("s16_unpivot_results", SQL_S16)
def q_unpivot(spark, sf_dir):
    from ..operators.report import best_of_repeats, pivot_results, unpivot_results
    wide = pivot_results(best_of_repeats(_results(spark, sf_dir)), ["F", "O"])
    return r6(unpivot_results(wide, frameworks=["F", "O"]))


SQL_C12 = """SELECT l_returnflag AS dimension,
  round(min(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 6) AS F,
  round(min(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 6) AS O
FROM lineitem GROUP BY l_returnflag"""


@register("c12_benchmark_report", SQL_C12)
def q_report(spark, sf_dir):
    from ..operators.report import benchmark_report
    return r6(benchmark_report(_results(spark, sf_dir), ["F", "O"]))


# ---------------------------------------------------------------------------- F1–F10
SQL_F_NUMERIC = f"""WITH {CTE}
SELECT sample_id, gene_id,
  round(log2(value + 1), 6) AS f1_log2p1,
  round(ln(CASE WHEN abs(value - 25) = 0 THEN 1 ELSE abs(value - 25) END), 6) AS f2_ln_zero_as_one,
  round(log10(value + 1), 6) AS f3_log10p1,
  round(exp(ln(value) / 4), 6) AS f4_exp_ln,
  round(value * 10000, 6) AS f5_scaled,
  round(value / CASE WHEN value - 25 = 0 THEN 1e-6 ELSE value - 25 END, 6) AS f6_guarded
FROM cells"""


@register("f1_f6_numeric_functions", SQL_F_NUMERIC)
def q_numeric_functions(spark, sf_dir):
    from ..functions import scalar as fx
    c = B.tpch_matrix(spark, sf_dir).cells
    v = F.col(VALUE)
    return r6(c.select(SAMPLE, GENE, fx.log2p1(v).alias("f1_log2p1"),
                       fx.ln_zero_as_one(F.abs(v - 25)).alias("f2_ln_zero_as_one"),
                       fx.log10p1(v).alias("f3_log10p1"), F.exp(F.ln(v) / 4).alias("f4_exp_ln"),
                       (v * 1e4).alias("f5_scaled"), fx.guarded_div(v, v - 25).alias("f6_guarded")))


SQL_F_TEXT = """SELECT event_id,
  starts_with(event_type, 'c') AS f7_startswith, contains(props, '9') AS f7_contains,
  upper(event_type) || '_' || lower(trim('  ' || event_type || '  ')) AS f7_case_trim,
  split_part(props, ':', 1) AS f7_split,
  CAST(json_extract('[' || props || ']', '$[0].k') AS INTEGER) AS f8_json_first_k,
  TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || CAST(value AS VARCHAR) ELSE CAST(round(value, 2) AS VARCHAR) END AS DOUBLE) AS f9_to_double,
  (CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END) IS NULL AS f10_isnull
FROM events"""


@register("f7_f10_text_functions", SQL_F_TEXT)
def q_text_functions(spark, sf_dir):
    from ..functions import scalar as fx
    e = B.table(spark, sf_dir, "events")
    arr = F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:int>>")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))) \
        .otherwise(F.round("value", 2).cast("string"))
    return e.select("event_id",
                    F.col("event_type").startswith("c").alias("f7_startswith"),
                    F.col("props").contains("9").alias("f7_contains"),
                    F.concat(F.upper("event_type"), F.lit("_"),
                             F.lower(F.trim(F.concat(F.lit("  "), "event_type", F.lit("  "))))).alias("f7_case_trim"),
                    F.split("props", ":").getItem(0).alias("f7_split"),
                    F.get(arr, 0)["k"].alias("f8_json_first_k"),
                    fx.to_double(text).alias("f9_to_double"),
                    F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("value")).isNull().alias("f10_isnull"))


# ---------------------------------------------------------------------------- L1, L2, C7
SQL_L1 = f"""WITH l AS ({B.SQL_REGION_LABELS}),
r AS (SELECT *, row_number() OVER (ORDER BY {sql_key('sample_id')}, sample_id) - 1 AS rk FROM l),
s AS (SELECT *, CASE WHEN rk < ceil(0.3 * (SELECT count(*) FROM l)) THEN 'test' ELSE 'train' END AS split FROM r),
cls AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_idx
        FROM (SELECT DISTINCT label FROM s WHERE split = 'train'))
SELECT sample_id, split, label, label_idx FROM s JOIN cls USING (label)"""


@register("l1_label_encoding", SQL_L1)
def q_label_encoding(spark, sf_dir):
    from ..operators.ml import fit_label_encoder
    from ..operators.sampling import train_test_split
    s = train_test_split(B.region_labels(spark, sf_dir), SAMPLE, 0.3, 42)
    enc = fit_label_encoder(s.filter(F.col("split") == "train"))
    return enc.transform(s).select(SAMPLE, "split", "label", "label_idx")


_SQL_EMB_SPLIT = f"""r AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding,
        row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk FROM embeddings),
s AS (SELECT *, CASE WHEN rk < ceil(0.3 * (SELECT count(*) FROM embeddings)) THEN 'test' ELSE 'train' END AS split FROM r),
l AS (SELECT s.vec_id, s.split, s.label, i - 1 AS gene_idx, CAST(s.embedding[i] AS DOUBLE) AS x FROM s, range(1, 65) t(i)),
st AS (SELECT gene_idx, avg(x) AS m, stddev_pop(x) AS sd FROM l WHERE split = 'train' GROUP BY gene_idx)"""

SQL_C7 = f"""WITH {_SQL_EMB_SPLIT},
cls AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_idx
        FROM (SELECT DISTINCT label FROM s WHERE split = 'train'))
SELECT vec_id AS sample_id, split, label_idx, CAST(gene_idx AS INTEGER) AS gene_idx,
       round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value
FROM l JOIN st USING (gene_idx) JOIN cls USING (label)"""


def _prepared_embeddings(spark, sf_dir):
    from ..operators.ml import pre_ml
    rows = B.embedding_rows(spark, sf_dir)
    return pre_ml(rows.select(SAMPLE, "values"), rows.select(SAMPLE, "label"), "classification")


@register("c7_pre_ml", SQL_C7)
def q_pre_ml(spark, sf_dir):
    p = _prepared_embeddings(spark, sf_dir)
    return r6(p.select(SAMPLE, "split", "label_idx", F.posexplode("values").alias("gene_idx", VALUE)))


SQL_L2 = f"""WITH {CTE},
r AS (SELECT sample_id, row_number() OVER (ORDER BY {sql_key('sample_id')}, sample_id) - 1 AS rk FROM samples),
s AS (SELECT sample_id, CASE WHEN rk < ceil(0.3 * (SELECT count(*) FROM samples)) THEN 'test' ELSE 'train' END AS split FROM r),
g AS (SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS gene_idx FROM genes),
l AS (SELECT d.sample_id, s.split, g.gene_idx, d.value AS x FROM dense d JOIN s USING (sample_id) JOIN g USING (gene_id)),
st AS (SELECT gene_idx, avg(x) AS m, stddev_pop(x) AS sd FROM l WHERE split = 'train' GROUP BY gene_idx)
SELECT sample_id, split, gene_idx, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value
FROM l JOIN st USING (gene_idx)"""


@register("l2_standard_scale", SQL_L2)
def q_standard_scale(spark, sf_dir):
    from ..operators.ml import apply_standard_scaler, fit_standard_scaler
    from ..operators.sampling import train_test_split
    rows, _ = B.tpch_matrix(spark, sf_dir).to_row_array()
    s = train_test_split(rows, SAMPLE, 0.3, 42)
    out = apply_standard_scaler(s, fit_standard_scaler(s.filter(F.col("split") == "train")))
    return r6(out.select(SAMPLE, "split", F.posexplode("values").alias("gene_idx", VALUE)))


# ---------------------------------------------------------------------------- L3–L10, C8 (no SQL oracle)
@register("l3_gbt_classifier")
def q_gbt_classifier(spark, sf_dir):
    """One-vs-rest boosted trees on embeddings; test-split predictions."""
    from ..operators.ml import fit_and_score, make_estimator
    p = _prepared_embeddings(spark, sf_dir)
    _, pred, _ = fit_and_score(p, make_estimator("classification", "gbt", 42, maxIter=5, maxDepth=3))
    return pred.select(SAMPLE, "label_idx", "prediction")


@register("l4_gbt_regressor")
def q_gbt_regressor(spark, sf_dir):
    """Boosted-tree regression of supplier account balance on preprocessed expression."""
    from ..operators.ml import fit_and_score, make_estimator, pre_ml
    from .bulk import feature_preprocessing
    rows, _ = feature_preprocessing(B.tpch_matrix(spark, sf_dir)).to_row_array()
    p = pre_ml(rows, B.acctbal_target(spark, sf_dir), "regression", "target")
    _, pred, _ = fit_and_score(p, make_estimator("regression", "gbt", 42, maxIter=10, maxDepth=3), "regression")
    return pred.select(SAMPLE, "label_idx", "prediction")


@register("l5_l6_rf_classifier_predict")
def q_rf_classifier(spark, sf_dir):
    """Random-forest classifier (the fast tree option) fit on train, predictions on test."""
    from ..operators.ml import fit_and_score, make_estimator
    p = _prepared_embeddings(spark, sf_dir)
    _, pred, _ = fit_and_score(p, make_estimator("classification", "rf", 42, numTrees=20, maxDepth=6))
    return pred.select(SAMPLE, "label_idx", "prediction")


@register("l7_cross_validate")
def q_cross_validate(spark, sf_dir):
    from ..operators.ml import cross_validate, make_estimator
    p = _prepared_embeddings(spark, sf_dir).filter(F.col("split") == "train")
    return cross_validate(p, make_estimator("classification", "rf", 42, numTrees=20, maxDepth=6), k=10)


@register("l8_grid_search")
def q_grid_search(spark, sf_dir):
    from ..operators.ml import grid_search, make_estimator
    p = _prepared_embeddings(spark, sf_dir).filter(F.col("split") == "train")
    _, table = grid_search(p, make_estimator("classification", "rf", 42),
                           {"numTrees": [10, 20], "maxDepth": [3, 6]}, folds=2)
    return table


@register("l9_nested_cv")
def q_nested_cv(spark, sf_dir):
    from ..operators.ml import make_estimator, nested_cv
    p = _prepared_embeddings(spark, sf_dir).filter(F.col("split") == "train")
    return nested_cv(p, make_estimator("classification", "rf", 42), {"numTrees": [10, 20]}, outer=5, inner=2)


@register("c8_bulk_pipeline")
def q_bulk_pipeline(spark, sf_dir):
    """C2 → C7 → 10-fold CV + test score, classifying suppliers by region."""
    from .bulk import bulk_pipeline
    return bulk_pipeline(B.tpch_matrix(spark, sf_dir), B.region_labels(spark, sf_dir), "classification",
                         numTrees=20, maxDepth=5)


# ---------------------------------------------------------------------------- L3–L9, C8 with an oracle
# One discrete feature decides the label, so every learner must predict the truth and every
# score is 1; splits, folds and sizes come from SQL.
def _decided(spark, sf_dir, task="classification"):
    from ..operators.ml import pre_ml
    v = B.embedding_rows(spark, sf_dir)
    kind = (F.col(SAMPLE) % 3).cast("double")
    rows = v.select(SAMPLE, F.concat(F.array(kind), F.slice("values", 1, 7)).alias("values"))
    label = F.concat(F.lit("class"), kind.cast("int")) if task == "classification" else kind * 10
    return pre_ml(rows, v.select(SAMPLE, label.alias("label")), task)


_SQL_SPLIT = f"""r AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_key('vec_id')}, vec_id) - 1 AS rk FROM embeddings),
train AS (SELECT vec_id, row_number() OVER (ORDER BY rk) - 1 AS rk, count(*) OVER () AS n FROM r
          WHERE rk >= ceil(0.3 * (SELECT count(*) FROM embeddings)))"""
SQL_DECIDED = f"""WITH {_SQL_SPLIT}
SELECT vec_id AS sample_id, CAST(vec_id % 3 AS DOUBLE) AS label_idx, CAST(vec_id % 3 AS DOUBLE) AS prediction
FROM r WHERE rk < ceil(0.3 * (SELECT count(*) FROM embeddings))"""
SQL_DECIDED_10 = SQL_DECIDED.replace("CAST(vec_id % 3 AS DOUBLE)", "CAST(vec_id % 3 * 10 AS DOUBLE)")


def _decided_predictions(spark, sf_dir, task, kind, **params):
    from ..operators.ml import fit_and_score, make_estimator
    est = make_estimator(task, kind, 42, featureSubsetStrategy="all", maxDepth=3, **params)
    _, pred, _ = fit_and_score(_decided(spark, sf_dir, task), est, task)
    return r6(pred.select(SAMPLE, "label_idx", "prediction"))


@register("l3_gbt_classifier_decided", SQL_DECIDED)
def q_gbt_decided(spark, sf_dir):
    return _decided_predictions(spark, sf_dir, "classification", "gbt", maxIter=2)


@register("l4_gbt_regressor_decided", SQL_DECIDED_10)
def q_gbt_regressor_decided(spark, sf_dir):
    return _decided_predictions(spark, sf_dir, "regression", "gbt", maxIter=2)


@register("l5_l6_rf_decided", SQL_DECIDED)
def q_rf_decided(spark, sf_dir):
    return _decided_predictions(spark, sf_dir, "classification", "rf", numTrees=5)


def _sql_folds(k: int) -> str:
    return f"""p AS (SELECT *, n // {k} + 1 AS big, n % {k} AS rem, n // {k} AS small FROM train),
f AS (SELECT CAST(CASE WHEN rk < rem * big THEN rk // big ELSE rem + (rk - rem * big) // small END AS INTEGER) AS fold, n FROM p)"""


SQL_L7 = f"""WITH {_SQL_SPLIT}, {_sql_folds(4)}
SELECT fold, any_value(n) - count(*) AS n_train, count(*) AS n_test, CAST(1 AS DOUBLE) AS score FROM f GROUP BY fold"""


@register("l7_cross_validate_decided", SQL_L7)
def q_cv_decided(spark, sf_dir):
    from ..operators.ml import cross_validate, make_estimator
    p = _decided(spark, sf_dir).filter(F.col("split") == "train")
    return r6(cross_validate(p, make_estimator("classification", "rf", 42, numTrees=5, maxDepth=3, featureSubsetStrategy="all"), k=4))


SQL_L8 = """SELECT '{"maxDepth": ' || d || ', "numTrees": ' || t || '}' AS params, CAST(1 AS DOUBLE) AS avg_metric
FROM (VALUES (3), (4)) a(d), (VALUES (3), (5)) b(t)"""


@register("l8_grid_search_decided", SQL_L8)
def q_grid_decided(spark, sf_dir):
    from ..operators.ml import grid_search, make_estimator
    p = _decided(spark, sf_dir).filter(F.col("split") == "train")
    _, table = grid_search(p, make_estimator("classification", "rf", 42, featureSubsetStrategy="all"),
                           {"numTrees": [3, 5], "maxDepth": [3, 4]}, folds=2, metric="f1")
    return r6(table)


SQL_L9 = f"""WITH {_SQL_SPLIT}, {_sql_folds(3)}
SELECT fold, count(*) AS n_test, CAST(1 AS DOUBLE) AS score, '{{"numTrees": 3}}' AS best_params FROM f GROUP BY fold"""


@register("l9_nested_cv_decided", SQL_L9)
def q_nested_decided(spark, sf_dir):
    from ..operators.ml import make_estimator, nested_cv
    p = _decided(spark, sf_dir).filter(F.col("split") == "train")
    return r6(nested_cv(p, make_estimator("classification", "rf", 42, maxDepth=3, featureSubsetStrategy="all"), {"numTrees": [3, 5]}, outer=3, inner=2))


def _sql_c8(task: str, folds: int) -> str:
    return f"""SELECT '{task}' AS task, count(*) - CAST(ceil(0.3 * count(*)) AS BIGINT) AS n_train,
       CAST(ceil(0.3 * count(*)) AS BIGINT) AS n_test, CAST({folds} AS BIGINT) AS n_folds, true AS bounded FROM supplier"""


def _c8(spark, sf_dir, labels, task, label, **params):
    """Sizes of the bulk pipeline's split and folds, and whether its scores are at most 1."""
    from .bulk import bulk_pipeline
    out = bulk_pipeline(B.tpch_matrix(spark, sf_dir), labels, task, label, **params)
    return out.select("task", "n_train", "n_test", F.col("n_folds").cast("bigint").alias("n_folds"),
                      ((F.col("mean_cv") <= 1) & (F.col("eval_score") <= 1) & (F.col("var_cv") >= 0)).alias("bounded"))


@register("c8_bulk_pipeline_gbt", _sql_c8("classification", 3))
def q_c8_gbt(spark, sf_dir):
    return _c8(spark, sf_dir, B.region_labels(spark, sf_dir), "classification", "label", kind="gbt", k=3, maxIter=2, maxDepth=2)


@register("c8_bulk_pipeline_regression", _sql_c8("regression", 3))
def q_c8_regression(spark, sf_dir):
    return _c8(spark, sf_dir, B.acctbal_target(spark, sf_dir), "regression", "target", kind="gbt", k=3, maxIter=2, maxDepth=3)


@register("c8_bulk_pipeline_grid", _sql_c8("classification", 5))
def q_c8_grid(spark, sf_dir):
    return _c8(spark, sf_dir, B.region_labels(spark, sf_dir), "classification", "label", grid={"numTrees": [3, 5]}, maxDepth=3)


# ---------------------------------------------------------------------------- S1–S15 round trips, C9–C11
# Each query writes a table derived from the driver tables under the shared checkpoint
# folder (spark.checkpoint.dir) and reads it back with the reader under test.
SQL_CELLS_STR = f"""WITH {CTE}
SELECT CAST(sample_id AS VARCHAR) AS sample_id, gene_id, round(value, 6) AS value FROM cells"""


def _scratch(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, name)


@register("s1_s9_csv_roundtrip", SQL_CELLS_STR)
def q_csv_roundtrip(spark, sf_dir):
    from ..sources.matrix_io import read_matrix, write_matrix
    m = B.tpch_matrix(spark, sf_dir)
    rows, idx = m.to_row_array()
    names = [r[GENE] for r in idx.orderBy("gene_idx").collect()]
    path = _scratch(spark, "csv")
    write_matrix(rows, path, "csv", gene_names=names)
    back = read_matrix(spark, path, fmt="csv", id_col=SAMPLE)
    return r6(back.cells)


@register("s2_s11_parquet_roundtrip", SQL_CELLS_STR)
def q_parquet_roundtrip(spark, sf_dir):
    from ..sources.matrix_io import detect_format, read_matrix, write_matrix
    m = B.tpch_matrix(spark, sf_dir)
    path = _scratch(spark, "long") + ".parquet"
    write_matrix(m.cells.withColumn(SAMPLE, F.col(SAMPLE).cast("string")), path, "parquet")
    assert detect_format(path) == "parquet"
    return r6(read_matrix(spark, path).cells)


SQL_WIDE = f"""WITH {CTE}
SELECT CAST(sample_id AS VARCHAR) AS sample_id, translate(gene_id, ' ', '_') AS gene_id, round(value, 6) AS value FROM cells"""


@register("s2_wide_parquet_import", SQL_WIDE)
def q_wide_import(spark, sf_dir):
    """A wide file (one column per gene, written by pivot) imported with the pyarrow
    row-group reader (the path used above the array(*cols) width limit)."""
    from ..matrix import ExprMatrix
    from ..sources.matrix_io import read_wide_parquet
    m = B.tpch_matrix(spark, sf_dir)
    names = sorted(r[GENE] for r in m.genes.collect())
    wide = (m.cells.withColumn(GENE, F.translate(GENE, " ", "_"))
            .groupBy(SAMPLE).pivot(GENE, [n.replace(" ", "_") for n in names]).agg(F.first(VALUE)).fillna(0.0))
    path = _scratch(spark, "wide")
    wide.write.mode("overwrite").parquet(path)
    rows, genes = read_wide_parquet(spark, path, id_col=SAMPLE, max_array_columns=100)
    return r6(ExprMatrix.from_row_array(rows, SAMPLE, "values", gene_ids=genes, drop_zeros=True).cells)


SQL_S4 = f"""SELECT CAST(sample_id AS VARCHAR) AS sample_id, label FROM ({B.SQL_REGION_LABELS}) l
JOIN supplier ON s_suppkey = sample_id WHERE s_nationkey % 5 <> 0"""


@register("s4_read_labels_tsv", SQL_S4)
def q_labels_tsv(spark, sf_dir):
    from ..sources.files import NA_MARKER, read_labels
    lab = B.region_labels(spark, sf_dir).join(B.table(spark, sf_dir, "supplier"), F.col(SAMPLE) == F.col("s_suppkey"))
    lab = lab.select(F.col(SAMPLE).alias("case_id"),
                     F.when(F.col("s_nationkey") % 5 == 0, F.lit(NA_MARKER)).otherwise(F.col("label")).alias("subtype"),
                     F.lit("x").alias("other"))
    path = _scratch(spark, "labels")
    lab.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    back = read_labels(spark, path, ["case_id", "subtype"], rename={"case_id": SAMPLE, "subtype": "label"})
    return back.dropna(subset=["label"])


SQL_S5 = """SELECT 'U' || CAST(user_id AS VARCHAR) AS id,
       arg_max(event_type || '-' || CAST(event_id AS VARCHAR) || '.counts.tsv', event_id) AS file_name
FROM events GROUP BY user_id"""


@register("s5_read_file_map", SQL_S5)
def q_file_map(spark, sf_dir):
    from ..sources.files import read_file_map
    ev = B.table(spark, sf_dir, "events")
    recs = ev.select(F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(".counts.tsv")).alias("file_name"),
                     F.array(F.struct(F.concat(F.lit("TCGA-"), F.col("user_id").cast("string")).alias("entity_submitter_id"),
                                      F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("case_id"))
                             ).alias("associated_entities"),
                     "event_id")
    path = _scratch(spark, "cart")
    recs.write.mode("overwrite").json(path)
    return read_file_map(spark, path, "case_id", multiline=False, order_field="event_id")


FOLDERS_PER_TASK = 250


def _write_sample_tree(spark, sf_dir, path):
    """Per-sample TSV files (gene id, value) in one folder per supplier, each with a
    non-gene footer row, as the per-sample expression files of the reference. Tasks write
    their samples' files one after the other: the tree is many files of few bytes."""
    m = B.tpch_matrix(spark, sf_dir)
    c = m.cells
    footer = c.select(SAMPLE).distinct().select(SAMPLE, F.lit("__no_feature").alias(GENE), F.lit(1.0).alias(VALUE))
    # the cost is in the files: a number of tasks by folders, which is not coalesced by bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-m.n_samples // FOLDERS_PER_TASK))
    line = F.to_csv(F.struct(GENE, VALUE), {"sep": "\t"})
    rows = c.unionByName(footer).repartition(tasks, SAMPLE).sortWithinPartitions(SAMPLE)

    def write(batches):
        import itertools
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        lines = ((k, x) for b in batches for k, x in zip(b.column("k").to_pylist(), b.column("line").to_pylist(), strict=True))
        for key, of in itertools.groupby(lines, lambda r: r[0]):
            folder, own = f"{root}/{SAMPLE}={key}", uuid.uuid4().hex
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/_{own}") as out:
                for _, x in of:
                    out.write(f"{x}\n".encode())
            # one name per sample: a repeated task puts the same rows in the same place
            fs.move(f"{folder}/_{own}", f"{folder}/part-0.csv")
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    rows.select(F.col(SAMPLE).cast("string").alias("k"), line.alias("line")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


SQL_S6 = f"""WITH {CTE}
SELECT 'sample_id=' || CAST(sample_id AS VARCHAR) AS sample_id, gene_id, round(value, 6) AS value FROM cells"""


@register("s6_read_sample_files", SQL_S6)
def q_sample_files(spark, sf_dir):
    from ..sources.files import read_sample_files
    path = _scratch(spark, "tree")
    _write_sample_tree(spark, sf_dir, path)
    m = read_sample_files(spark, path, name_glob="part-*", gene_prefix="Brand#", key="folder")
    return r6(m.cells)


SQL_S8 = """SELECT DISTINCT p_brand || '|' || p_type || '.' || CAST(p_size % 3 AS VARCHAR) AS gene_id FROM part WHERE p_size > 45"""


@register("s8_read_gene_list", SQL_S8)
def q_gene_list(spark, sf_dir):
    from ..sources.files import read_gene_list
    path = _scratch(spark, "genes")
    _versioned_gene_list(spark, sf_dir).withColumnRenamed("l", "gene_id").write.mode("overwrite") \
        .option("header", True).csv(path)
    return read_gene_list(spark, path)


@register("s10_append_rows", SQL_CELLS_STR)
def q_append(spark, sf_dir):
    from ..sources.matrix_io import read_matrix, write_matrix
    c = B.tpch_matrix(spark, sf_dir).cells.withColumn(SAMPLE, F.col(SAMPLE).cast("string"))
    path = _scratch(spark, "append") + ".parquet"
    write_matrix(c.filter(F.col(GENE) < "Brand#2"), path, "parquet", mode="overwrite")
    write_matrix(c.filter(F.col(GENE) >= "Brand#2"), path, "parquet", mode="append")
    return r6(read_matrix(spark, path).cells)


SQL_CELLS = f"""WITH {CTE} SELECT sample_id, gene_id, round(value, 6) AS value FROM cells"""


@register("s12_repartition_by_size", SQL_CELLS)
def q_by_size(spark, sf_dir):
    from ..sources.matrix_io import repartition_by_size
    c = B.tpch_matrix(spark, sf_dir).cells
    return r6(repartition_by_size(c, 64 * 1024))


@register("s13_copartition", SQL_J3)
def q_copartition(spark, sf_dir):
    from ..sources.matrix_io import copartition
    m = B.tpch_matrix(spark, sf_dir)
    per = m.cells.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_stored"), F.sum(VALUE).alias("total"))
    a, b = copartition(per, B.region_labels(spark, sf_dir), SAMPLE)
    return r6(a.join(b, SAMPLE))


SQL_S14 = f"""WITH {CTE},
si AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i FROM samples),
gi AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS j FROM genes)
SELECT i AS sample_id, j AS gene_id, round(value, 6) AS value FROM cells JOIN si USING (sample_id) JOIN gi USING (gene_id)"""


@register("s14_read_coo", SQL_S14)
def q_coo(spark, sf_dir):
    """Matrix Market coordinate files: every part file starts with the size line."""
    from ..operators.reshape import with_ordinal
    from ..sources.matrix_io import read_coo
    m = B.tpch_matrix(spark, sf_dir)
    si = with_ordinal(m.samples, SAMPLE, "i")
    gi = with_ordinal(m.genes, GENE, "j")
    trip = m.cells.join(si, SAMPLE).join(gi, GENE)
    nnz = trip.count()
    dims = [str(m.n_samples), str(m.n_genes), str(nnz)]
    seen = set()
    for k, d in enumerate(dims):       # distinct header names: pad repeats with spaces
        while d in seen:
            d += " "
        seen.add(d)
        dims[k] = d
    path = _scratch(spark, "mtx")
    (trip.select((F.col("i") + 1).cast("string").alias(dims[0]), (F.col("j") + 1).cast("string").alias(dims[1]),
                 F.col(VALUE).cast("string").alias(dims[2]))
     .write.mode("overwrite").option("header", True).option("sep", " ").csv(path))
    return r6(read_coo(spark, path).cells)


SQL_S15 = SQL_A15


@register("s15_read_results", SQL_S15)
def q_read_results(spark, sf_dir):
    from ..operators.report import best_of_repeats
    from ..sources.files import read_results, write_results
    path = _scratch(spark, "results")
    write_results(best_of_repeats(_results(spark, sf_dir)), path)
    return r6(read_results(spark, path))


SQL_C9 = f"""WITH {CTE},
lst AS (SELECT DISTINCT split_part(p_brand || '|' || p_type || '.' || CAST(p_size % 3 AS VARCHAR), '.', 1) AS g
        FROM part WHERE p_size > 45),
lab AS (SELECT l.sample_id, l.label FROM ({B.SQL_REGION_LABELS}) l JOIN supplier ON s_suppkey = l.sample_id
        WHERE s_nationkey % 7 <> 0 AND l.sample_id % 9 <> 0)
SELECT 'sample_id=' || CAST(c.sample_id AS VARCHAR) AS sample_id, c.gene_id, round(c.value, 6) AS value, lab.label
FROM cells c JOIN lab USING (sample_id) WHERE c.gene_id IN (SELECT g FROM lst)"""


@register("c9_prepare_bulk_dataset", SQL_C9)
def q_prepare(spark, sf_dir):
    """Per-sample files + metadata JSON (with a superseded duplicate) + label TSV (with NA
    markers and unlabeled cases) + versioned gene list → matched, coding-gene matrix."""
    from ..sources.files import NA_MARKER, read_file_map, read_labels, read_sample_files
    from .prep import prepare_bulk_dataset
    base = _scratch(spark, "prep")
    _write_sample_tree(spark, sf_dir, base + "/samples")
    sup = B.table(spark, sf_dir, "supplier")
    case = F.concat(F.lit("C"), F.col("s_suppkey").cast("string"))
    good = sup.select(F.col("s_suppkey"), F.concat(F.lit("sample_id="), F.col("s_suppkey").cast("string")).alias("file_name"),
                      F.lit(1).cast("long").alias("pos"), case.alias("case_id"))
    stale = good.filter(F.col("s_suppkey") % 10 == 0).select(
        "s_suppkey", F.lit("sample_id=-1").alias("file_name"), F.lit(0).cast("long").alias("pos"), "case_id")
    cart = good.unionByName(stale).select(
        "file_name", F.array(F.struct(F.lit(None).cast("string").alias("entity_submitter_id"),
                                      F.col("case_id"))).alias("associated_entities"), "pos")
    cart.write.mode("overwrite").json(base + "/cart")
    lab = (B.region_labels(spark, sf_dir).join(sup, F.col(SAMPLE) == F.col("s_suppkey"))
           .filter(F.col(SAMPLE) % 9 != 0)
           .select(F.concat(F.lit("C"), F.col(SAMPLE).cast("string")).alias("case_id"),
                   F.when(F.col("s_nationkey") % 7 == 0, F.lit(NA_MARKER)).otherwise(F.col("label")).alias("subtype")))
    lab.write.mode("overwrite").option("header", True).option("sep", "\t").csv(base + "/labels")
    features = read_sample_files(spark, base + "/samples", name_glob="part-*", gene_prefix="Brand#", key="folder")
    fmap = read_file_map(spark, base + "/cart", "case_id", multiline=False, order_field="pos")
    labels = read_labels(spark, base + "/labels", ["case_id", "subtype"])
    m, lab_out = prepare_bulk_dataset(features, labels, fmap, "case_id", "subtype",
                                      _versioned_gene_list(spark, sf_dir), "l")
    return r6(m.cells.join(lab_out, SAMPLE))


SQL_C10 = f"""WITH {CTE},
top AS (SELECT gene_id FROM dense GROUP BY gene_id ORDER BY (count(*) * sum(value::HUGEINT * value::HUGEINT) - sum(value::HUGEINT) * sum(value::HUGEINT)) DESC, gene_id LIMIT 20),
l AS ({B.SQL_REGION_LABELS}),
c AS (SELECT label, count(*) AS n_class FROM l GROUP BY label),
b AS (SELECT label, floor(50 * n_class / (SELECT sum(n_class) FROM c)) AS b,
             50 * n_class / (SELECT sum(n_class) FROM c) - floor(50 * n_class / (SELECT sum(n_class) FROM c)) AS rem FROM c),
q AS (SELECT label, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= 50 - (SELECT sum(b) FROM b)
                           THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT l.*, row_number() OVER (PARTITION BY label ORDER BY {sql_key('sample_id')}, sample_id) - 1 AS rk FROM l),
s AS (SELECT sample_id, label FROM r JOIN q USING (label) WHERE rk < quota)
SELECT sample_id, gene_id, round(value, 6) AS value, label FROM cells JOIN s USING (sample_id) JOIN top USING (gene_id)"""


@register("c10_undersample_dataset", SQL_C10)
def q_undersample(spark, sf_dir):
    from .prep import undersample_dataset
    m, lab = undersample_dataset(B.tpch_matrix(spark, sf_dir), B.region_labels(spark, sf_dir), 20, 50)
    return r6(m.cells.join(lab, SAMPLE))


SQL_C11 = f"""WITH {CTE},
sr AS (SELECT sample_id, row_number() OVER (ORDER BY {sql_key('sample_id')}, sample_id) - 1 AS sr FROM samples),
gr AS (SELECT gene_id, row_number() OVER (ORDER BY {sql_key('gene_id')}, gene_id) - 1 AS gr FROM genes),
grid AS (SELECT * FROM (VALUES (20, 10), (20, 30), (40, 10), (40, 30)) t(n_samples, n_genes))
SELECT n_samples, n_genes, sample_id, gene_id, round(value, 6) AS value
FROM cells JOIN sr USING (sample_id) JOIN gr USING (gene_id) JOIN grid ON sr < n_samples AND gr < n_genes"""


@register("c11_subsample_grid", SQL_C11)
def q_subsample_grid(spark, sf_dir):
    from .prep import subsample_grid
    return r6(subsample_grid(B.tpch_matrix(spark, sf_dir), [20, 40], [10, 30]))


# ---------------------------------------------------------------------------- C6 on the customer × part matrix
SQL_C6_CUSTOMERS = f"""WITH {B.sql_customer_part_ctes()},
ln AS ({_sql_lognorm('dense')}),
hv AS (SELECT gene_id FROM ln GROUP BY gene_id ORDER BY var_samp(value) DESC, gene_id LIMIT 1000),
sel AS (SELECT ln.* FROM ln JOIN hv USING (gene_id)),
st AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM sel GROUP BY gene_id)
SELECT sample_id, gene_id, round(CASE WHEN v = 0 THEN NULL ELSE (value - m) / v END, 6) AS value
FROM sel JOIN st USING (gene_id)"""


@register("c6_single_cell_pipeline_customers", SQL_C6_CUSTOMERS)
def q_single_cell_customers(spark, sf_dir):
    """C6 on a sparse customer × part matrix (1,500 × 2,000 at sf0.01, 15,000 × 20,000
    at sf0.1): log-normalise, 1,000 most variable parts, dense scaled output."""
    from .singlecell import single_cell_pipeline
    m = B.customer_part_matrix(spark, sf_dir)
    return r6(single_cell_pipeline(m, n_top=1000))


# ---------------------------------------------------------------------------- C3 / C5 per batch (Q1, Q2)
def _supplier_batches(spark, sf_dir):
    """(sample_id, batch): suppliers in three batches by nation key."""
    return B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(SAMPLE),
                                                     (F.col("s_nationkey") % 3).alias("batch"))


_SQL_BATCH = "bt AS (SELECT s_suppkey AS sample_id, s_nationkey % 3 AS batch FROM supplier)"

SQL_C3_BATCH = f"""WITH {CTE}, {_SQL_BATCH},
gs AS (SELECT batch, gene_id, sum(value) AS s FROM dense JOIN bt USING (sample_id) GROUP BY ALL)
SELECT sample_id, gene_id,
  round(ln(CASE WHEN value / (CASE WHEN s = 0 THEN 1e-6 ELSE s END) * 10000 = 0 THEN 1
                ELSE value / (CASE WHEN s = 0 THEN 1e-6 ELSE s END) * 10000 END), 6) AS value
FROM cells JOIN bt USING (sample_id) JOIN gs USING (batch, gene_id)"""


@register("c3_log_normalize_batches", SQL_C3_BATCH)
def q_log_normalize_batches(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(transforms.log_normalize(m, batches=_supplier_batches(spark, sf_dir)).cells)


SQL_C5_BATCH = f"""WITH {CTE}, {_SQL_BATCH},
d AS (SELECT * FROM dense JOIN bt USING (sample_id)),
st AS (SELECT batch, gene_id, avg(value) AS m, var_samp(value) AS v FROM d GROUP BY ALL)
SELECT sample_id, gene_id, round(CASE WHEN v = 0 OR v IS NULL THEN NULL ELSE (value - m) / v END, 6) AS value
FROM d JOIN st USING (batch, gene_id)"""


@register("c5_scale_by_variance_batches", SQL_C5_BATCH)
def q_scale_batches(spark, sf_dir):
    m = B.tpch_matrix(spark, sf_dir)
    return r6(transforms.scale_by_variance(m, batches=_supplier_batches(spark, sf_dir)))


# ---------------------------------------------------------------------------- X3, X4
@register("x4_uq_estimator", SQL_C1)
def q_uq_estimator(spark, sf_dir):
    """C1 through the Estimator/Model interface (fit on the cells, transform them)."""
    from ..operators.estimators import UpperQuartileNormalizer
    cells = B.tpch_matrix(spark, sf_dir).cells
    return r6(UpperQuartileNormalizer(q=0.75).fit(cells).transform(cells))


SQL_X3 = f"""WITH {CTE}, {_SQL_BATCH}
SELECT batch, CAST(count(*) AS BIGINT) AS n_cells, round(sum(value), 6) AS total
FROM cells JOIN bt USING (sample_id) GROUP BY batch"""


@register("x3_map_batches", SQL_X3)
def q_map_batches(spark, sf_dir):
    """A pandas function per batch of samples (the reference's map_partitions hook)."""
    import pandas as pd

    from ..operators.estimators import map_batches

    def summarise(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [int(p["batch"].iloc[0])], "n_cells": [len(p)],
                             "total": [float(p["value"].sum())]})

    c = B.tpch_matrix(spark, sf_dir).cells.join(_supplier_batches(spark, sf_dir), SAMPLE)
    parts = map_batches(c, summarise, "batch int, n_cells long, total double", "batch", max_rows=50_000)
    return r6(parts.groupBy("batch").agg(F.sum("n_cells").alias("n_cells"), F.sum("total").alias("total")))


# ---------------------------------------------------------------------------- C2 on embeddings (row-array input)
CTE_EMB = """cells AS (SELECT vec_id AS sample_id, CAST(i - 1 AS INTEGER) AS gene_id, abs(CAST(embedding[i] AS DOUBLE)) AS value
                FROM embeddings, range(1, 65) t(i)),
samples AS (SELECT vec_id AS sample_id FROM embeddings),
genes AS (SELECT CAST(range AS INTEGER) AS gene_id FROM range(64)),
dense AS (SELECT * FROM cells)"""

SQL_C2_EMB = _sql_normalized(CTE_EMB) + """
SELECT c.sample_id, c.gene_id, round(log2(c.value * nf.norm_factor / geo.g + 1), 6) AS value
FROM cells c JOIN keep USING (gene_id) JOIN nf USING (sample_id), geo"""


@register("c2_feature_preprocessing_embeddings", SQL_C2_EMB)
def q_feature_preprocessing_emb(spark, sf_dir):
    """C2 on the row-array embeddings (absolute values; the table holds no zeros)."""
    from .bulk import feature_preprocessing
    return r6(feature_preprocessing(B.embedding_matrix(spark, sf_dir, absolute=True)).cells)


# ---------------------------------------------------------------------------- A7
SQL_A7 = _sql_uq_factors(CTE) + """,
norm AS (SELECT d.sample_id, d.gene_id, d.value * nf.norm_factor / geo.g AS value
         FROM dense d JOIN nf USING (sample_id), geo),
gs AS (SELECT gene_id, avg(value) AS m, var_samp(value) AS v FROM norm GROUP BY gene_id)
SELECT round(quantile_cont(m, 0.25), 6) AS q_mean, round(quantile_cont(v, 0.25), 6) AS q_var FROM gs"""


@register("a7_stat_quantiles", SQL_A7)
def q_stat_quantiles(spark, sf_dir):
    """Exact 0.25-quantiles of the per-gene means and variances of the normalised matrix."""
    m = transforms.upper_quartile_normalize(B.tpch_matrix(spark, sf_dir))
    return r6(stats.stat_quantiles(stats.gene_stats(m), 0.25))


from . import catalog_keys  # noqa: E402, F401  (registers its queries here)
