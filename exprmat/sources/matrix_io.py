"""Reading and writing matrices.

No reader here keeps one Spark column per gene (D0.1): CSV rows are read as text and
split once into an array; wide parquet files become row-arrays through ``array(*cols)``,
a block of columns at a time.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import GENE, SAMPLE, VALUE, VALUES, ExprMatrix, counted_broadcast

# Gene columns that one scan of a wide parquet file reads: a plan with many thousand
# columns is handled badly by the optimizer, and a row group of them fills memory.
WIDE_COLUMN_LIMIT = 2000


# ---------------------------------------------------------------------------- S3
def detect_format(path: str, rule: str = "suffix") -> str:
    """'parquet' when the last extension contains 'parquet' (``rule='anywhere'``: the
    substring anywhere in the path, as the cluster variant does), else 'csv'."""
    p = path.rstrip("/")
    if rule == "anywhere":
        return "parquet" if "parquet" in p else "csv"
    ext = os.path.splitext(p)[1].lower()
    return "parquet" if "parquet" in ext else "csv"


# ---------------------------------------------------------------------------- S1
def read_matrix_csv(spark: SparkSession, path: str, id_col: str | None = None,
                    sep: str = ",") -> tuple[DataFrame, list[str]]:
    """A CSV matrix (header = gene names, one row per sample) as row-arrays.

    Lines are read as text and split once; every field goes through ``try_cast`` to
    double, so integer files are widened to float as in the reference. ``id_col``
    names the key column (kept as sample_id); without one, each row gets a unique
    id from ``monotonically_increasing_id`` (the reference keys rows by position).
    A row with more or fewer fields than the header raises. Returns ``(rows, gene_names)``.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    lines = spark.read.text(path)
    header_line = sep.join(header)
    parts = lines.filter((F.col("value") != header_line) & (F.length("value") > 0)) \
        .select(F.split("value", sep_regex(sep)).alias("_f")) \
        .select(F.when(F.size("_f") == len(header), F.col("_f")).otherwise(F.raise_error(F.format_string(
            f"a row has %d fields, the header {len(header)}", F.size("_f")))).alias("_f"))
    if id_col is not None:
        pos = header.index(id_col)
        genes = [h for i, h in enumerate(header) if i != pos]
        vals = F.filter(F.col("_f"), lambda x, i: i != pos)
        rows = parts.select(F.col("_f")[pos].alias(SAMPLE),
                            F.transform(vals, lambda x: x.try_cast("double")).alias(VALUES))
    else:
        genes = header
        rows = parts.select(F.monotonically_increasing_id().alias(SAMPLE),
                            F.transform("_f", lambda x: x.try_cast("double")).alias(VALUES))
    return rows, genes


def sep_regex(sep: str) -> str:
    import re
    return re.escape(sep)


# ---------------------------------------------------------------------------- S2
def read_parquet_matrix(spark: SparkSession, path: str, layout: str = "long", id_col: str | None = None,
                        values_col: str = VALUES) -> DataFrame:
    """A parquet matrix, lazily.

    ``layout='long'``: columns sample_id, gene_id, value; ``'rows'``: sample_id and an
    array column; ``'wide'``: one column per gene (plus ``id_col``) → row-arrays.
    """
    if layout == "long":
        return spark.read.parquet(path).select(SAMPLE, GENE, F.col(VALUE).cast("double"))
    if layout == "rows":
        df = spark.read.parquet(path)
        return df.select(F.col(id_col or SAMPLE).alias(SAMPLE),
                         F.transform(values_col, lambda x: x.cast("double")).alias(VALUES))
    if layout == "wide":
        return read_wide_parquet(spark, path, id_col)[0]
    raise ValueError("layout must be 'long', 'rows' or 'wide'")


def read_wide_parquet(spark: SparkSession, path: str, id_col: str | None = None,
                      max_array_columns: int = WIDE_COLUMN_LIMIT) -> tuple[DataFrame, list[str]]:
    """Wide parquet (one column per gene) → ``(sample_id, values)`` + gene names.

    Each scan reads a block of at most ``max_array_columns`` columns (the others are
    pruned) into one array per row; the blocks of a row are then gathered by its id. Ids
    without ``id_col`` are ``<file name>:<row number>``. Any Hadoop path works, and a
    missing value stays NULL whatever the number of blocks.
    """
    columns = spark.read.parquet(path).columns
    genes = [c for c in columns if c != id_col]

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def block(k: int) -> DataFrame:
        df = spark.read.parquet(path)
        sid = F.col(quoted(id_col)).cast("string") if id_col else F.concat(
            F.col("_metadata.file_name"), F.lit(":"), F.col("_metadata.row_index").cast("string"))
        part = genes[k:k + max_array_columns]
        return df.select(sid.alias(SAMPLE), F.array(*[F.col(quoted(g)).cast("double") for g in part]).alias(VALUES))

    if len(genes) <= max_array_columns:
        return block(0), genes
    pieces = None
    for n, k in enumerate(range(0, len(genes), max_array_columns)):
        one = block(k).withColumn("_block", F.lit(n))
        pieces = one if pieces is None else pieces.unionByName(one)
    rows = pieces.groupBy(SAMPLE).agg(F.sort_array(F.collect_list(F.struct("_block", VALUES))).alias("_b"))
    return rows.select(SAMPLE, F.flatten(F.transform("_b", lambda x: x[VALUES])).alias(VALUES)), genes


def read_matrix(spark: SparkSession, path: str, fmt: str | None = None, layout: str = "long",
                id_col: str | None = None, genes: list[str] | None = None) -> ExprMatrix:
    """Read a matrix file into the sparse long matrix (zeros dropped)."""
    fmt = fmt or detect_format(path)
    if fmt == "parquet" and layout == "long":
        return ExprMatrix.from_cells(read_parquet_matrix(spark, path, "long"), drop_zeros=True)
    if fmt == "parquet":
        if layout == "wide":
            rows, names = read_wide_parquet(spark, path, id_col)
        else:
            rows, names = read_parquet_matrix(spark, path, "rows", id_col), genes
    else:
        rows, names = read_matrix_csv(spark, path, id_col)
    return ExprMatrix.from_row_array(rows, SAMPLE, VALUES, gene_ids=names, drop_zeros=True)


# ---------------------------------------------------------------------------- S9–S13
def estimated_row_bytes(schema: T.StructType, array_len: int = 1000) -> int:
    """Rough uncompressed row width from the schema (arrays count ``array_len`` items)."""
    def size(dt) -> int:
        if isinstance(dt, T.ArrayType):
            return 8 + array_len * size(dt.elementType)
        if isinstance(dt, T.StructType):
            return sum(size(f.dataType) for f in dt.fields)
        if isinstance(dt, (T.StringType, T.BinaryType)):
            return 20
        if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
            return 8
        if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
            return 4
        if isinstance(dt, T.DecimalType):
            return 16
        return 2 if isinstance(dt, T.ShortType) else 1
    return max(1, size(schema))


def repartition_by_size(df: DataFrame, target_bytes: int, n_rows: int | None = None,
                        row_bytes: int | None = None) -> DataFrame:
    """ceil(rows × row bytes / target) partitions, at least 1 (the reference's
    floor division can give 0). ``n_rows`` defaults to a count of ``df``."""
    n = df.count() if n_rows is None else n_rows
    rb = row_bytes or estimated_row_bytes(df.schema)
    return df.repartition(max(1, math.ceil(n * rb / float(target_bytes))))


def copartition(a: DataFrame, b: DataFrame, key: str = SAMPLE, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hash-partition two tables on the same key and count, so a later join on
    the key needs no further shuffle (the reference aligns label divisions instead)."""
    n = n or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, key), b.repartition(n, key)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 target_file_bytes: int | None = None, gene_names: list[str] | None = None,
                 partition_by: list[str] | None = None) -> None:
    """Write a long or row-array table.

    parquet: snappy-compressed. csv: long tables with a header row; row-array tables
    as ``sample_id,v1,…`` lines under a ``sample_id,<genes>`` header in every file.
    ``mode='append'`` adds files (S10). ``target_file_bytes`` caps rows per file from
    the estimated row width (S12 at write time, no count needed).
    """
    w_df = df
    opts = {}
    if target_file_bytes:
        per = max(1, target_file_bytes // estimated_row_bytes(df.schema))
        opts["maxRecordsPerFile"] = str(per)
    if fmt == "parquet":
        w = w_df.write.mode(mode).option("compression", "snappy").options(**opts)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return
    if fmt != "csv":
        raise ValueError("fmt must be 'parquet' or 'csv'")
    if VALUES in df.columns:
        if gene_names is None:
            raise ValueError("gene_names are needed for the CSV header of a row-array table")
        header = ",".join([SAMPLE] + [str(g) for g in gene_names])
        line = F.concat_ws(",", F.col(SAMPLE).cast("string"),
                           F.array_join(F.transform(VALUES, lambda x: x.cast("string")), ","))
        # One string column named after the header: the CSV writer puts the header in
        # every file; a tab separator never occurs, so the comma text is not quoted.
        (w_df.select(line.alias(header)).write.mode(mode).options(**opts)
         .option("header", True).option("sep", "\t").option("quote", "").csv(path))
        return
    w = w_df.write.mode(mode).options(**opts).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


# ---------------------------------------------------------------------------- S14
def read_coo(spark: SparkSession, path: str, fmt: str = "mtx", one_based: bool = True,
             sep: str = r"\s+") -> ExprMatrix:
    """A sparse count matrix as triplets (cell, gene, count).

    ``fmt='mtx'``: Matrix Market coordinate text. '%' lines are comments; the first
    other line of each file is its size line ``rows cols entries``, found exactly by
    block offset 0 and read order, not by content. Samples and genes are the full
    index ranges of the size line. ``fmt='parquet'``: columns cell, gene, count.
    """
    if fmt == "parquet":
        t = spark.read.parquet(path)
        cells = t.select(F.col("cell").alias(SAMPLE), F.col("gene").alias(GENE), F.col("count").alias(VALUE))
        return ExprMatrix.from_cells(cells, drop_zeros=True)
    lines = (spark.read.text(path)
             .select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("_f"),
                     F.input_file_block_start().alias("_b"), F.monotonically_increasing_id().alias("_o"))
             .filter(~F.col("v").startswith("%") & (F.length("v") > 0)))
    firsts, _ = counted_broadcast(lines.filter(F.col("_b") == 0).groupBy("_f").agg(F.min("_o").alias("_o")))
    size = lines.join(firsts, ["_f", "_o"]).select(F.split("v", sep).alias("s"))
    dims = size.agg(F.max(F.col("s")[0].cast("long")).alias("r"), F.max(F.col("s")[1].cast("long")).alias("c")).first()
    body = lines.join(firsts, ["_f", "_o"], "left_anti").select(F.split("v", sep).alias("t"))
    shift = 1 if one_based else 0
    cells = body.select((F.col("t")[0].cast("long") - shift).alias(SAMPLE),
                        (F.col("t")[1].cast("long") - shift).alias(GENE),
                        F.col("t")[2].cast("double").alias(VALUE))
    cells = cells.groupBy(SAMPLE, GENE).agg(F.sum(VALUE).alias(VALUE))
    samples = spark.range(int(dims["r"] or 0)).select(F.col("id").alias(SAMPLE))
    genes = spark.range(int(dims["c"] or 0)).select(F.col("id").alias(GENE))
    return ExprMatrix.from_cells(cells, samples, genes, drop_zeros=True)
