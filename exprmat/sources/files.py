"""Label, metadata, per-sample and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import basename
from ..matrix import GENE, SAMPLE, VALUE, ExprMatrix, counted_broadcast, materialize

# The reference's NA marker in exposure tables, the file-name tags of a
# per-sample expression file, and the row prefix of gene (not footer) rows.
NA_MARKER = "'--"
SAMPLE_FILE_TAGS = ("counts", "pkm")
GENE_ROW_PREFIX = "ENSG"
LISTINGS_PER_CORE = 8


def read_labels(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t",
                na_value: str = NA_MARKER, rename: dict[str, str] | None = None) -> DataFrame:
    """S4 (+P2): a delimited label table with a header; ``na_value`` cells are NULL;
    only ``columns`` are read (pruned at the scan)."""
    df = (spark.read.option("header", True).option("sep", sep).option("nullValue", na_value)
          .option("inferSchema", False).csv(path))
    if columns:
        df = df.select(*columns)
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    return df


_ENTITY = T.StructType([T.StructField("entity_submitter_id", T.StringType()),
                        T.StructField("case_id", T.StringType())])
_CART = T.StructType([T.StructField("file_name", T.StringType()),
                      T.StructField("associated_entities", T.ArrayType(_ENTITY))])


def read_file_map(spark: SparkSession, path: str, id_field: str = "case_id", contains: str | None = None,
                  multiline: bool = True, order_field: str | None = None) -> DataFrame:
    """Metadata JSON (an array of objects, or JSON lines with ``multiline=False``)
    → ``(id, file_name)`` with id = ``associated_entities[0].<id_field>``.

    ``contains`` keeps ids containing that text (the BRCA variant keeps 'TCGA'). When an
    id occurs more than once the last record wins, as in a dict built in file order:
    ``order_field`` names a field giving that order, otherwise the read order is used.
    """
    schema = _CART if order_field is None else T.StructType(_CART.fields + [T.StructField(order_field, T.LongType())])
    df = spark.read.schema(schema).option("multiLine", multiline).json(path)
    order = F.col(order_field) if order_field else F.monotonically_increasing_id()
    ids = df.select(F.get(F.col("associated_entities"), 0)[id_field].alias("id"), "file_name",
                    order.alias("_pos"))
    ids = ids.filter(F.col("id").isNotNull())
    if contains:
        ids = ids.filter(F.col("id").contains(contains))
    return ids.groupBy("id").agg(F.max_by("file_name", "_pos").alias("file_name"))


def read_sample_files(spark: SparkSession, root: str, tags=SAMPLE_FILE_TAGS, name_glob: str | None = None,
                      gene_prefix: str | None = GENE_ROW_PREFIX, key: str = "file",
                      n_subsamples: int | None = None, seed: int = 42) -> ExprMatrix:
    """S6 (+P4, U1, S7): a directory tree with one subfolder per sample.

    Each subfolder contributes its first file (by path) whose lower-case name contains
    one of ``tags`` (or matches ``name_glob``); plain or .gz TSV without header, gene id
    and value. Only rows whose id starts with ``gene_prefix`` are kept (footers go).
    The sample key is the file's base name (``key='file'``) or its folder name
    (``key='folder'``). Genes are aligned by id, not by row position.
    ``n_subsamples`` draws that many folders with replacement (S7); a folder drawn
    twice appears twice, with ``#k`` appended to its key.
    """
    from ..operators.sampling import sample_with_replacement

    schema = T.StructType([T.StructField(GENE, T.StringType()), T.StructField(VALUE, T.DoubleType())])
    glob = name_glob or "*"
    # folders are listed by a job of a few tasks per core, not of one task per folder
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), LISTINGS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        raw = (spark.read.schema(schema).option("sep", "\t").option("header", False)
               .option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)
               .withColumn("_path", F.col("_metadata.file_path")))
    finally:
        spark.conf.set(setting, before)
    name = F.lower(basename("_path"))
    if name_glob is None:
        cond = F.lit(False)
        for t in tags:
            cond = cond | name.contains(t)
        raw = raw.filter(cond)
    # many small files cost their opening, so each is opened once: the choice of files, the dimensions and the
    # cells are all taken from the rows as written here
    raw = materialize(raw.withColumn("_dir", F.regexp_replace("_path", "/[^/]*$", "")), "sample_files")
    first = raw.select("_dir", "_path").distinct().groupBy("_dir").agg(F.min("_path").alias("_path"))
    if n_subsamples is not None:
        # The occurrence number of a repeated draw is computed on the draws (one row
        # per draw), never on the cells, so a folder drawn many times adds no hot group.
        draws = sample_with_replacement(first, "_dir", n_subsamples, seed)
        occ = F.row_number().over(Window.partitionBy("_dir").orderBy("draw")) - 1
        first = draws.withColumn("_occ", occ).join(first, "_dir").select("_dir", "_path", "_occ")
    else:
        first = first.withColumn("_occ", F.lit(0))
    first, _ = counted_broadcast(first)      # one row per folder (per draw)
    cells = raw.join(first, ["_dir", "_path"])
    if gene_prefix:
        cells = cells.filter(F.col(GENE).startswith(gene_prefix))
    sid = basename("_path") if key == "file" else basename("_dir")
    sid = F.when(F.col("_occ") == 0, sid).otherwise(F.concat(sid, F.lit("#"), F.col("_occ").cast("string")))
    cells = cells.select(sid.alias(SAMPLE), GENE, VALUE)
    return ExprMatrix.from_cells(materialize(cells.groupBy(SAMPLE, GENE).agg(F.sum(VALUE).alias(VALUE)), "sample_cells"))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """A one-column gene list with a header row → ``(gene_id)``."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(df.columns[0]).alias(GENE))


_RESULTS = "dimension string, framework string, value string"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV (header names vary per file) → ``(dimension, framework, value)``;
    the value text is parsed with try_cast (F9)."""
    df = spark.read.option("header", True).schema(_RESULTS).option("enforceSchema", True).csv(path)
    return df.select("dimension", "framework", F.col("value").try_cast("double").alias("value"))


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S16 (sink): long result rows as CSV with a header."""
    df.select("dimension", "framework", "value").write.mode(mode).option("header", True).csv(path)
