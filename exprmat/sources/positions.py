"""Rows keyed by their position in splittable files.

Files without a key column pair by row number: row i of the features belongs to row i of the
labels. A file is read by several tasks, so no task knows the number of its first line; two
phases give it. The first counts the records of every block that is read (a text file's block, a
parquet file); the blocks, in path and offset order, get prefix sums. A record's number is its
block's sum plus its place within the block. Both phases read the same splits, and
only counts are added up, never records: a table of one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import SAMPLE, VALUES, materialize
from .matrix_io import WIDE_COLUMN_LIMIT, detect_format

POSITION = "position"


def _block_offsets(blocks: DataFrame, within: str = "n") -> DataFrame:
    """``_file, _block, _first``: the records before each block, files in path order.

    Prefix sums within a file, shifted by the files before it, so the one ordered window
    over the whole input holds a row per file.
    """
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("_in", F.coalesce(F.sum(within).over(w), F.lit(0)))
    files = blocks.groupBy("_file").agg(F.sum(within).alias("_total"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return inner.join(files, "_file").select("_file", "_block", (F.col("_before") + F.col("_in")).alias("_first"))


def number_lines(spark: SparkSession, path: str, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """Every line that is not empty, with its number over all files: ``(position, line)``.

    ``skip`` lines at the head of every file are left out and not numbered; they are returned as
    the second frame ``(file, line)``. They are told by place, never by content.
    """
    lines = (spark.read.text(path)
             .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
                     F.input_file_block_start().alias("_block"))
             .where(F.length("line") > 0).withColumn("_at", F.monotonically_increasing_id()))
    # a task reads a block's lines one after the other, so the least id of a block is its first line's
    blocks = materialize(lines.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("_least")), "blocks")
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = (blocks.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
             .withColumn("_skip", F.greatest(F.lit(0), F.least("n", F.lit(skip) - F.col("_in"))).cast("long")))
    kept = heads.withColumn("n", F.col("n") - F.col("_skip"))
    first = _block_offsets(kept.select("_file", "_block", "n"))
    index = materialize(kept.select("_file", "_block", "_least", "_skip").join(first, ["_file", "_block"]), "block_index")
    placed = lines.join(index, ["_file", "_block"]).withColumn("_place", F.col("_at") - F.col("_least"))
    body = (placed.where(F.col("_place") >= F.col("_skip"))
            .select((F.col("_first") + F.col("_place") - F.col("_skip")).alias(POSITION), "line"))
    head = placed.where(F.col("_place") < F.col("_skip")).select(F.col("_file").alias("file"), "line")
    return body, head


def split_fields(line: Column, sep: str = ",") -> Column:
    """The fields of a CSV record. A field in double quotes may hold the separator, and a doubled
    quote stands for one; records without any quote are split plainly."""
    import re

    s = re.escape(sep)
    # each field with the separator before it, so that no field is empty text
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{s}("(?:[^"]|"")*"|[^{s}]*)'), 1)
    plain = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, s))


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """``(position, fields array<string>)`` of a CSV file or folder, and the column names.

    Every file starts with the same header line. Records end at line ends. A record with more or
    fewer fields than the header raises, as do files with different headers.
    """
    body, heads = number_lines(spark, path, skip=1)
    names = heads.select(split_fields(F.col("line"), sep).alias("f")).distinct().limit(2).collect()
    if len(names) != 1:
        raise ValueError(f"{path}: {'no header' if not names else 'files with different headers'}")
    names = list(names[0]["f"])
    fields = body.select(POSITION, split_fields(F.col("line"), sep).alias("fields"))
    return fields.select(POSITION, F.when(F.size("fields") == len(names), F.col("fields")).otherwise(
        F.raise_error(F.format_string(f"a row has %d fields, the header {len(names)}", F.size("fields")))).alias("fields")), names


def number_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a parquet file or folder with their ``position``: files in path order, rows by
    the index that parquet keeps for each of them."""
    df = spark.read.parquet(path)
    counts = (df.select(F.col("_metadata.file_path").alias("_file"), F.lit(0).alias("_block"))
              .groupBy("_file", "_block").agg(F.count("*").alias("n")))
    first = materialize(_block_offsets(counts), "file_index").select("_file", "_first")
    wanted = [F.col("`" + c.replace("`", "``") + "`") for c in (columns or df.columns)]
    rows = df.select(*wanted, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    return rows.join(first, "_file").withColumn(POSITION, F.col("_first") + F.col("_place")).drop("_file", "_first", "_place")


def read_rows_by_position(spark: SparkSession, path: str, fmt: str | None = None, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """A keyless matrix file, one column per gene, as ``(sample_id, values)`` and the gene names; the
    sample id is the row's position. CSV fields that are no number are missing values."""
    if (fmt or detect_format(path)) == "csv":
        rows, names = csv_rows(spark, path, sep)
        return rows.select(F.col(POSITION).alias(SAMPLE), F.transform("fields", lambda x: x.try_cast("double")).alias(VALUES)), names
    names = spark.read.parquet(path).columns
    pieces = None
    for n, k in enumerate(range(0, max(1, len(names)), WIDE_COLUMN_LIMIT)):
        part = names[k:k + WIDE_COLUMN_LIMIT]
        block = number_parquet(spark, path, part)
        one = block.select(F.col(POSITION).alias(SAMPLE), F.lit(n).alias("_block"), F.array(
            *[F.col("`" + g.replace("`", "``") + "`").cast("double") for g in part]).alias(VALUES))
        pieces = one if pieces is None else pieces.unionByName(one)
    if len(names) <= WIDE_COLUMN_LIMIT:
        return pieces.drop("_block"), names
    rows = pieces.groupBy(SAMPLE).agg(F.sort_array(F.collect_list(F.struct("_block", VALUES))).alias("_b"))
    return rows.select(SAMPLE, F.flatten(F.transform("_b", lambda x: x[VALUES])).alias(VALUES)), names


def read_labels_by_position(spark: SparkSession, path: str, label_col: str, fmt: str | None = None, sep: str = ",") -> DataFrame:
    """``(sample_id, label)`` of a keyless label file; the sample id is the row's position."""
    if (fmt or detect_format(path)) == "csv":
        rows, names = csv_rows(spark, path, sep)
        return rows.select(F.col(POSITION).alias(SAMPLE), F.col("fields")[names.index(label_col)].alias("label"))
    rows = number_parquet(spark, path, [label_col])
    return rows.select(F.col(POSITION).alias(SAMPLE), F.col("`" + label_col.replace("`", "``") + "`").alias("label"))


def pair_by_position(features: DataFrame, labels: DataFrame) -> DataFrame:
    """J3 by position: row i of ``features`` with row i of ``labels`` (both keyed by ``sample_id`` =
    position). Files of different length raise instead of pairing a part."""
    sizes = [df.agg(F.count("*"), F.max(SAMPLE)).first() for df in (features, labels)]
    if tuple(sizes[0]) != tuple(sizes[1]):
        raise ValueError(f"{sizes[0][0]} feature rows cannot pair with {sizes[1][0]} label rows")
    return features.join(labels, SAMPLE)
