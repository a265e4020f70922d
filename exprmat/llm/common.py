"""Helpers shared by the operators: scratch tables, checked broadcasts, component labels."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from exprmat.session import ensure_checkpoint_dir, scratch_path

#: Rows of a few fixed-width columns that may be broadcast (about 100 bytes a row in a hash relation).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: the lineage is cut
    and a lost executor re-reads files instead of running the upstream plan again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI under the shared checkpoint folder, for files written by tasks."""
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, name)


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted ``rows`` are within ``bound``; above it
    the planner's shuffle join (with AQE skew splitting) is used."""
    return F.broadcast(df) if rows <= bound else df


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for the jobs that run within the block."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release_memory() -> None:
    """Give memory that a task has freed back to the system: Spark keeps idle Python workers for a
    minute, beside the executor's next tasks. Does nothing where the C library has no ``malloc_trim``."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is exact (and much faster) where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of an edge list as ``(node, component)``: the smallest node reachable.

    Every round a node takes the smallest label among its own and its neighbours', then the label
    of that label (pointer jumping), until no label changes; the label table is written each round,
    so lineage stays short and executors may be lost. Nodes are only those in ``edges``. Labels
    are aggregated with ``min``, which combines map-side, so a node with very many links is no
    hot group. Null ends take no part.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = pin(e.union(e.select("v", "u")).distinct(), f"{name}-edges")
    labels = pin(both.groupBy(F.col("u").alias("node")).agg(
        F.min(F.least("u", "v")).alias("component")), f"{name}-labels")
    while True:
        near = (both.join(labels, both.v == labels.node)
                .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("seen")))
        step = (labels.join(near, "node", "left")
                .select("node", F.col("component").alias("old"),
                        F.least("component", "seen").alias("best")))
        up = labels.select(F.col("node").alias("best"), F.col("component").alias("jump"))
        nxt = (step.join(up, "best", "left")
               .select("node", "old", F.least("best", "jump").alias("component")))
        nxt = pin(nxt, f"{name}-labels")
        changed = nxt.where("component <> old").limit(1).count()
        labels = nxt.select("node", "component")
        if not changed:
            return labels
