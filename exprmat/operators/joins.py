"""Joins and set operations on samples, labels and file maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import MAX_BROADCAST_SAMPLES, SAMPLE, checked_broadcast, cache_small


def attach_filename(ids: DataFrame, file_map: DataFrame, id_col: str = "id",
                    file_col: str = "file_name") -> DataFrame:
    """Add the file name of each id; ids without one get NULL (left join).

    The map is broadcast when its checked row count allows, else shuffle-joined.
    """
    fm = cache_small(file_map.select(id_col, file_col))
    return ids.join(checked_broadcast(fm, fm.count(), MAX_BROADCAST_SAMPLES), id_col, "left")


def assert_unique_key(df: DataFrame, key: str, what: str = "labels") -> None:
    """Raise if ``key`` repeats in ``df`` (a keyed label table must be unique)."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if dup:
        raise ValueError(f"{what}: key {key}={dup[0][0]!r} occurs more than once")


def match_samples(features: DataFrame, labels: DataFrame, key: str = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Keep features that have a label and labels that have features, both
    sorted by key. Duplicate label keys raise (the reference would misalign rows)."""
    assert_unique_key(labels, key)
    f = features.join(labels.select(key), key, "left_semi").orderBy(key)
    lab = labels.join(features.select(key).distinct(), key, "left_semi").orderBy(key)
    return f, lab


def join_labels(features: DataFrame, labels: DataFrame, key: str = SAMPLE) -> DataFrame:
    """Features and labels on one row, matched by key; a key with several labels raises,
    several feature rows of one key each get its label. By position: ``sources.positions``."""
    assert_unique_key(labels, key)
    return features.join(labels, key, "inner")


def common_ids(a: DataFrame, b: DataFrame, key: str = SAMPLE) -> DataFrame:
    """Ids present in both tables (set intersection)."""
    return a.select(key).intersect(b.select(key))


def append_rows(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name (one multi-file scan does this for files)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
