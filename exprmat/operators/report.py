"""Benchmark-result tables.

Result rows are long: ``(dimension, framework, value)``, one per measured repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the misspelt framework label in one published result file and its fix.
FRAMEWORK_FIXES = {"Scientific Python Ecnvironment": "Scientific Python Environment"}


def normalise_framework(col: str | Column = "framework") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    for bad, good in FRAMEWORK_FIXES.items():
        c = F.when(c == bad, F.lit(good)).otherwise(c)
    return c


def best_of_repeats(results: DataFrame, dims=("dimension", "framework"), value: str = "value",
                    how: str = "min") -> DataFrame:
    """The best (min for runtimes, max for scores) value over repeats."""
    agg = F.min(value) if how == "min" else F.max(value)
    return results.groupBy(*dims).agg(agg.alias(value))


def pivot_results(results: DataFrame, frameworks: list[str] | None = None, dimension: str = "dimension",
                  framework: str = "framework", value: str = "value", order: str | None = None) -> DataFrame:
    """One row per dimension, one column per framework; with several rows for one
    cell the last (largest ``order``) wins. Passing ``frameworks`` avoids the extra job
    Spark runs to discover the pivot values."""
    pick = F.max_by(value, order) if order else F.last(value)
    return results.groupBy(dimension).pivot(framework, frameworks).agg(pick)


def unpivot_results(wide: DataFrame, dimension: str = "dimension", frameworks: list[str] | None = None,
                    framework: str = "framework", value: str = "value") -> DataFrame:
    """Wide result table → long ``(dimension, framework, value)`` rows."""
    cols = frameworks or [c for c in wide.columns if c != dimension]
    return wide.unpivot([dimension], cols, framework, value)


def benchmark_report(results: DataFrame, frameworks: list[str], how: str = "min") -> DataFrame:
    """Best of repeats (A15), then the dimension × framework panel."""
    best = best_of_repeats(results.withColumn("framework", normalise_framework()), how=how)
    return pivot_results(best, frameworks, order=None)
