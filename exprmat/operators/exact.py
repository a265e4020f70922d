"""Sums, means and variances with the same bits in any partitioning.

A sum of doubles depends on the order of its terms, which depends on the partitioning. Here a value
is split without error into whole multiples of fixed powers of two, 30 bits each ("digits"), and the
digits are added as integers, which no order changes. A square is split into its rounded product
and the product's error, both exact. What an aggregate adds up is thus

    k, missing, s0 … s5 (digits of Σx, units 2^30 … 2^-120), q0 … q7 (digits of Σx², 2^60 … 2^-150).

Such a *moment state* is a plain table: states are merged by adding and a part is taken out again
by subtracting, both without any error, so the statistics of all rows but some never need those rows
again. ``finish`` turns a state into n, total, mean and variance, each the exact value of the digits
rounded once. Values below the last unit lose the bits under it, each by itself, which no
order changes either; a value of 2^93 or more, or an infinite one, raises. A gene may have 2^33
values before a digit's sum overflows, which raises too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import VALUE

DIGIT_BITS = 30
#: (exponent of the first unit, digits)
SUM_GRID = (30, 6)
SQUARE_GRID = (60, 8)
SUMS = [f"s{i}" for i in range(SUM_GRID[1])]
SQUARES = [f"q{i}" for i in range(SQUARE_GRID[1])]
STATE = ["k", "missing", *SUMS, *SQUARES]


def digits(v: Column, grid: tuple[int, int]) -> list[Column]:
    """``v`` as integers times 2^e, 2^(e-30), …: rounded to each unit, less what the unit before holds."""
    first, n = grid
    at = [F.rint(v * F.lit(2.0 ** -(first - DIGIT_BITS * i))) for i in range(n)]
    base = F.lit(2.0 ** DIGIT_BITS)
    return [(a - base * at[i - 1] if i else a).cast("long") for i, a in enumerate(at)]


def moment_state(df: DataFrame, by: list[str], value: str = VALUE) -> DataFrame:
    """``by`` columns and the moment state of ``value`` per group; NULL values count as missing.

    One hash aggregate over fixed-width integers, combined on the map side.
    """
    x = F.col(value)
    half = x * F.lit(134217729.0)  # 2^27 + 1: the upper half of the bits, by Veltkamp's split
    rows = df.select(*by, x.alias("_x"), (half - (half - x)).alias("_h"))
    low = F.col("_x") - F.col("_h")
    square = F.col("_x") * F.col("_x")
    error = (F.col("_h") * F.col("_h") - square) + F.lit(2.0) * F.col("_h") * low + low * low
    rows = rows.select(*by, "_x", square.alias("_p"), error.alias("_e"))
    squares = [a + b for a, b in zip(digits(F.col("_p"), SQUARE_GRID), digits(F.col("_e"), SQUARE_GRID), strict=True)]
    rows = rows.select(*by, "_x", *[d.alias(c) for c, d in zip(SUMS, digits(F.col("_x"), SUM_GRID), strict=True)],
                       *[d.alias(c) for c, d in zip(SQUARES, squares, strict=True)])
    return rows.groupBy(*by).agg(F.count("_x").alias("k"), F.count_if(F.col("_x").isNull()).alias("missing"),
                                 *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS + SQUARES])


def merge_states(states: list[DataFrame], by: list[str]) -> DataFrame:
    """The state of all rows together (U1, S10: rows appended to what was counted before)."""
    out = states[0].select(*by, *STATE)
    for s in states[1:]:
        out = out.unionByName(s.select(*by, *STATE))
    return out.groupBy(*by).agg(*[F.sum(c).alias(c) for c in STATE])


def subtract_state(whole: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """The state of the rows of ``whole`` that are not in ``part``; a group without rows left stays, with k = 0."""
    p = part.select(*by, *[(-F.col(c)).alias(c) for c in STATE])
    return merge_states([whole, p], by)


def _number(digit_sums: list[int], last: int) -> int:
    """The digits' total in units of 2^last."""
    out = 0
    for d in digit_sums:
        out = (out << DIGIT_BITS) + d
    return out


def finish(state: DataFrame, by: list[str], rows: str) -> DataFrame:
    """``by, n, total, mean, var, var_pop`` of a state. ``rows`` names the column that holds how many rows a group
    has; rows without a stored value are zeros, missing values are none. Means of no row and sample
    variances of fewer than two are NULL. Runs once per group (a gene) on Python's integers."""
    types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    last_s = SUM_GRID[0] - DIGIT_BITS * (SUM_GRID[1] - 1)
    last_q = SQUARE_GRID[0] - DIGIT_BITS * (SQUARE_GRID[1] - 1)
    lift = last_q - 2 * last_s  # squares of sums come in units of 2^(2 last_s)
    nk, nb = len(SUMS), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, mean, var, pop, n_out = [], [], [], [], []
            columns = [c.to_pylist() for c in b.columns[nb:]]
            for n_rows, missing, *sums in zip(*columns, strict=True):
                n = n_rows - missing
                s, q = _number(sums[:nk], last_s), _number(sums[nk:], last_q)
                spread = max(0, (n * q << lift) - s * s) if n else 0
                n_out.append(n)
                total.append(s / (1 << -last_s))
                mean.append(s / (n << -last_s) if n else None)
                pop.append(spread / (n * n << -2 * last_s) if n else None)
                var.append(spread / (n * (n - 1) << -2 * last_s) if n > 1 else None)
            out = [pa.array(n_out, pa.int64()), *(pa.array(c, pa.float64()) for c in (total, mean, var, pop))]
            yield pa.RecordBatch.from_arrays([*b.columns[:nb], *out], names=[*by, "n", "total", "mean", "var", "var_pop"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "n long, total double, mean double, var double, var_pop double"])
    return state.select(*by, rows, "missing", *SUMS, *SQUARES).mapInArrow(run, schema)


def exact_mean(df: DataFrame, value: Column) -> DataFrame:
    """One row ``(mean)``: the mean of a column's values that are not NULL, the same bits in any order."""
    one = df.select(F.lit(1).alias("_g"), value.cast("double").alias(VALUE)).where(F.col(VALUE).isNotNull())
    return finish(moment_state(one, ["_g"]), ["_g"], "k").select("mean")
