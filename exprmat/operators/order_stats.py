"""Exact order statistics without a full sort.

The value of a given rank is found by narrowing: the values in the open interval are counted in
equal bins by one aggregate, the bin that holds the rank becomes the next interval (from its least
to its greatest value), until it is a single value or so few that they can be looked at one by
one. Every round reads the data once and shuffles at most ``BINS`` counts per task and rank; no
task and no driver holds the values, and any number of equal values is one value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: An interval with at most so many values is listed instead of narrowed further.
LISTED = 10_000


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], listed: int = LISTED) -> dict[tuple[str, int], float]:
    """The values of 0-based ``wanted`` ranks per numeric column of ``df``; NULL and NaN are left
    out, whole numbers are told apart up to 2^53.

    All columns and ranks are narrowed in the same rounds.
    """
    names = list(wanted)
    df = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) for c in names])
    head = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    # an open interval: its column, least and greatest value, values below it, values in it
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple, list[int]] = {}
    for i, c in enumerate(names):
        for r in wanted[c]:
            if not 0 <= r < head[f"n{i}"]:
                raise ValueError(f"{c} has {head[f'n{i}']} values, no rank {r}")
            if head[f"lo{i}"] == head[f"hi{i}"]:
                found[c, r] = head[f"lo{i}"]
            else:
                open_.setdefault((c, head[f"lo{i}"], head[f"hi{i}"], 0, head[f"n{i}"]), []).append(r)
    while open_:
        spans = list(open_)
        entries = []
        for k, (c, lo, hi, _, n) in enumerate(spans):
            v = F.col(c)
            if n <= listed:
                place = v.cast("double")
            else:  # halves, so that the width cannot overflow
                width = float(hi) / 2 - float(lo) / 2
                place = F.least(F.lit(BINS - 1.0), F.floor((v / 2.0 - F.lit(float(lo) / 2)) / F.lit(width) * BINS).cast("double"))
            entries.append(F.when(v.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(k).alias("span"), place.alias("bin"), v.cast("double").alias("v"))))
        rows = df.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
        bins: dict[int, list] = {}
        for b in rows.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            bins.setdefault(b["span"], []).append((b["lo"], b["hi"], b["n"]))
        nxt: dict[tuple, list[int]] = {}
        for k, span in enumerate(spans):
            for r in open_[span]:
                below = span[3]
                for lo, hi, n in sorted(bins[k]):
                    if r < below + n:
                        break
                    below += n
                if lo == hi:
                    found[span[0], r] = lo
                else:
                    nxt.setdefault((span[0], lo, hi, below, n), []).append(r)
        open_ = nxt
    return found


def exact_quantiles(df: DataFrame, columns: list[str], q: float) -> dict[str, float | None]:
    """The linearly interpolated ``q``-quantile of each column; None for a column without values."""
    counts = df.agg(*[F.count(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    at = {c: (counts[f"n{i}"] - 1) * q for i, c in enumerate(columns) if counts[f"n{i}"]}
    got = order_statistics(df, {c: sorted({math.floor(h), math.ceil(h)}) for c, h in at.items()})
    out: dict[str, float | None] = dict.fromkeys(columns)
    for c, h in at.items():
        lo, hi = math.floor(h), math.ceil(h)
        a, b = got[c, lo], got[c, hi]
        out[c] = a if lo == hi or a == b else (hi - h) * a + (h - lo) * b
    return out


def rank_cuts(df: DataFrame, key: Column, id_col: str, ranks: list[int]) -> list[tuple]:
    """The ``(key, id)`` at each 0-based rank in (key, id) order; ``key`` is an integer column.

    Keys are narrowed as above. Ids are only looked at where they share the key of a cut, one
    row per different id, so an id that many rows repeat is one row.
    """
    keyed = df.select(key.alias("_key"), F.col(id_col).alias("_id"))
    found = order_statistics(keyed, {"_key": sorted(set(ranks))})
    cuts = {r: int(found["_key", r]) for r in set(ranks)}
    at = sorted(set(cuts.values()))
    below = dict(zip(at, keyed.agg(*[F.count_if(F.col("_key") < t) for t in at]).first(), strict=True))
    ties: dict[int, list] = {}
    for r in keyed.where(F.col("_key").isin(at)).groupBy("_key", "_id").agg(F.count("*").alias("n")).collect():
        ties.setdefault(r["_key"], []).append((r["_id"], r["n"]))
    out = []
    for r in ranks:
        left = r - below[cuts[r]]
        for i, n in sorted(ties[cuts[r]], key=lambda x: (x[0] is not None, x[0])):
            if left < n:
                break
            left -= n
        out.append((cuts[r], i))
    return out


def after_cut(key: Column, id_col: str, cut: tuple) -> Column:
    """Whether a row's (key, id) comes after a cut; a null id comes before all others of its key."""
    t, i = cut
    later = F.col(id_col).isNotNull() if i is None else F.coalesce(F.col(id_col) > F.lit(i), F.lit(False))
    return (key > t) | ((key == t) & later)
