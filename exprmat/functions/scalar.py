"""Column expressions used by the operators. All built-in,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log2p1(x) -> Column:
    """log2(x + 1)."""
    return F.log2(_c(x) + F.lit(1.0))


def log10p1(x) -> Column:
    """log10(x + 1)."""
    return F.log10(_c(x) + F.lit(1.0))


def replace_value(x, old: float, new: float) -> Column:
    """Replace one value (0 → 1, 0 → 1e-6)."""
    x = _c(x)
    return F.when(x == F.lit(old), F.lit(new)).otherwise(x)


def ln_zero_as_one(x) -> Column:
    """natural log with 0 replaced by 1 first (so 0 → 0; not log1p)."""
    return F.ln(replace_value(x, 0.0, 1.0))


def guarded_div(x, d, zero_as: float = 1e-6) -> Column:
    """x / d with a zero divisor replaced by ``zero_as``."""
    return _c(x) / replace_value(d, 0.0, zero_as)


def basename(path) -> Column:
    """last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def stable_gene_id(gene) -> Column:
    """Gene id without its ``.version`` suffix (ENSG00000000001.5 → ENSG00000000001)."""
    return F.split(_c(gene), r"\.").getItem(0)


def to_double(x) -> Column:
    """parse text to double; unparsable → NULL."""
    return F.try_cast(_c(x), "double") if hasattr(F, "try_cast") else _c(x).try_cast("double")


def hash_rank_key(id_col, seed: int) -> Column:
    """Deterministic pseudo-random order key (D0.7): first 8 hex digits of
    md5(id || '-' || seed) as a bigint; the same formula runs in DuckDB."""
    h = F.md5(F.concat(_c(id_col).cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def round6(x) -> Column:
    return F.round(_c(x), 6)
