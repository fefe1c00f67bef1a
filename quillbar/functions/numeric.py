"""Numeric column helpers. Missing results are NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(top, bottom)


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded value without a negative zero, for comparing results across engines."""
    return F.when(F.abs(value) < 0.5 * 10.0 ** -digits, 0.0).otherwise(F.round(value, digits))


def tidy_columns(df, columns, digits: int = 6):
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


def power(base: Column, exponent: Column) -> Column:
    """``base ** exponent``; NULL where it is undefined."""
    return finite(F.pow(base, exponent))


def hash_int(*parts) -> Column:
    """A uniform integer in ``[0, 2**32)`` from the MD5 of the parts joined by ``:``."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A uniform double in ``[0, 1)`` that depends on the parts only, not on partitioning."""
    return hash_int(*parts) / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """A standard normal double (Box-Muller) that depends on the parts only."""
    spread = F.sqrt(-2.0 * F.ln(1.0 - uniform(*parts, "r")))
    return spread * F.cos(2.0 * F.pi() * uniform(*parts, "a"))
