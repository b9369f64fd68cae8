"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Remove all leading and trailing whitespace (``trim`` only removes blanks)."""
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r"))


def flag_active(c: Column) -> Column:
    """1 unless the promotion code is exactly '0'; a missing code counts as active."""
    return F.when(stripped(c) == "0", 0).otherwise(1)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is 0 or missing."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def discount_rate(sales: Column, discount: Column) -> Column:
    """|discount| / (sales + |discount|), 0 where the gross value is 0."""
    off = F.abs(discount)
    return F.coalesce(F.try_divide(off, sales + off), F.lit(0.0))


def hash_uniform(*parts: str | int | Column) -> Column:
    """A uniform number in [0, 1) that depends on the given parts only.

    Retries, partitioning and row order cannot change it, unlike ``rand(seed)``; the first 32 bits
    of an md5 digest give the same value in any SQL engine.
    """
    return F.conv(hash_digits(*parts), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_digits(*parts: str | int | Column) -> Column:
    """The 32 bits of ``hash_uniform`` as eight hexadecimal digits, which sort as the numbers do."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8)


def digits_below(digits: Column, bound: float) -> Column:
    """Whether the uniform of these digits is below ``bound`` in (0, 1): the same rows as ``hash_uniform(...) < bound``, no number made."""
    return digits < F.lit(f"{math.ceil(bound * 2**32):08x}")


def normal_draw(*parts: str | int | Column) -> Column:
    """A standard normal number from two hash uniforms (Box-Muller)."""
    u1 = hash_uniform(*parts, "a")
    u2 = hash_uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalised(v: Column) -> Column:
    """Vector divided by its length as DOUBLE; an all-zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def standardised(df: DataFrame, c: Column, ddof: int = 0) -> Column:
    """(x - mean) / (std + 1e-8) with the moments of ``df`` as a scalar subquery."""
    std = F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c)
    m = df.agg(F.struct(F.avg(c).alias("mean"), std.alias("std")).alias("m")).scalar()
    return (c - m["mean"]) / (m["std"] + F.lit(1e-8))


def edge_weight(weight_type: str, w: Column) -> Column:
    """Edge weight to use; 'binary' counts every non-zero edge once."""
    if weight_type == "edge_weight":
        return w
    if weight_type == "binary":
        return F.when(w != 0, F.lit(1.0)).otherwise(F.lit(0.0))
    raise ValueError(f"weight_type must be 'binary' or 'edge_weight', got {weight_type!r}")
