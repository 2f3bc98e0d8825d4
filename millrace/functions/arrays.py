"""Folds over token-level arrays, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    """Sum of an array; 0.0 for an empty one."""
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v.cast("double"))


def masked_sum(x: Column | str, mask: Column | str) -> Column:
    return total(F.zip_with(col(x), col(mask), lambda v, m: v * m))


def zip3(a, b, c, f) -> Column:
    """``f`` over three arrays of one length."""
    return F.transform(F.arrays_zip(col(a).alias("a"), col(b).alias("b"), col(c).alias("c")), lambda x: f(x["a"], x["b"], x["c"]))


def spread(value: Column | str, mask: Column | str) -> Column:
    """A row's value on each of its unmasked tokens, 0 elsewhere."""
    return F.transform(col(mask), lambda m: col(value) * m)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)
