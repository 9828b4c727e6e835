"""Vectors as arrays of numbers; arithmetic in doubles, folded in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str, floor: float = 1e-10) -> Column:
    """v over its norm, or over ``floor`` where the norm is smaller."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / length)


def rounded(x: Column | str, digits: int = 6) -> Column:
    """x to ``digits`` digits as SQL rounds it: what rounds to zero from below is the negative zero, which F.round loses."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)
