"""Small helpers on arrays of samples."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_at_least(values: list[float], limit: float) -> int:
    """The first index of a rising list whose value reaches ``limit``."""
    at = bisect_left(values, limit)
    if at == len(values):
        raise ValueError(f"no value reaches {limit}")
    return at


def doubles(values) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def argmax(a: Column) -> Column:
    """The first 0-based index of the largest value."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
