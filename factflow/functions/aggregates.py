"""Aggregation functions over bags; ``w`` is the weight column or None for one each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factflow.functions.values import rational


def _count(w: Column | None) -> Column:
    return F.count(F.lit(1)) if w is None else F.sum(w)


def _sum(v: Column, w: Column | None) -> Column:
    return F.sum(v if w is None else v * w)


def _median(v: Column, w: Column | None) -> Column:
    """The upper middle of the distinct values, never interpolated."""
    values = F.sort_array(F.collect_set(v))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def _avg(v: Column, w: Column | None) -> Column:
    return rational(_sum(v, w), _count(w))


def _variance(v: Column, w: Column | None) -> Column:
    """Population variance as an exact fraction."""
    n, s, q = _count(w), _sum(v, w), _sum(v * v, w)
    return rational(n * q - s * s, n * n)


AGGREGATES = {
    "MIN": lambda v, w: F.min(v),
    "MAX": lambda v, w: F.max(v),
    "MEDIAN": _median,
    "COUNT": lambda v, w: _count(w),
    "SUM": _sum,
    "AVG": _avg,
    "VARIANCE": _variance,
}
