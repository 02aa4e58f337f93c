"""Logical time: coarsening, rewinding, and pairs in two dimensions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from factflow.errors import IncorrectError


def coarsen(t: int, window: int) -> int:
    """The end of the tumbling window that ``t`` is in: always after ``t``."""
    return (t // window + 1) * window


def coarsen_column(t: Column, window: int) -> Column:
    return t - F.pmod(t, F.lit(window)) + window


def coarsen_duration(t: timedelta, window: timedelta) -> timedelta:
    """Seconds are coarsened by the window's whole seconds. Windows with a part
    of a second beside whole seconds have no agreed meaning and are refused."""
    if window.microseconds and window >= timedelta(seconds=1):
        raise IncorrectError("a window is either whole seconds or less than one")
    if window >= timedelta(seconds=1):
        whole = int(window.total_seconds())
        return timedelta(seconds=coarsen(int(t.total_seconds()), whole))
    unit = timedelta(microseconds=1)
    return coarsen(t // unit, window // unit) * unit


def rewind(t, by):
    """``t - by``, or ``t`` itself where that would be before the beginning."""
    return t - by if t >= by else t


def rewind_column(t: Column, by: Column | int) -> Column:
    return F.when(t >= by, t - by).otherwise(t)


def pair_before(a: tuple, b: tuple) -> bool:
    """The product order: both parts are at most the other's."""
    return a[0] <= b[0] and a[1] <= b[1]


def pair_join(a: tuple, b: tuple) -> tuple:
    return max(a[0], b[0]), max(a[1], b[1])


def pair_meet(a: tuple, b: tuple) -> tuple:
    return min(a[0], b[0]), min(a[1], b[1])


def visible_at(event: Column, system: Column, at: tuple[int, int]) -> Column:
    """Facts of two-dimensional time that are known at ``at``."""
    return (event <= at[0]) & (system <= at[1])
