"""Scalar functions of ``Transform``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from factflow.errors import IncorrectError

#: Interval names and their milliseconds.
INTERVALS = {":minute": 60_000, ":hour": 3_600_000, ":day": 86_400_000, ":week": 604_800_000}


def truncate(columns: list[Column], constants: list[Any]) -> Column:
    """Milliseconds floored to an interval counted from the epoch (a week begins
    on a Thursday, unlike a calendar week)."""
    name = constants[1] if len(constants) > 1 and constants[1] is not None else ":hour"
    if name not in INTERVALS:
        raise IncorrectError(f"unknown interval {name!r}")
    [t] = columns[:1]
    return t - F.pmod(t, F.lit(INTERVALS[name]))


def add(columns: list[Column], constants: list[Any]) -> Column:
    total = sum((c for c in constants if c is not None), 0)
    out = F.lit(total).cast("long")
    for c in columns:
        out = out + c
    return out


def subtract(columns: list[Column], constants: list[Any]) -> Column:
    """The first constant if it is set, else the first variable, minus all else."""
    if constants and constants[0] is not None:
        out, rest = F.lit(constants[0]).cast("long"), columns
        less = constants[1:]
    else:
        out, rest = columns[0], columns[1:]
        less = constants
    for c in rest:
        out = out - c
    return out - F.lit(sum((c for c in less if c is not None), 0)).cast("long")


FUNCTIONS = {"TRUNCATE": truncate, "ADD": add, "SUBTRACT": subtract}
