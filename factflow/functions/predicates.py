"""Binary predicates, with an order across types."""

from __future__ import annotations

import operator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.errors import IncorrectError
from factflow.functions.values import Typed, literal_rank, type_rank

OPERATORS = {
    "LT": operator.lt, "GT": operator.gt, "LTE": operator.le, "GTE": operator.ge, "EQ": operator.eq, "NEQ": operator.ne,
}


def compare(df: DataFrame, predicate: str, left: Any, right: Any) -> Column:
    """``predicate(left, right)``; each side is ("var", column name) or
    ("const", value). Sides of different types compare by their types alone."""
    if predicate not in OPERATORS:
        raise IncorrectError(f"unknown predicate {predicate!r}")
    test = OPERATORS[predicate]
    ranks = [type_rank(df, v) if k == "var" else literal_rank(v) for k, v in (left, right)]
    if ranks[0] != ranks[1]:
        return F.lit(bool(test(*ranks)))
    a, b = (F.col(v) if k == "var" else F.lit(int(v) if isinstance(v, Typed) else v) for k, v in (left, right))
    return test(a, b)
