"""Relations: DataFrames whose columns are variables, with optional weights.

Rows are a bag. A weighted relation has a column ``_w`` with the multiplicity,
which may be negative; an unweighted one has each row once per occurrence and
pays nothing for weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factflow.errors import IncorrectError

WEIGHT = "_w"

#: Rows of one task, in the mean at most, where many are dealt by their values.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows, dealt by all columns over so many tasks that what a task holds of
    them does not grow with their number; as they are, if the session's partitions
    are enough for that."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *df.columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def names_of(variables: tuple[int, ...]) -> list[str]:
    """Column names: ``v3``, and ``v3_2`` for a second column of one variable."""
    seen: dict[int, int] = {}
    out = []
    for v in variables:
        seen[v] = seen.get(v, 0) + 1
        out.append(f"v{v}" if seen[v] == 1 else f"v{v}_{seen[v]}")
    return out


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    variables: tuple[int, ...]
    weighted: bool = False
    is_set: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != WEIGHT]

    def column(self, variable: int) -> str:
        """The first column of a variable."""
        if variable not in self.variables:
            raise IncorrectError(f"variable {variable} is not bound; bound are {list(self.variables)}")
        return names_of(self.variables)[self.variables.index(variable)]

    def with_weights(self) -> Relation:
        if self.weighted:
            return self
        return Relation(self.df.withColumn(WEIGHT, F.lit(1).cast("long")), self.variables, True, self.is_set)

    def weight(self) -> Column | None:
        return F.col(WEIGHT) if self.weighted else None

    def rest(self) -> list[str]:
        return [WEIGHT] if self.weighted else []

    def consolidated(self) -> Relation:
        """Equal rows of a weighted relation as one; rows that cancel go."""
        if not self.weighted:
            return self
        df = self.df.groupBy(*self.columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        return Relation(df.select(*self.columns, WEIGHT), self.variables, True, self.is_set)

    def distinct(self) -> Relation:
        """Each row of positive weight once."""
        if not self.weighted:
            return self if self.is_set else Relation(self.df.distinct(), self.variables, False, True)
        df = self.consolidated().df.where(F.col(WEIGHT) > 0).drop(WEIGHT)
        return Relation(df, self.variables, False, True)

    def renamed(self, variables: tuple[int, ...]) -> Relation:
        """The same columns under other variables, by position."""
        if len(variables) != len(self.columns):
            raise IncorrectError(f"{len(self.columns)} columns can't be named {list(variables)}")
        df = self.df.select(*(F.col(a).alias(b) for a, b in zip(self.columns, names_of(variables), strict=True)), *self.rest())
        return Relation(df, tuple(variables), self.weighted, self.is_set)


def alike(*relations: Relation) -> list[Relation]:
    """All weighted if one is."""
    if any(r.weighted for r in relations):
        return [r.with_weights() for r in relations]
    return list(relations)
