"""Attributes: what is stored of one kind of fact, and how inputs are read.

An attribute is either read from a wide table (key column, value column) or
kept as a log of changes ``(e, v, _time, _w)`` under input semantics:

* ``Raw``: the multiplicities as they are;
* ``Distinct``: a fact is there once if its multiplicity is positive;
* ``LastWriteWins``: one value per entity, that of the last write in time; of
  writes at one time the greatest value; a retraction clears the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factflow.errors import IncorrectError
from factflow.functions.time import visible_at
from factflow.functions.values import typed
from factflow.operators.relation import WEIGHT, Relation

TIME = "_time"
SEMANTICS = ("Raw", "LastWriteWins", "Distinct")


@dataclass(frozen=True)
class AttributeConfig:
    """``trace_slack``: how many epochs of history stay readable behind the
    present (None: all). The index settings are accepted and ignored: Catalyst
    chooses how to read."""

    input_semantics: str = "Raw"
    trace_slack: int | None = None
    index_direction: str = "Forward"
    query_support: str = "Basic"
    value_type: str = "String"
    entity_type: str = "Eid"

    def __post_init__(self):
        if self.input_semantics not in SEMANTICS:
            raise IncorrectError(f"unknown input semantics {self.input_semantics!r}")

    @staticmethod
    def tx_time(semantics: str, **more: Any) -> AttributeConfig:
        return AttributeConfig(semantics, trace_slack=1, **more)

    @staticmethod
    def real_time(semantics: str, **more: Any) -> AttributeConfig:
        return AttributeConfig(semantics, trace_slack=1, **more)

    @staticmethod
    def uncompacted(semantics: str, **more: Any) -> AttributeConfig:
        return AttributeConfig(semantics, trace_slack=None, **more)

    @staticmethod
    def from_json(body: dict) -> AttributeConfig:
        slack = body.get("trace_slack")
        if isinstance(slack, dict):
            [slack] = slack.values()
            if isinstance(slack, dict):
                slack = slack["secs"]
            if isinstance(slack, list):
                slack = slack[-1]
        known = {k: body[k] for k in ("input_semantics", "index_direction", "query_support", "value_type", "entity_type") if k in body}
        return AttributeConfig(trace_slack=slack, **known)


class WideTable:
    """A table that is opened when it is first needed."""

    def __init__(self, source: DataFrame | Callable[[], DataFrame]):
        self._source = source

    @property
    def df(self) -> DataFrame:
        if callable(self._source):
            self._source = self._source()
        return self._source


@dataclass(frozen=True)
class TableAttribute:
    """A column of a wide table. ``unique``: the key is unique and not null, so
    that several attributes of the table can be read in one scan."""

    wide: WideTable
    table_id: str
    key: str
    value: Column
    unique: bool = True
    value_type: str | None = None

    @property
    def table(self) -> DataFrame:
        return self.wide.df

    def pairs(self) -> DataFrame:
        df = self.table.select(F.col(self.key).alias("e"), self.value.alias("v")).where("e IS NOT NULL AND v IS NOT NULL")
        return with_types(df, "Eid", self.value_type)


def with_types(pairs: DataFrame, entity: str | None, value: str | None) -> DataFrame:
    """(e, v[, _w]) whose columns know their value types."""
    return pairs.select(typed(F.col("e"), "e", entity), typed(F.col("v"), "v", value), *([WEIGHT] if WEIGHT in pairs.columns else []))


def snapshot_raw(changes: DataFrame) -> DataFrame:
    return changes.groupBy("e", "v").agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def snapshot_distinct(changes: DataFrame) -> DataFrame:
    return snapshot_raw(changes).where(F.col(WEIGHT) > 0).select("e", "v", F.lit(1).cast("long").alias(WEIGHT))


def _events(changes: DataFrame) -> DataFrame:
    """Writes and retractions that remain of each time."""
    return changes.groupBy("e", "v", TIME).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def snapshot_last(changes: DataFrame) -> DataFrame:
    last = _events(changes).groupBy("e").agg(F.max_by(F.struct("v", WEIGHT), F.struct(TIME, "v")).alias("last"))
    return last.where(F.col(f"last.{WEIGHT}") > 0).select("e", "last.v", F.lit(1).cast("long").alias(WEIGHT))


def last_write_diffs(changes: DataFrame) -> DataFrame:
    """(e, v, _time, _w): every write takes back the value before it at its own
    time and adds its own; a retraction takes back the stored value, whatever it
    named. A retraction of what is not there is refused."""
    w = W.partitionBy("e").orderBy(TIME, "v")
    seen = _events(changes).select(
        "e", "v", TIME, (F.col(WEIGHT) > 0).alias("adds"),
        F.lag("v").over(w).alias("old"), F.coalesce(F.lag(F.col(WEIGHT) > 0).over(w), F.lit(False)).alias("had"),
    )
    bad = ~F.col("adds") & ~F.col("had")
    seen = seen.where(F.when(bad, F.raise_error(F.lit("retraction of an entity without a value"))).otherwise(F.lit(True)))
    minus = seen.where("had").select("e", F.col("old").alias("v"), TIME, F.lit(-1).alias(WEIGHT))
    plus = seen.where("adds").select("e", "v", TIME, F.lit(1).alias(WEIGHT))
    out = minus.union(plus).groupBy("e", "v", TIME).agg(F.sum(WEIGHT).cast("long").alias(WEIGHT))
    return out.where(F.col(WEIGHT) != 0)


def snapshot_bitemporal(changes: DataFrame, event: int, system: int, last_write: bool = True) -> DataFrame:
    """Facts at ``event`` as known at ``system``, of changes with columns e, v,
    _event, _system, _w: those whose both times have come. The order of writes
    is by event time, then system time, then value."""
    seen = changes.where(visible_at(F.col("_event"), F.col("_system"), (event, system)))
    if not last_write:
        return snapshot_raw(seen)
    each = seen.groupBy("e", "v", "_event", "_system").agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
    last = each.groupBy("e").agg(F.max_by(F.struct("v", WEIGHT), F.struct("_event", "_system", "v")).alias("last"))
    return last.where(F.col(f"last.{WEIGHT}") > 0).select("e", "last.v", F.lit(1).cast("long").alias(WEIGHT))


SNAPSHOTS = {"Raw": snapshot_raw, "Distinct": snapshot_distinct, "LastWriteWins": snapshot_last}


def relation_of(df: DataFrame, e: int, v: int, weighted: bool, is_set: bool) -> Relation:
    """(e, v) pairs as variables; the same variable twice means they are equal."""
    weights = [WEIGHT] if weighted else []
    if e == v:
        return Relation(df.where("e = v").select(F.col("e").alias(f"v{e}"), *weights), (e,), weighted, is_set)
    return Relation(df.select(F.col("e").alias(f"v{e}"), F.col("v").alias(f"v{v}"), *weights), (e, v), weighted, is_set)
