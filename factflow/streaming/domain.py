"""Domains: attributes, logical time, rules, and results over time.

Change-backed attributes keep a log ``(e, v, _time, _w)``. A snapshot at an epoch
reads the log up to it under the attribute's input semantics. Late data is
refused; data dated ahead is kept and shows when its epoch is reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.errors import ConflictError, IncorrectError, NotFoundError
from factflow.functions.values import SPARK_TYPE, decode
from factflow.operators.attributes import SNAPSHOTS, TIME, AttributeConfig, TableAttribute, WideTable, last_write_diffs, snapshot_raw, with_types
from factflow.operators.relation import WEIGHT, Relation
from factflow.plans.ast import Plan, Rule
from factflow.plans.compile import Compiler, Source
from factflow.storage import settle


@dataclass(frozen=True)
class Datom:
    """A fact's addition (diff 1) or retraction (diff -1); ``t`` None: now."""

    e: Any
    a: str
    v: Any
    t: int | None = None
    diff: int = 1

    @staticmethod
    def add(e: Any, a: str, v: Any) -> Datom:
        return Datom(e, a, v)

    @staticmethod
    def add_at(e: Any, a: str, v: Any, t: int) -> Datom:
        return Datom(e, a, v, t)

    @staticmethod
    def retract(e: Any, a: str, v: Any) -> Datom:
        return Datom(e, a, v, None, -1)

    @staticmethod
    def retract_at(e: Any, a: str, v: Any, t: int) -> Datom:
        return Datom(e, a, v, t, -1)

    @staticmethod
    def from_json(body: list) -> Datom:
        e, a, v, t, diff = body
        e = e if isinstance(e, int) else decode(e)[1]
        if isinstance(t, dict):
            [t] = t.values()
        return Datom(e, a, decode(v)[1], t, diff)


class ChangeLog:
    """An attribute's changes: DataFrames, and rows that wait to become one."""

    def __init__(self, spark: SparkSession, config: AttributeConfig):
        self.spark, self.config = spark, config
        self.schema = T.StructType([
            T.StructField("e", SPARK_TYPE[config.entity_type]), T.StructField("v", SPARK_TYPE[config.value_type]),
            T.StructField(TIME, T.LongType()), T.StructField(WEIGHT, T.LongType()),
        ])
        self.frames: list[DataFrame] = []
        self.rows: list[tuple] = []
        self.retracted = False  # since the last check
        self.since = 0  # history before this epoch is folded into it
        self.closed = False

    def append(self, rows: Iterable[tuple]) -> None:
        rows = list(rows)
        self.retracted |= any(r[3] < 0 for r in rows)
        self.rows += rows

    def check(self) -> None:
        """Refuse retractions of last-write-wins entities that have no value."""
        if self.retracted and self.config.input_semantics == "LastWriteWins":
            changes = self.changes()
            touched = changes.where(F.col(WEIGHT) < 0).select("e").distinct()
            try:
                last_write_diffs(changes.join(touched, "e", "left_semi")).write.format("noop").mode("overwrite").save()
            except PySparkException as e:
                if "without a value" in str(e):
                    raise IncorrectError("retraction of an entity without a value") from None
                raise
        self.retracted = False

    def append_frame(self, df: DataFrame) -> None:
        self.frames.append(df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)))

    def changes(self) -> DataFrame:
        if self.rows:
            self.frames.append(self.spark.createDataFrame(self.rows, self.schema))
            self.rows = []
        if not self.frames:
            return self.spark.createDataFrame([], self.schema)
        df = self.frames[0]
        for f in self.frames[1:]:
            df = df.union(f)
        return df

    def snapshot(self, epoch: int, touched: DataFrame | None = None) -> DataFrame:
        """The facts at an epoch; with ``touched`` (e), of these entities, whose
        changes alone are read."""
        if epoch < self.since:
            raise ConflictError(f"history before epoch {self.since} was compacted")
        changes = self.changes().where(F.col(TIME) <= epoch)
        if touched is not None:
            changes = changes.join(touched, "e", "left_semi")
        return SNAPSHOTS[self.config.input_semantics](changes)

    def diffs(self) -> DataFrame:
        """(e, v, _time, _w): what each epoch adds to and takes from the facts."""
        changes = self.changes()
        if self.config.input_semantics == "LastWriteWins":
            return last_write_diffs(changes)
        if self.config.input_semantics == "Raw":
            return changes.groupBy("e", "v", TIME).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        from pyspark.sql import Window as W

        each = changes.groupBy("e", "v", TIME).agg(F.sum(WEIGHT).alias(WEIGHT))
        total = F.sum(WEIGHT).over(W.partitionBy("e", "v").orderBy(TIME).rowsBetween(W.unboundedPreceding, 0))
        there = each.select("e", "v", TIME, (total > 0).cast("long").alias("now"))
        before = F.lag("now", 1, 0).over(W.partitionBy("e", "v").orderBy(TIME))
        return there.select("e", "v", TIME, (F.col("now") - before).alias(WEIGHT)).where(F.col(WEIGHT) != 0)

    def compact(self, epoch: int) -> None:
        """Fold what is before ``epoch`` into the facts at it."""
        if epoch <= self.since:
            return
        changes = self.changes()
        base = SNAPSHOTS[self.config.input_semantics](changes.where(F.col(TIME) <= epoch))
        later = changes.where(F.col(TIME) > epoch)
        if self.config.input_semantics == "Distinct":
            # a surplus of additions still counts against later retractions
            base = snapshot_raw(changes.where(F.col(TIME) <= epoch))
        df = base.select("e", "v", F.lit(epoch).cast("long").alias(TIME), F.col(WEIGHT).cast("long").alias(WEIGHT)).union(later)
        self.frames, self.since = [settle(df)], epoch


class Domain:
    """Attributes and rules that share a time."""

    def __init__(self, spark: SparkSession, namespace: str = "", set_mode: bool = False):
        self.spark, self.namespace, self.set_mode = spark, namespace, set_mode
        self.epoch = 0
        self.logs: dict[str, ChangeLog] = {}
        self.tables: dict[str, TableAttribute] = {}
        self.derived: dict[str, tuple[WideTable, bool]] = {}
        self.views: dict[str, Callable[[Compiler], DataFrame]] = {}
        self.rules: dict[str, Rule] = {}
        self.inputs: dict[str, int] = {}  # how far each named input is

    # -- attributes ------------------------------------------------------------
    def _check_new(self, name: str) -> None:
        if self.has(name):
            raise ConflictError(f"attribute {name!r} exists")

    def create_attribute(self, name: str, config: AttributeConfig | None = None) -> None:
        self._check_new(name)
        self.logs[name] = ChangeLog(self.spark, config or AttributeConfig())

    def add_table(self, table_id: str, df: DataFrame | Callable[[], DataFrame], key: str, attributes: dict[str, Column | str], unique: bool = True,
                  types: dict[str, str] | None = None) -> None:
        """Columns of a wide table as attributes of its key's entities; the table
        may be given as a function that opens it. ``types``: value types of
        attributes whose Spark type does not tell them (Eid, Instant)."""
        wide = WideTable(df)
        for name, value in attributes.items():
            self._check_new(name)
            column = F.col(value) if isinstance(value, str) else value
            self.tables[name] = TableAttribute(wide, table_id, key, column, unique, (types or {}).get(name))

    def add_derived(self, name: str, pairs: DataFrame | Callable[[], DataFrame], weighted: bool = False) -> None:
        """Facts made elsewhere: (e, v), each once, or with weights ``_w``."""
        self._check_new(name)
        self.derived[name] = (WideTable(pairs), weighted)

    def add_view(self, name: str, pairs: Callable[[Compiler], DataFrame]) -> None:
        """An attribute whose (e, v) follow from others at every epoch."""
        self._check_new(name)
        self.views[name] = pairs

    def has(self, name: str) -> bool:
        return any(name in kind for kind in (self.logs, self.tables, self.derived, self.views))

    def log(self, name: str) -> ChangeLog:
        if name not in self.logs:
            raise NotFoundError(f"no attribute {name!r} to transact upon")
        return self.logs[name]

    # -- time ------------------------------------------------------------------
    def transact(self, datoms: Iterable[Datom]) -> None:
        """All or nothing: every datom is checked before one is kept."""
        datoms = list(datoms)
        for d in datoms:
            log = self.log(d.a)
            if log.closed:
                raise ConflictError(f"attribute {d.a!r} is closed")
            if d.t is not None and d.t < self.epoch:
                raise ConflictError(f"datom at {d.t} is late: the epoch is {self.epoch}")
            if d.v is None or d.e is None:
                raise IncorrectError("a fact has an entity and a value")
        kept = {d.a: (len(self.logs[d.a].rows), self.logs[d.a].retracted) for d in datoms}
        for d in datoms:
            self.logs[d.a].append([(d.e, d.v, self.epoch if d.t is None else d.t, d.diff)])
        for a, (n, before) in kept.items():
            log = self.logs[a]
            frames = len(log.frames)
            try:
                log.check()
            except IncorrectError:
                for b, (m, was) in kept.items():
                    other = self.logs[b]
                    if b == a and len(other.frames) > frames:
                        other.rows = [tuple(r) for r in other.frames.pop().collect()]
                    other.rows, other.retracted = other.rows[:m], was
                raise

    def transact_frame(self, name: str, changes: DataFrame) -> None:
        """Many changes of one attribute: columns e, v and optionally _time, _w."""
        if TIME not in changes.columns:
            changes = changes.withColumn(TIME, F.lit(self.epoch).cast("long"))
        elif changes.where(F.col(TIME) < self.epoch).limit(1).count():
            raise ConflictError(f"changes are late: the epoch is {self.epoch}")
        if WEIGHT not in changes.columns:
            changes = changes.withColumn(WEIGHT, F.lit(1).cast("long"))
        self.log(name).append_frame(changes)

    def advance_epoch(self, to: int) -> None:
        if to < self.epoch:
            raise ConflictError(f"epoch {self.epoch} can't go back to {to}")
        if self.inputs and to > (least := min(self.inputs.values())):
            raise ConflictError(f"an open input is at {least} only")
        self.epoch = to

    def open_input(self, name: str) -> None:
        """A source of its own pace: while it is open, the domain does not go
        beyond it."""
        if name in self.inputs:
            raise ConflictError(f"input {name!r} is open")
        self.inputs[name] = self.epoch

    def advance_input(self, name: str, to: int) -> int:
        """An input has told everything before ``to``; returns the domain's
        epoch, the least of its open inputs."""
        if name not in self.inputs:
            raise NotFoundError(f"no open input {name!r}")
        if to < self.inputs[name]:
            raise ConflictError(f"input {name!r} is at {self.inputs[name]} and can't go back to {to}")
        self.inputs[name] = to
        return self._follow()

    def close_named_input(self, name: str) -> int:
        """It tells nothing more and holds the domain back no longer; the epoch
        goes on to the least of those that are left, or stays if none is."""
        if self.inputs.pop(name, None) is None:
            raise NotFoundError(f"no open input {name!r}")
        return self._follow()

    def _follow(self) -> int:
        if self.inputs:
            self.advance_epoch(max(self.epoch, min(self.inputs.values())))
        return self.epoch

    def advance(self) -> None:
        """Compact what no one may read again."""
        for log in self.logs.values():
            if log.config.trace_slack is not None and len(log.frames) + bool(log.rows) > 16:
                log.compact(max(0, self.epoch - log.config.trace_slack))

    def close_input(self, name: str) -> None:
        self.log(name).closed = True

    def dominates(self, other: Domain) -> bool:
        return self.epoch >= other.epoch

    def __add__(self, other: Domain) -> Domain:
        """Both domains' attributes at the earlier epoch."""
        if self.namespace != other.namespace:
            raise IncorrectError("domains of different namespaces don't add up")
        out = Domain(self.spark, self.namespace, self.set_mode)
        out.epoch = min(self.epoch, other.epoch)
        if set(self.inputs) & set(other.inputs):
            raise ConflictError(f"both domains have the inputs {sorted(set(self.inputs) & set(other.inputs))}")
        out.inputs = self.inputs | other.inputs
        for kind in ("logs", "tables", "derived", "views", "rules"):
            a, b = getattr(self, kind), getattr(other, kind)
            if set(a) & set(b):
                raise ConflictError(f"both domains have {sorted(set(a) & set(b))}")
            setattr(out, kind, a | b)
        return out

    # -- rules -----------------------------------------------------------------
    def register(self, *rules: Rule) -> None:
        for r in rules:
            known = self.rules.get(r.name)
            if known is not None and known.plan != r.plan:
                raise ConflictError(f"rule {r.name!r} is registered with another plan")
        self.rules.update({r.name: r for r in rules})

    def source(self, epoch: int | None = None) -> Source:
        epoch = self.epoch if epoch is None else epoch
        held: dict[str, tuple[DataFrame, bool]] = {}

        def pairs(name: str) -> tuple[DataFrame, bool]:
            if name not in held:
                if name in self.tables:
                    held[name] = (self.tables[name].pairs(), False)
                elif name in self.logs:
                    log = self.logs[name]
                    raw = log.config.input_semantics == "Raw"
                    df = log.snapshot(epoch)
                    held[name] = (with_types(df if raw else df.select("e", "v"), log.config.entity_type, log.config.value_type), raw)
                elif name in self.views:
                    held[name] = (self.views[name](Compiler(made, self.rules, self.set_mode)), False)
                else:
                    pairs_of, weighted = self.derived[name]
                    held[name] = (pairs_of.df, weighted)
            return held[name]

        made = Source(pairs, self.tables.get)
        return made

    def compiler(self, epoch: int | None = None) -> Compiler:
        return Compiler(self.source(epoch), self.rules, self.set_mode)

    def query(self, plan: Plan | str, epoch: int | None = None) -> Relation:
        """A plan's or a rule's tuples at an epoch."""
        c = self.compiler(epoch)
        return c.rule(plan) if isinstance(plan, str) else c.plan(plan)

    def diffs(self, plan: Plan | str, epoch: int) -> DataFrame:
        """(columns, _time, _diff): how the result changed from the epoch before
        (from nothing, at epoch 0), by evaluating both."""
        new = self.query(plan, epoch).with_weights()
        if epoch == 0:
            old = None
        else:
            old = self.query(plan, epoch - 1).with_weights()
        df = new.df
        if old is not None:
            df = df.union(old.df.withColumn(WEIGHT, -F.col(WEIGHT)))
        df = df.groupBy(*new.columns).agg(F.sum(WEIGHT).cast("long").alias("_diff")).where(F.col("_diff") != 0)
        return df.select(*new.columns, F.lit(epoch).cast("long").alias(TIME), "_diff")
