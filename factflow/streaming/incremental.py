"""Changes of a result from changes of its inputs.

Linear operators apply to the change itself. A join's change is
``dL x new R + old L x dR``; an n-way join's is one such product per binding,
with the new state before it and the old one after it. Grouping operators
(aggregate, union, antijoin) are evaluated again for the affected keys alone.
What has no such rule (recursion, pulls, not-bindings) is evaluated at both
epochs and subtracted.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.operators import algebra
from factflow.operators.attributes import TIME, relation_of, snapshot_raw, with_types
from factflow.operators.hector import hector
from factflow.operators.relation import WEIGHT, Relation, names_of
from factflow.plans import analyze
from factflow.plans.ast import (
    Aggregate,
    Antijoin,
    AttributeBinding,
    Filter,
    Hector,
    Join,
    MatchA,
    MatchAV,
    MatchEA,
    NameExpr,
    Negate,
    NotBinding,
    Plan,
    Project,
    Star,
    Transform,
    Union,
)
from factflow.plans.compile import Compiler
from factflow.streaming.domain import ChangeLog, Domain


def minus(new: Relation, old: Relation) -> Relation:
    a, b = new.with_weights(), old.with_weights()
    df = a.df.union(b.df.withColumn(WEIGHT, -F.col(WEIGHT)))
    return Relation(df, a.variables, True).consolidated()


class Incremental:
    """Between the epochs ``epoch - 1`` (old) and ``epoch`` (new)."""

    def __init__(self, domain: Domain, epoch: int):
        self.domain, self.epoch = domain, epoch
        self.old, self.new = domain.compiler(epoch - 1), domain.compiler(epoch)
        self._pairs: dict[str, DataFrame] = {}

    def pair_delta(self, name: str) -> DataFrame:
        """(e, v, _w) of an attribute's change. Tables do not change; a log's
        facts are compared for the entities that the epoch touched, a view's whole."""
        if name not in self._pairs:
            log = self.domain.logs.get(name)
            if name in self.domain.views:
                new, old = (c.source.pairs(name)[0] for c in (self.new, self.old))
                df = new.withColumn(WEIGHT, F.lit(1).cast("long")).union(old.withColumn(WEIGHT, F.lit(-1).cast("long")))
                self._pairs[name] = df.groupBy("e", "v").agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
            elif log is None:
                df, weighted = self.new.source.pairs(name)
                self._pairs[name] = (df if weighted else df.withColumn(WEIGHT, F.lit(1).cast("long"))).where(F.lit(False))
            else:
                self._pairs[name] = with_types(self._log_delta(log), log.config.entity_type, log.config.value_type)
        return self._pairs[name]

    def _log_delta(self, log: ChangeLog) -> DataFrame:
        now = log.changes().where(F.col(TIME) == self.epoch)
        if log.config.input_semantics == "Raw" and self.epoch > log.since:
            return snapshot_raw(now)  # multiplicities add up: the change is what the epoch wrote
        touched = now.select("e").distinct()
        new, old = log.snapshot(self.epoch, touched), log.snapshot(self.epoch - 1, touched)
        df = new.select("e", "v", WEIGHT).union(old.select("e", "v", (-F.col(WEIGHT)).alias(WEIGHT)))
        return df.groupBy("e", "v").agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)

    @staticmethod
    def _weighted(pairs: tuple[DataFrame, bool]) -> DataFrame:
        df, weighted = pairs
        return df if weighted else df.withColumn(WEIGHT, F.lit(1).cast("long"))

    def _fallback(self, plan: Plan) -> Relation:
        return minus(self.new.plan(plan), self.old.plan(plan))

    def delta(self, plan: Plan) -> Relation:
        """The weighted change of a plan's result."""
        match plan:
            case MatchA(e, a, v):
                return relation_of(self.pair_delta(a), e, v, True, False)
            case MatchEA(e, a, v):
                df = self.pair_delta(a).where(F.col("e") == F.lit(e))
                return Relation(df.select(F.col("v").alias(f"v{v}"), WEIGHT), (v,), True)
            case MatchAV(e, a, value):
                df = self.pair_delta(a).where(F.col("v") == F.lit(value))
                return Relation(df.select(F.col("e").alias(f"v{e}"), WEIGHT), (e,), True)
            case Project(variables, inner):
                return algebra.project(self.delta(inner), variables)
            case Filter(variables, predicate, inner, constants):
                return algebra.select(self.delta(inner), variables, predicate, constants)
            case Negate(inner):
                return algebra.negate(self.delta(inner))
            case Transform(variables, result, inner, function, constants):
                return algebra.transform(self.delta(inner), variables, result, function, constants)
            case NameExpr(variables, name):
                component = next(c for c in analyze.components([name], self.domain.rules) if name in c)
                if analyze.is_recursive(component, self.domain.rules):
                    return self._fallback(plan)
                return self.delta(self.domain.rules[name].plan).renamed(tuple(variables))
            case Join(keys, left, right):
                return self._join(keys, left, right)
            case Hector(variables, bindings):
                return self._hector(plan)
            case Union(variables, plans):
                touched = algebra.concat([algebra.project(self.delta(p), variables) for p in plans])
                return self._again(plan, touched, tuple(variables), [(p, tuple(variables)) for p in plans])
            case Antijoin(keys, left, right):
                touched = algebra.concat([algebra.project(self.delta(p), keys) for p in (left, right)])
                return self._again(plan, touched, tuple(keys), [(left, None), (right, None)])
            case Aggregate(key_variables=keys):
                change = self.delta(plan.plan)
                return self._again(plan, algebra.project(change, tuple(keys)), tuple(keys), [(plan.plan, None)], change)
            case Star():
                return self._fallback(plan)
        return self._fallback(plan)

    def _join(self, keys, left: Plan, right: Plan) -> Relation:
        swap = isinstance(left, (MatchA, Star)) and not isinstance(right, (MatchA, Star))
        if swap:
            left, right = right, left
        dl, dr = self.delta(left), self.delta(right)
        a = algebra.join(dl, self.new.plan(right), tuple(keys))
        b = algebra.join(self.old.plan(left), dr, tuple(keys))
        return algebra.concat([a, b]).consolidated()

    def _hector(self, plan: Hector) -> Relation:
        if any(isinstance(b, NotBinding) for b in plan.bindings):
            return self._fallback(plan)
        own = [b for b in plan.bindings if isinstance(b, AttributeBinding)]
        parts = []
        for i in range(len(own)):
            def resolve(k: int, b: AttributeBinding, i: int = i) -> Relation:
                if k == i:
                    log = self.domain.logs.get(b.attribute)
                    if log is not None and log.config.input_semantics != "Raw" or b.attribute in self.domain.tables and self.domain.tables[b.attribute].unique:
                        return relation_of(self.pair_delta(b.attribute), b.e, b.v, True, False)  # a set's change as it is
                    return minus(self._set(self.new, b), self._set(self.old, b))
                return self._set(self.new if k < i else self.old, b)

            parts.append(hector(plan.variables, plan.bindings, resolve, lambda _: None, {i}))
        return algebra.concat(parts).consolidated()

    @staticmethod
    def _set(c: Compiler, b: AttributeBinding) -> Relation:
        return c.attribute(b.attribute, b.e, b.v, as_set=True)

    def _again(self, plan: Plan, touched: Relation, keys: tuple[int, ...], inputs, change: Relation | None = None) -> Relation:
        """The plan over the touched keys' rows of its inputs, new minus old.
        ``change``: of a single input; its new rows are the old ones and these."""
        if not keys:
            return self._fallback(plan)
        own = touched.df.select(*names_of(keys)).distinct()

        def side(c: Compiler) -> Relation:
            made = []
            for p, project_to in inputs:
                r = c.plan(p)
                if project_to is not None:
                    r = algebra.project(r, project_to)
                df = r.df.join(own, names_of(keys), "left_semi").select(*r.df.columns)
                made.append(Relation(df, r.variables, r.weighted, r.is_set))
            return apply(c, made)

        def apply(c: Compiler, made: list[Relation]) -> Relation:
            match plan:
                case Union(variables, _):
                    return algebra.union(made, variables)
                case Antijoin(k, _, _):
                    return algebra.antijoin(made[0], made[1], tuple(k))
                case Aggregate():
                    return algebra.aggregate(made[0], plan.variables, plan.aggregation_fns, plan.key_variables,
                                             plan.aggregation_variables, plan.with_variables, c.set_mode)
            raise AssertionError(plan)

        if change is None:
            return minus(side(self.new), side(self.old))
        [(p, _)] = inputs
        r = self.old.plan(p).with_weights()
        old = Relation(r.df.join(own, names_of(keys), "left_semi").select(*r.df.columns), r.variables, True)
        new = algebra.concat([old, Relation(change.df.select(*r.df.columns), r.variables, True)])
        return minus(apply(self.new, [new]), apply(self.old, [old]))


def epoch_diffs(domain: Domain, plan: Plan | str, epoch: int) -> DataFrame:
    """(columns, _time, _diff) of an epoch, propagated from the inputs' changes;
    at epoch 0 everything is new."""
    if epoch == 0:
        return domain.diffs(plan, 0)
    if isinstance(plan, str):
        plan = domain.rules[plan].plan if not _recursive(domain, plan) else NameExpr(tuple(range(len(domain.query(plan, epoch).columns))), plan)
    r = Incremental(domain, epoch).delta(plan).with_weights().consolidated()
    return r.df.select(*r.columns, F.lit(epoch).cast("long").alias(TIME), F.col(WEIGHT).cast("long").alias("_diff"))


def _recursive(domain: Domain, name: str) -> bool:
    component = next(c for c in analyze.components([name], domain.rules) if name in c)
    return analyze.is_recursive(component, domain.rules)


