"""Plans to DataFrames; recursive rules to fixpoints.

Non-recursive rules are compiled once and shared. Mutually recursive rules are
evaluated together, semi-naively: each round joins only what the last round
found new against everything known, and ends when nothing new is found. Rounds
are written to the shared folder; a round's rows are put together with those of
the rounds before while these are not much more, and what was put together is
deleted. So what is known is read from a number of folders that grows with the
logarithm of its size, and every row is written as often at most. Recursions that
ask for walks over many edges (``chains``) are made over classes of nodes that
reach each other, and their pairs are written as blocks of lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.errors import FaultError, IncorrectError, NotFoundError
from factflow.operators import algebra, pull, reach
from factflow.operators.attributes import TableAttribute, relation_of
from factflow.operators.hector import hector, star
from factflow.operators.relation import WEIGHT, Relation
from factflow.plans import analyze
from factflow.plans.ast import (
    Aggregate,
    Antijoin,
    AttributeBinding,
    Filter,
    GraphQl,
    Hector,
    Join,
    MatchA,
    MatchAV,
    MatchEA,
    NameExpr,
    Negate,
    Plan,
    Project,
    Pull,
    PullAll,
    PullLevel,
    Rule,
    Star,
    Transform,
    Union,
)
from factflow.plans.chains import Chains, chains_of
from factflow.plans.graphql import to_pull
from factflow.plans.rewrite import collapse_stars
from factflow.storage import discard, settle

MAX_ROUNDS = 10_000
#: Walks over fewer edges are made round by round: that takes fewer jobs.
CLASS_EDGES = 10_000
#: Of one row in one piece, where weights become repeated rows.
COPIES = 65_536


@dataclass
class Source:
    """Where attributes come from. ``pairs(name)``: (e, v[, _w]) and whether it
    has weights; ``table(name)``: its wide table or None."""

    pairs: Callable[[str], tuple[DataFrame, bool]]
    table: Callable[[str], TableAttribute | None]


class Compiler:
    def __init__(self, source: Source, rules: dict[str, Rule] | None = None, set_mode: bool = False, classes: bool = True):
        self.source, self.rules, self.set_mode, self.classes = source, rules or {}, set_mode, classes
        self.made: dict[str, Relation] = {}
        # of the recursion that is being evaluated: everything known, and the last round's news
        self._known: dict[str, Relation | None] = {}
        self._news: dict[str, Relation | None] = {}
        self._held: dict[str, tuple[DataFrame, bool]] = {}
        self._focus: int | None = None
        self._seen = 0
        self._tiers: dict[str, list[tuple[int, DataFrame]]] = {}  # (rows, frame) of what is known, the largest first
        self.tiers: dict[str, list[tuple[int, DataFrame]]] = {}  # those of the last recursion that is done
        self._sizes: dict[str, int] = {}
        self._read: dict[str, list[DataFrame]] = {}

    # -- rules -----------------------------------------------------------------
    def rule(self, name: str) -> Relation:
        """A rule's tuples, columns by position."""
        if name not in self.made:
            names = analyze.closure(name, self.rules, self._has)
            for component in analyze.components(names, self.rules):
                if component[0] in self.made:
                    continue
                if analyze.is_recursive(component, self.rules):
                    analyze.check_strata(component, self.rules)
                    self._fixpoint(component)
                else:
                    self._plain(component[0])
        return self.made[name]

    def _has(self, attribute: str) -> bool:
        try:
            self.source.pairs(attribute)
        except KeyError:
            return False
        return True

    def _plain(self, name: str) -> None:
        r = self.plan(self.rules[name].plan)
        self.made[name] = r.distinct() if self.set_mode else r.consolidated()

    def _fixpoint(self, component: list[str]) -> None:
        chains = chains_of({n: self.rules[n].plan for n in component}) if self.classes else None
        if chains is not None and self._walks(component, chains):
            return
        plans = {n: self._prepared(self.rules[n].plan) for n in component}
        uses = {n: _count(plans[n], component) for n in component}
        self._known = dict.fromkeys(component)
        self._news = dict.fromkeys(component)
        self._tiers = {n: [] for n in component}
        self._hold(component)
        for turn in range(MAX_ROUNDS):
            found: dict[str, Relation | None] = {}
            for n in component:
                parts = []
                for focus in range(uses[n]) if turn else [None]:
                    r = self._evaluate(plans[n], focus)
                    if r is not None:
                        parts.append(_positional(r.distinct()))
                found[n] = self._new_rows(n, parts)
            for n in component:
                self._news[n] = found[n]
                if found[n] is not None:
                    self._known[n] = self._with(n, found[n])
            if not any(found.values()):
                break
        else:
            raise FaultError(f"no fixpoint of {component} in {MAX_ROUNDS} rounds")
        for n in component:
            if self._known[n] is None:
                raise IncorrectError(f"rule {n!r} has no case to begin with, so its columns have no type")
            self.made[n] = self._known[n]
        self._known, self._news, self._focus = {}, {}, None
        for df, _ in self._held.values():
            df.unpersist()  # the results are written out and need it no more
        for df in (df for frames in self._read.values() for df in frames):
            discard(df)
        self.tiers = self._tiers
        self._held, self._tiers, self._read = {}, {}, {}

    def _walks(self, component: list[str], chains: Chains) -> bool:
        """Make rules that ask for walks from the classes of their nodes; False if
        the nodes are no integers or the edges are few."""
        relations = {a: self.attribute(a, 0, 1) for a in chains.attributes()}
        fields = [f for r in relations.values() for f in r.df.schema.fields]
        if any(r.weighted for r in relations.values()) or any(f.dataType.typeName() not in ("integer", "long") for f in fields):
            return False
        if any(len({(f.dataType, str(f.metadata)) for f in fields[k::2]}) > 1 for k in (0, 1)) or fields[0].dataType != fields[1].dataType:
            return False
        names = ("t", "s") if chains.mirrored else ("s", "t")
        held = {a: settle(r.df.select(*(F.col(c).cast("long").alias(n) for c, n in zip(("v0", "v1"), names, strict=True)))) for a, r in relations.items()}
        ends = None
        for df in held.values():
            ends = df if ends is None else ends.unionByName(df)
        lo, hi, n = ends.agg(F.least(F.min("s"), F.min("t")), F.greatest(F.max("s"), F.max("t")), F.count(F.lit(1))).first()
        start = chains.start(component)
        states = max(len(component), start + 1)
        fits = lo is not None and (max(-lo, hi) + 3) * states < 1 << 63
        if n < CLASS_EDGES or not fits:
            for df in held.values():
                discard(df)
            return False
        # null has ways out and ways in, but these do not meet
        none = {"s": hi + 1, "t": hi + 2}

        def node(end: str, state: int):
            return (F.coalesce(F.col(end), F.lit(none[end]).cast("long")) * states + state).alias(end)

        steps = {(component.index(m), a, component.index(o)) for m, a, o in chains.steps}
        if start == len(component):
            steps |= {(start, a, component.index(o)) for o, a in chains.starts}
        parts = [held[a].select(node("s", m), node("t", o)) for m, a, o in sorted(steps)]
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.union(p)
        members = reach.classes(edges)
        known = reach.between(edges, members)
        for df in held.values():
            discard(df)
        inner = Compiler(Source(lambda a: (known if a == "edge" else known.where("e <> v"), False), lambda a: None), {"walk": WALK}, classes=False)
        walks = inner.rule("walk").df.toDF("x", "y")
        for k, n in enumerate(component):
            made = reach.blocks(walks, members, lambda c: F.pmod(c, F.lit(states)) == start, lambda c, k=k: F.pmod(c, F.lit(states)) == k)
            df = made.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
            df = df.select(*((F.expr(f"({c} - {at}) div {states}")).alias(c) for c, at in (("a", start), ("b", k))))
            df = df.select(F.when(F.col("a") != none["s"], F.col("a")).alias("s"), F.when(F.col("b") != none["t"], F.col("b")).alias("t"))
            df = df.select(*(F.col(c).cast(f.dataType).alias(v, metadata=f.metadata) for c, v, f in zip(names, ("v0", "v1"), fields[:2], strict=True)))
            self.made[n] = Relation(df, (0, 1), False, True)
        for df in (known, members, *(df for _, df in inner.tiers["walk"])):
            discard(df)
        return True

    def _with(self, name: str, news: Relation) -> Relation:
        """What is known of a rule after a round. The news itself stays as it is
        until the next round has read it."""
        tiers = self._tiers[name]
        n, df = self._sizes[name], news.df
        late = self._read.pop(name, [])  # earlier news that is known from another folder by now
        while tiers and tiers[-1][0] <= 2 * n:
            m, other = tiers.pop()
            n, df = n + m, other.union(df)
            late.append(other)
        if df is not news.df:
            df = settle(df)
            self._read[name] = [news.df]
        for other in late:
            discard(other)
        tiers.append((n, df))
        known = tiers[0][1]
        for _, more in tiers[1:]:
            known = known.union(more)
        return Relation(known, news.variables, False, True)

    def _hold(self, component: list[str]) -> None:
        """Facts that every round reads are made once, unless they are plain
        columns of a table, which a scan gives as well."""
        for n in component:
            for a in analyze.dependencies(self.rules[n].plan).attributes:
                if self.source.table(a) is None and a not in self._held:
                    df, weighted = self.source.pairs(a)
                    if self.classes:
                        self._held[a] = (df.persist(), weighted)

    def _evaluate(self, plan: Plan, focus: int | None) -> Relation | None:
        self._focus, self._seen = focus, 0
        return self._plan(plan)

    def _new_rows(self, name: str, parts: list[Relation]) -> Relation | None:
        if not parts:
            return None
        df = parts[0].df
        for p in parts[1:]:
            df = df.union(p.df)
        df = df.distinct()
        if self._known[name] is not None:
            df = df.join(self._known[name].df, df.columns, "left_anti")
        df = settle(df)
        n = self._sizes[name] = df.count()
        if not n:
            discard(df)
            return None
        return Relation(df, parts[0].variables, False, True)

    # -- plans -----------------------------------------------------------------
    def _prepared(self, plan: Plan) -> Plan:
        return collapse_stars(plan, self.source.table)

    def plan(self, plan: Plan) -> Relation:
        self._focus, self._seen = None, 0
        r = self._plan(self._prepared(plan))
        if r is None:
            raise FaultError("a plan outside of a recursion has no rows to begin with")
        return r

    def attribute(self, name: str, e: int, v: int, as_set: bool = False) -> Relation:
        """An attribute's facts as variables. Without weights they are a set, but
        for a table whose key is not unique."""
        try:
            df, weighted = self._held.get(name) or self.source.pairs(name)
        except KeyError:
            raise NotFoundError(f"no attribute {name!r}") from None
        t = self.source.table(name)
        r = relation_of(df, e, v, weighted, not weighted and (t is None or t.unique))
        return r.distinct() if as_set else r

    def _plan(self, plan: Plan) -> Relation | None:
        """None: known to be empty, in the first round of a recursion."""
        match plan:
            case MatchA(e, a, v):
                return self.attribute(a, e, v)
            case MatchEA(e, a, v):
                r = self.attribute(a, -1, v)
                return Relation(r.df.where(F.col("`v-1`") == F.lit(e)).drop("v-1"), (v,), r.weighted, r.is_set)
            case MatchAV(e, a, value):
                r = self.attribute(a, e, -1)
                return Relation(r.df.where(F.col("`v-1`") == F.lit(value)).drop("v-1"), (e,), r.weighted, r.is_set)
            case Star(e, columns):
                tables = [(v, self.source.table(a)) for v, a in columns]
                return star(tables[0][1], e, tables)
            case NameExpr(variables, name):
                r = self._named(name)
                return None if r is None else r.renamed(tuple(variables))
            case Project(variables, inner):
                r = self._plan(inner)
                return None if r is None else algebra.project(r, variables)
            case Filter(variables, predicate, inner, constants):
                r = self._plan(inner)
                return None if r is None else algebra.select(r, variables, predicate, constants)
            case Negate(inner):
                r = self._plan(inner)
                return None if r is None else algebra.negate(r)
            case Transform(variables, result, inner, function, constants):
                r = self._plan(inner)
                return None if r is None else algebra.transform(r, variables, result, function, constants)
            case Join(keys, left, right):
                l, r = self._plan(left), self._plan(right)
                if l is None or r is None:
                    return None
                if isinstance(left, (MatchA, Star)) and not isinstance(right, (MatchA, Star)):
                    l, r = r, l
                by_values = all(isinstance(x, MatchA) and tuple(keys) == (x.v,) and x.e != x.v for x in (left, right))
                return (algebra.join_values if by_values else algebra.join)(l, r, tuple(keys))
            case Antijoin(keys, left, right):
                l, r = self._plan(left), self._plan(right)
                return None if l is None or r is None else algebra.antijoin(l, r, tuple(keys))
            case Union(variables, plans):
                return self._union(variables, plans)
            case Aggregate():
                r = self._plan(plan.plan)
                return None if r is None else algebra.aggregate(
                    r, plan.variables, plan.aggregation_fns, plan.key_variables, plan.aggregation_variables, plan.with_variables, self.set_mode)
            case Hector(variables, bindings):
                return hector(variables, bindings, self._binding, self.source.table, counted=True)
            case PullLevel():
                r = self._plan(plan.plan)
                return None if r is None else pull.pull_level(
                    r, plan.pull_variable, plan.pull_attributes, plan.path_attributes, plan.cardinality_many, self.source.pairs)
            case PullAll(_, attributes):
                return pull.pull_all(attributes, self.source.pairs)
            case Pull(_, paths):
                levels = [x for x in map(self._plan, paths) if x is not None]
                return pull.pull(levels) if levels else None
            case GraphQl():
                return self._plan(to_pull(plan))
        raise IncorrectError(f"not a plan: {plan!r}")

    def _binding(self, k: int, b: AttributeBinding) -> Relation:
        return self.attribute(b.attribute, b.e, b.v, as_set=True)

    def _named(self, name: str) -> Relation | None:
        if name not in self._known:
            if name not in self.made:
                # rules of lower strata come first; a plan by itself makes them here
                state = self._known, self._news, self._focus, self._seen
                self.rule(name)
                self._known, self._news, self._focus, self._seen = state
            return self.made[name]
        at, self._seen = self._seen, self._seen + 1
        return self._news[name] if at == self._focus else self._known[name]

    def _union(self, variables: tuple[int, ...], plans: tuple[Plan, ...]) -> Relation | None:
        parts = []
        for p in plans:
            inside = _count(p, self._known)
            first = self._seen
            if self._focus is not None and not first <= self._focus < first + inside:
                self._seen += inside  # this branch has nothing of the news
                continue
            r = self._plan(p)
            self._seen = first + inside
            if r is not None:
                parts.append(r)
        return algebra.union(parts, variables) if parts else None


#: Walks from class to class.
WALK = Rule("walk", Union((0, 1), (MatchA(0, "edge", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "walk"), MatchA(2, "step", 1))))))


def _count(plan: Plan, names) -> int:
    return sum(n in names for n, _ in analyze.name_uses(plan))


def _positional(r: Relation) -> Relation:
    variables = tuple(range(len(r.columns)))
    return r.renamed(variables)


def result_columns(r: Relation, names: list[str] | None = None) -> DataFrame:
    """A result for the outside: weights become repeated rows, dealt over all
    tasks in portions of ``COPIES``."""
    df = r.df
    if r.weighted:
        df = r.consolidated().df.where(F.col(WEIGHT) > 0)
        own = [c for c in df.columns if c != WEIGHT]
        portions = F.sequence(F.lit(0).cast("long"), F.expr(f"({WEIGHT} - 1) div {COPIES}"))
        df = df.select(*own, WEIGHT, F.explode(portions).alias("_p")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
        size = F.least(F.lit(COPIES), F.col(WEIGHT) - F.col("_p") * COPIES).cast("int")
        df = df.select(*own, F.explode(F.array_repeat(F.lit(0), size)).alias("_x")).drop("_x")
    return df.toDF(*names) if names else df
