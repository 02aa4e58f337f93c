"""n-way natural joins over bindings.

The bindings' attributes are sets here: each fact counts once. Attributes of one
wide table on one entity variable are read in a single scan. Constants become
filters on the scans that bind their variable. The joins are ordered so that
each shares a variable with what stands before, those with constants first;
Catalyst picks the physical join. Where several bindings know a new variable, as
in cycles, a tuple is extended by the one that has the fewest values for it, and
the others are asked whether they have them, too (``extend``): so no more is made
than the least of them proposes. Entities that nothing but their own scan asks for
are counted before the joins (``counted``), so that rows which only differ in them
meet once, with a weight. A predicate binding's operands stand the other
way round than a filter's (``BINDING_PREDICATE_INVERTED``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.errors import IncorrectError, UnsupportedError
from factflow.functions.predicates import compare
from factflow.functions.values import typed
from factflow.operators.algebra import join, project
from factflow.operators.attributes import TableAttribute
from factflow.operators.relation import WEIGHT, Relation, names_of
from factflow.plans.ast import AttributeBinding, Binding, ConstantBinding, NotBinding, PredicateBinding
from factflow.storage import settle

BINDING_PREDICATE_INVERTED = True

#: Values of a list, at most; tuples with more values of an atom are extended row by row.
LIST = 2048

#: Resolves (attribute, e variable, v variable) to a relation.
Resolve = Callable[[str, int, int], Relation]
#: The wide table of an attribute, or None.
TableOf = Callable[[str], TableAttribute | None]


def star(table: TableAttribute, e: int, columns: list[tuple[int, TableAttribute]]) -> Relation:
    """Several attributes of one table: one scan, facts that are there only."""
    variables = (e, *(v for v, _ in columns))
    df = table.table.select(typed(F.col(table.key), f"v{e}", "Eid"), *(typed(t.value, f"_c{k}", t.value_type) for k, (_, t) in enumerate(columns)))
    df = df.where(F.col(f"v{e}").isNotNull())
    own: list[int] = [e]
    kept = [F.col(f"v{e}")]
    for k, (v, _) in enumerate(columns):
        df = df.where(F.col(f"_c{k}").isNotNull())
        if v in own:
            first = f"v{e}" if v == e else f"_c{[x for x, _ in columns].index(v)}"
            df = df.where(F.col(f"_c{k}") == F.col(first))
        else:
            own.append(v)
            kept.append(F.col(f"_c{k}").alias(f"v{v}"))
    assert set(own) == set(variables)
    return Relation(df.select(*kept), tuple(own), False, True)


def _atoms(bindings: list[AttributeBinding], resolve: Resolve, table_of: TableOf, pinned: set[int]) -> list[Relation]:
    """One relation per scan. ``pinned``: places of bindings that are resolved by
    themselves (their rows are a change, not the table)."""
    groups: dict[tuple, list[tuple[int, AttributeBinding]]] = {}
    for k, b in enumerate(bindings):
        t = table_of(b.attribute)
        alone = t is None or not t.unique or k in pinned
        groups.setdefault(("alone", k) if alone else ("table", t.table_id, t.key, b.e), []).append((k, b))
    out = []
    for key, own in groups.items():
        if key[0] == "table" and len(own) > 1:
            tables = [(b.v, table_of(b.attribute)) for _, b in own]
            out.append(star(tables[0][1], key[3], tables))
        else:
            out += [resolve(k, b) for k, b in own]
    return out


def _bound(r: Relation, constants: dict[int, list[Any]]) -> Relation:
    df = r.df
    for v in r.variables:
        for c in constants.get(v, ()):
            df = df.where(F.col(f"v{v}") == F.lit(c))
    return Relation(df, r.variables, r.weighted, r.is_set)


def _apply_predicates(r: Relation, waiting: list[PredicateBinding]) -> Relation:
    for p in list(waiting):
        x, y = p.variables
        if x in r.variables and y in r.variables:
            left, right = (y, x) if BINDING_PREDICATE_INVERTED else (x, y)
            r = Relation(r.df.where(compare(r.df, p.predicate, ("var", f"v{left}"), ("var", f"v{right}"))), r.variables, r.weighted, r.is_set)
            waiting.remove(p)
    return r


def _apply_not(r: Relation, inner: Binding, resolve_not: Callable[[AttributeBinding], Relation]) -> Relation:
    match inner:
        case AttributeBinding(e, _, v):
            missing = {e, v} - set(r.variables)
            if missing:
                raise UnsupportedError(f"a not-binding binds no variables; {sorted(missing)} are free")
            have = resolve_not(inner).distinct()
            df = r.df.join(have.df, names_of(have.variables), "left_anti")
        case ConstantBinding(v, value):
            df = r.df.where(~F.col(r.column(v)).eqNullSafe(F.lit(value)))
        case PredicateBinding(predicate, (x, y)):
            left, right = (y, x) if BINDING_PREDICATE_INVERTED else (x, y)
            df = r.df.where(~compare(r.df, predicate, ("var", r.column(left)), ("var", r.column(right))))
        case NotBinding(NotBinding(deep)) | NotBinding(deep):
            raise UnsupportedError(f"not of not: {deep!r}")
        case _:
            raise IncorrectError(f"not a binding: {inner!r}")
    return Relation(df.select(*r.columns, *r.rest()), r.variables, r.weighted, r.is_set)


def hector(variables: tuple[int, ...], bindings: tuple[Binding, ...], resolve: Callable[[int, AttributeBinding], Relation],
           table_of: TableOf, pinned: set[int] = frozenset(), allow_cross: bool = False, counted: bool = False) -> Relation:
    """``resolve(k, binding)`` gives the k-th attribute binding's relation.
    ``counted``: equal rows may come as one with a weight."""
    own = [b for b in bindings if isinstance(b, AttributeBinding)]
    constants: dict[int, list[Any]] = {}
    for b in bindings:
        if isinstance(b, ConstantBinding):
            constants.setdefault(b.variable, []).append(b.value)
    predicates = [b for b in bindings if isinstance(b, PredicateBinding)]
    nots = [b.binding for b in bindings if isinstance(b, NotBinding)]
    if not own:
        raise UnsupportedError("a join needs an attribute binding")
    atoms = [_bound(a, constants) for a in _atoms(own, resolve, table_of, set(pinned))]
    # those with constants first; the sort is stable, so the order as written decides else
    atoms.sort(key=lambda a: -sum(v in constants for v in a.variables))
    bound_somewhere = {v for a in atoms for v in a.variables}
    if counted and not allow_cross:
        asked = {*variables, *(v for p in predicates for v in p.variables), *(v for n in nots for v in _variables(n))}
        atoms = [_counted(a, asked.union(*(b.variables for b in atoms if b is not a))) for a in atoms]
    result, rest = atoms[0], atoms[1:]
    result = _apply_predicates(result, predicates)
    while rest:
        several = _proposers(result, rest, counted)
        if several:
            result = extend(result, [rest[k] for k in several], written=counted)
            rest = [a for k, a in enumerate(rest) if k not in several]
            result = _apply_predicates(result, predicates)
            continue
        k = next((k for k, a in enumerate(rest) if set(a.variables) & set(result.variables)), None)
        if k is None:
            if not allow_cross:
                raise UnsupportedError("the bindings fall into parts that share no variable")
            a = rest.pop(0)
            result = Relation(result.df.crossJoin(a.df), (*result.variables, *a.variables), False, False)
        else:
            a = rest.pop(k)
            result = join(result, a, tuple(v for v in result.variables if v in a.variables))
        result = _apply_predicates(result, predicates)
    for v, values in constants.items():
        if v not in bound_somewhere:
            # a constant also proposes the value of a variable of its own
            first, more = values[0], values[1:]
            df = result.df.withColumn(f"v{v}", F.lit(first))
            if any(c != first for c in more):
                df = df.where(F.lit(False))
            result = Relation(df.select(*result.columns, f"v{v}", *result.rest()), (*result.variables, v), result.weighted, result.is_set)
    result = _apply_predicates(result, predicates)
    if predicates:
        raise UnsupportedError(f"predicate {predicates[0]} has free variables: a predicate proposes no values")
    for inner in nots:
        result = _apply_not(result, inner, lambda b: resolve(-1, b))
    return project(result, variables)


def _variables(binding: Binding) -> tuple[int, ...]:
    match binding:
        case AttributeBinding(e, _, v):
            return e, v
        case ConstantBinding(v, _):
            return (v,)
        case PredicateBinding(_, variables):
            return tuple(variables)
        case NotBinding(inner):
            return _variables(inner)
    return ()


def _counted(a: Relation, asked: set[int]) -> Relation:
    """Without the entity, if it is not asked for, its rows as weights."""
    if a.weighted or a.variables[0] in asked or not asked & set(a.variables):
        return a
    kept = tuple(v for v in a.variables if v in asked)
    df = a.df.groupBy(*(a.column(v) for v in kept)).agg(F.count(F.lit(1)).alias(WEIGHT))
    return Relation(df, kept, True, False)


def _proposers(result: Relation, rest: list[Relation], counted: bool = False) -> list[int]:
    """Places of bindings, two at least, that know one new variable besides
    variables that are bound; none if a change with weights is among them."""
    by_new: dict[int, list[int]] = {}
    for k, a in enumerate(rest):
        new = set(a.variables) - set(result.variables)
        if len(new) == 1 and len(a.variables) == 2 and not a.weighted:
            by_new.setdefault(new.pop(), []).append(k)
    return next((ks for ks in by_new.values() if len(ks) > 1), []) if counted or not result.weighted else []


def extend(result: Relation, atoms: list[Relation], written: bool = False) -> Relation:
    """Tuples with values of the variable that all ``atoms`` know besides one
    that is bound: for each tuple, the atom with the fewest values proposes and
    the others check. Tuples whose atoms' values lie in ranges that do not meet
    are done before, and values out of the range in common are not proposed.
    ``written``: what is left of the tuples is written out before they are
    extended, so that few of them can be sent to the atoms' values instead of
    dealing all values anew; tuples of two atoms with ``LIST`` integers at most
    each get their lists and no row for every value that is proposed."""
    new = next(iter(set(atoms[0].variables) - set(result.variables)))
    sets = [a.distinct() for a in atoms]
    keys = [f"v{next(v for v in a.variables if v != new)}" for a in sets]
    df = result.df
    for k, (a, key) in enumerate(zip(sets, keys, strict=True)):
        value = F.col(f"v{new}")
        df = df.join(a.df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{k}"), F.min(value).alias(f"_lo{k}"), F.max(value).alias(f"_hi{k}")), key)
    every = range(len(sets))
    df = df.withColumns({"_lo": F.greatest(*(f"_lo{k}" for k in every)), "_hi": F.least(*(f"_hi{k}" for k in every))}).where("_lo <= _hi")
    # the first of those with the least
    df = df.withColumn("_by", F.array_position(F.array(*(f"_n{k}" for k in every)), F.least(*(f"_n{k}" for k in every))).cast("int"))
    kinds = {a.df.schema[f"v{new}"].dataType.typeName() for a in sets}
    lists = written and len(sets) == 2 and len(kinds) == 1 and kinds <= {"integer", "long"}
    short = F.greatest(*(f"_n{k}" for k in every)) <= LIST if lists else F.lit(False)
    df = df.select(*result.df.columns, "_lo", "_hi", "_by", short.alias("_short"))
    parts = []
    if written:
        df = settle(df)
        some = {r["_short"] for r in df.select("_short").distinct().collect()}
        if True in some:
            parts.append(_common(df.where("_short").select(*result.df.columns), sets, keys, f"v{new}").select(*result.columns, f"v{new}", *result.rest()))
            df = df.where("NOT _short")
    for k, (a, key) in enumerate(zip(sets, keys, strict=True)):
        if parts and False not in some:
            break
        part = df.where(F.col("_by") == k + 1).join(a.df, key).where(F.col(f"v{new}").between(F.col("_lo"), F.col("_hi")))
        for j, (b, other) in enumerate(zip(sets, keys, strict=True)):
            if j != k:
                part = part.join(b.df, [other, f"v{new}"], "left_semi")
        parts.append(part.select(*result.columns, f"v{new}", *result.rest()))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return Relation(out, (*result.variables, new), result.weighted, result.is_set)


def _coding() -> tuple[Callable, Callable]:
    """Lists of integers to bytes and lists of tuples to what they have in common;
    functions of their own, as executors need not have this package. A list is its
    least value and the gaps after it, a byte each; 255 is followed by the rest of a
    gap. Where that is longer, the values are as they are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                x = np.sort(x.values.to_numpy(zero_copy_only=False).astype(np.int64))
                whole, rest = np.divmod(np.diff(x).view(np.uint64), np.uint64(255))
                if len(x) + whole.sum(dtype=float) < 8 * len(x):
                    ends = np.cumsum(whole.astype(np.int64) + 1)
                    gaps = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
                    gaps[ends - 1] = rest
                    out.append(b"g" + x[:1].tobytes() + gaps.tobytes())
                else:
                    out.append(b"v" + x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], batch.schema.names)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(x: bytes) -> np.ndarray:
            if x[:1] == b"v":
                return np.frombuffer(x, np.int64, offset=1)
            gaps = np.frombuffer(x, np.uint8, offset=9)
            first = np.frombuffer(x, np.int64, 1, 1)
            return np.concatenate([first, first + np.cumsum(gaps, dtype=np.int64)[gaps != 255]])

        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            n = batch.num_columns - 2
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, found = [], []
                for k, (x, y) in enumerate(zip(part.column(n), part.column(n + 1))):
                    x, y = x.as_py(), y.as_py()
                    if y not in known:
                        known = {y: unpack(y)}  # rows of one list stand together, mostly
                    both = np.intersect1d(unpack(x), known[y], assume_unique=True)
                    found.append(both)
                    rows.append(np.full(len(both), k))
                own = part.select(list(range(n))).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(found))], [*own.schema.names, "_c"])

    return pack, common


def _common(tuples: DataFrame, sets: list[Relation], keys: list[str], value: str) -> DataFrame:
    """Tuples with the values that both ``sets`` have of them; these are sent as lists."""
    pack, common = _coding()
    df = tuples
    for k, (a, key) in enumerate(zip(sets, keys, strict=True)):
        asked = a.df.join(tuples.select(key).distinct(), key, "left_semi")
        kept = asked.groupBy(key).agg(F.collect_list(value).alias(f"_l{k}"))
        kind = kept.schema[key].dataType.simpleString()
        df = df.join(kept.mapInArrow(pack, f"{key} {kind}, _l{k} binary"), key)
    fields = ", ".join(f"{c} {t}" for c, t in tuples.dtypes)
    out = df.select(*tuples.columns, "_l0", "_l1").mapInArrow(common, f"{fields}, _c long")
    f = sets[0].df.schema[value]
    columns = [F.col(c).alias(c, metadata=tuples.schema[c].metadata) for c in tuples.columns]
    return out.select(*columns, F.col("_c").cast(f.dataType).alias(value, metadata=f.metadata))


def triangles(edges: DataFrame, e: str = "e", v: str = "v", is_set: bool = False) -> DataFrame:
    """(a, b, c) with edges a-b, b-c and a-c: each edge is extended by the end
    that has fewer neighbours. ``is_set``: each edge is there once."""
    pairs = edges.select(F.col(e).alias("a"), F.col(v).alias("b"))
    if not is_set:
        pairs = pairs.distinct()
    # the far ends first: those without edges of their own are done
    ends = [Relation(pairs.toDF(f"v{k}", "v2"), (k, 2), False, True) for k in (1, 0)]
    return extend(Relation(pairs.toDF("v0", "v1"), (0, 1), False, True), ends, written=True).df.toDF("a", "b", "c")
