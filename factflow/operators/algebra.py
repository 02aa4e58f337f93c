"""Projection, selection, joins, set operations, aggregation, transforms."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factflow.errors import IncorrectError
from factflow.functions.aggregates import AGGREGATES
from factflow.functions.predicates import compare
from factflow.functions.transforms import FUNCTIONS
from factflow.functions.values import TYPE_KEY, typed
from factflow.operators.relation import WEIGHT, Relation, alike, names_of
from factflow.storage import settle

#: Rows of a list, in the mean at most, where lists meet.
CHUNK = 1024


def project(r: Relation, variables: tuple[int, ...]) -> Relation:
    """Reorder, drop or repeat columns; multiplicities are kept."""
    columns = [F.col(r.column(v)).alias(n) for v, n in zip(variables, names_of(variables), strict=True)]
    keeps_all = r.is_set and set(variables) == set(r.variables)
    return Relation(r.df.select(*columns, *r.rest()), tuple(variables), r.weighted, keeps_all)


def select(r: Relation, variables: tuple[int, ...], predicate: str, constants: tuple[Any, ...]) -> Relation:
    slots = (*constants, None, None)
    if slots[0] is not None:
        left, right = ("const", slots[0]), ("var", r.column(variables[0]))
    elif slots[1] is not None:
        left, right = ("var", r.column(variables[0])), ("const", slots[1])
    else:
        if len(variables) < 2:
            raise IncorrectError("a filter without a constant compares two variables")
        left, right = (("var", r.column(v)) for v in variables[:2])
    return Relation(r.df.where(compare(r.df, predicate, left, right)), r.variables, r.weighted, r.is_set)


def join(left: Relation, right: Relation, keys: tuple[int, ...]) -> Relation:
    """Inner equi-join: keys, then the rest of either side; weights multiply."""
    if not keys:
        raise IncorrectError("a join needs a variable")
    for side in (left, right):
        for v in keys:
            side.column(v)
    twice = (set(left.variables) & set(right.variables)) - set(keys)
    if twice:
        raise IncorrectError(f"variables {sorted(twice)} are on both sides of a join but not joined")
    weighted = left.weighted or right.weighted
    l, r = left.df, right.df
    if left.weighted:
        l = l.withColumnRenamed(WEIGHT, "_wl")
    if right.weighted:
        r = r.withColumnRenamed(WEIGHT, "_wr")
    on = [left.column(v) for v in keys]
    variables = (*keys, *(v for v in left.variables if v not in keys), *(v for v in right.variables if v not in keys))
    df = l.join(r, on)
    if weighted:
        a = F.col("_wl") if left.weighted else F.lit(1)
        b = F.col("_wr") if right.weighted else F.lit(1)
        df = df.withColumn(WEIGHT, (a * b).cast("long"))
    df = df.select(*names_of(variables), *([WEIGHT] if weighted else []))
    return Relation(df, variables, weighted, left.is_set and right.is_set)


def _lists(r: Relation, on: list[str], name: str) -> DataFrame:
    """A key's other columns in lists of some ``CHUNK`` rows."""
    rest = [c for c in r.df.columns if c not in on]
    sizes = r.df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    dealt = r.df.join(sizes, on).withColumn("_k", F.pmod(F.xxhash64(*rest), "_n"))
    return dealt.groupBy(*on, "_k").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_k")


def join_values(left: Relation, right: Relation, keys: tuple[int, ...]) -> Relation:
    """As ``join``, of sets where both sides may have many rows of a key: lists of
    rows meet lists of rows, and these pairs are dealt over all tasks before their
    rows are made. So no task makes all rows of a key."""
    on = [left.column(v) for v in keys]
    twice = (set(left.variables) & set(right.variables)) - set(keys)
    if twice or left.weighted or right.weighted or not (left.is_set and right.is_set) or any(set(r.columns) <= set(on) for r in (left, right)):
        return join(left, right, keys)
    variables = (*keys, *(v for v in left.variables if v not in keys), *(v for v in right.variables if v not in keys))
    met = _lists(left, on, "_l").join(_lists(right, on, "_r"), on)
    met = met.repartition(4 * met.sparkSession.sparkContext.defaultParallelism)
    df = met.select(*on, F.explode("_l").alias("_l"), "_r").select(*on, "_l", F.explode("_r").alias("_r"))
    columns = []
    for name in names_of(variables):
        side, r = ("_l", left) if name in left.columns else ("_r", right)
        columns.append(F.col(name) if name in on else F.col(f"{side}.{name}").alias(name, metadata=r.df.schema[name].metadata))
    return Relation(df.select(*columns), variables, False, True)


def antijoin(left: Relation, right: Relation, keys: tuple[int, ...]) -> Relation:
    """Distinct rows of the left side whose keys the right side does not have."""
    have = project(right, keys).distinct()
    variables = (*keys, *(v for v in left.variables if v not in keys))
    rows = project(left, variables).distinct()
    return Relation(rows.df.join(have.df, names_of(keys), "left_anti").select(*names_of(variables)), variables, False, True)


def union(relations: list[Relation], variables: tuple[int, ...]) -> Relation:
    """Every row once that has a positive weight in all of them together."""
    parts = alike(*(project(r, variables) for r in relations))
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return Relation(df, tuple(variables), parts[0].weighted).distinct()


def concat(relations: list[Relation]) -> Relation:
    """All rows of all; multiplicities add up."""
    parts = alike(*relations)
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return Relation(df, parts[0].variables, parts[0].weighted)


def negate(r: Relation) -> Relation:
    w = r.with_weights()
    return Relation(w.df.withColumn(WEIGHT, -F.col(WEIGHT)), w.variables, True)


def transform(r: Relation, variables: tuple[int, ...], result: int, function: str, constants: tuple[Any, ...]) -> Relation:
    if function not in FUNCTIONS:
        raise IncorrectError(f"unknown function {function!r}")
    if result in r.variables:
        raise IncorrectError(f"variable {result} is bound already")
    made = FUNCTIONS[function]([F.col(r.column(v)) for v in variables], list(constants))
    own = (*r.variables, result)
    df = r.df.select(*r.columns, made.alias(names_of(own)[-1]), *r.rest())
    return Relation(df, own, r.weighted, r.is_set)


def _medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The upper middle of each key's distinct values, never interpolated. The
    values are sorted over all tasks; a key's place in each task follows from
    counts, so that no task or row holds all values of a key."""
    ranged = df.select(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(by)), F.col(value).alias("_m")).distinct()
    keys = [c for c in ranged.columns if c != "_m"]
    # written out: another run might cut the ranges elsewhere
    ranged = settle(ranged.where("_m IS NOT NULL").repartitionByRange(*keys, "_m").withColumn("_p", F.spark_partition_id()))
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counts = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(own.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = F.floor(F.sum("_c").over(own) / 2)
    counts = counts.select(*keys, "_p", "_c", (middle - before).alias("_at")).where("_at >= 0 AND _at < _c")
    at = counts.toDF(*(f"_t{c}" for c in counts.columns))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in (*keys, "_p")))
    rows = ranged.join(at, same).withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_p").orderBy("_m")))
    rows = rows.where(F.col("_r") == F.col("_t_at") + 1)
    return rows.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), F.col("_m").alias(name))


def aggregate(r: Relation, variables: tuple[int, ...], fns: tuple[str, ...], keys: tuple[int, ...],
              arguments: tuple[int, ...], with_variables: tuple[int, ...] = (), set_mode: bool = False) -> Relation:
    """One row per key. ``variables`` lays the columns out: a key's variable is
    the key, any other the next aggregate of that argument. Without rows there
    is no group, also without keys. In set mode a function sees each (argument,
    with) once per group."""
    if len(fns) != len(arguments):
        raise IncorrectError("each aggregation function takes one variable")
    for f in fns:
        if f not in AGGREGATES:
            raise IncorrectError(f"unknown aggregation {f!r}")
    r = r.consolidated()
    by = [r.column(k) for k in keys]
    made = [f"_a{k}" for k in range(len(fns))]
    medians = {n: r.column(v) for f, v, n in zip(fns, arguments, made, strict=True) if f == "MEDIAN"}
    if set_mode:
        df = None
        for f, v, name in zip(fns, arguments, made, strict=True):
            if name in medians:
                continue
            columns = list(dict.fromkeys([*by, r.column(v), *(r.column(x) for x in with_variables)]))
            one = Relation(r.df.select(*columns, *r.rest()), (), r.weighted).distinct().df
            part = one.groupBy(*by).agg(AGGREGATES[f](F.col(r.column(v)), None).alias(name), F.count(F.lit(1)).alias("_n"))
            part = part.where("_n > 0").drop("_n")
            if df is None:
                df = part
            else:
                df = df.join(part, by) if by else df.crossJoin(part)  # one row each
    else:
        values = [AGGREGATES[f](F.col(r.column(v)), r.weight()).alias(n) for f, v, n in zip(fns, arguments, made, strict=True) if n not in medians]
        df = r.df.groupBy(*by).agg(*values, F.count(F.lit(1)).alias("_n")).where("_n > 0") if values else None
    for name, value in medians.items():
        part = _medians(r.df, by, value, name)
        if df is None:
            df = part
        elif by:
            part = part.toDF(*(f"_k{k}" for k in range(len(by))), name)
            same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"_k{k}")) for k, b in enumerate(by)))
            df = df.join(part, same).drop(*(f"_k{k}" for k in range(len(by))))
        else:
            df = df.crossJoin(part)  # one row each
    kinds = {n: r.df.schema[r.column(v)].metadata.get(TYPE_KEY) for f, v, n in zip(fns, arguments, made, strict=True) if f in ("MIN", "MAX", "MEDIAN")}
    waiting: dict[int, list[str]] = {}
    for v, n in zip(arguments, made, strict=True):
        waiting.setdefault(v, []).append(n)
    columns = []
    for v, name in zip(variables, names_of(variables), strict=True):
        if waiting.get(v):
            source = waiting[v].pop(0)
        elif v in keys:
            source = r.column(v)
        else:
            raise IncorrectError(f"variable {v} is neither a key nor aggregated")
        columns.append(typed(F.col(source), name, kinds.get(source)))
    return Relation(df.select(*columns), tuple(variables), False, True)
