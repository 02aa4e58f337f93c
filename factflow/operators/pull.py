"""Hierarchical pulls: rows of (path, attr, value).

A result is a ragged tuple in principle, ``[p "parent/child" c a v]``; here its
parts are ``path`` (array of text), ``attr`` and ``value`` (text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.functions.values import as_text
from factflow.operators.relation import WEIGHT, Relation

#: Gives an attribute's (e, v[, _w]) and whether it is weighted.
Pairs = Callable[[str], tuple[DataFrame, bool]]


def _text(df: DataFrame, name: str) -> Column:
    return as_text(F.col(name), df.schema[name].dataType)


def _path(r: Relation, attributes: tuple[str, ...]) -> Column:
    """The tuple's values with the path's attributes between them."""
    columns = r.columns
    parts: list[Column] = []
    for k, c in enumerate(columns):
        parts.append(_text(r.df, c))
        if k < len(attributes):
            parts.append(F.lit(attributes[k]))
    return F.array(*parts) if parts else F.array().cast("array<string>")


def _out(df: DataFrame, path: Column, attr: Column, value: Column, weight: Column | None) -> DataFrame:
    made = [path.cast(T.ArrayType(T.StringType())).alias("path"), attr.cast("string").alias("attr"), value.cast("string").alias("value")]
    return df.select(*made, *([] if weight is None else [weight.cast("long").alias(WEIGHT)]))


def pull_level(r: Relation, variable: int, attributes: tuple[str, ...], path_attributes: tuple[str, ...], many: bool, pairs: Pairs) -> Relation:
    """The attributes of the entities that ``variable`` binds. If a child can
    only be one (not ``many``, and there is a path), its id leaves the path and
    is told in a row ``db__id``. Without attributes: the paths alone."""
    if not attributes:
        if not path_attributes:
            return r
        df = _out(r.df, _path(r, path_attributes), F.lit(None), F.lit(None), r.weight())
        return Relation(df, (), r.weighted)
    entity = r.column(variable)
    popped = bool(path_attributes) and not many
    full = _path(r, path_attributes)
    path = F.slice(full, 1, F.size(full) - 1) if popped else full
    base = r.df.select(F.col(entity).alias("_e"), full.alias("_full"), path.alias("_path"), *([F.col(WEIGHT).alias("_wl")] if r.weighted else []))
    parts, weighted = [], r.weighted
    for a in attributes:
        df, w = pairs(a)
        weighted |= w
        rows = base.join(df, base["_e"] == df["e"])
        weight = (F.col("_wl") if r.weighted else F.lit(1)) * (F.col(WEIGHT) if w else F.lit(1))
        parts.append((rows, F.col("_path"), F.lit(a), _text(df, "v"), weight))
    if popped:
        weight = F.col("_wl") if r.weighted else F.lit(1)
        parts.append((base, F.col("_path"), F.lit("db__id"), F.element_at("_full", -1), weight))
    made = [_out(df, p, a, v, w if weighted else None) for df, p, a, v, w in parts]
    return Relation(_all(made), (), weighted)


def pull_all(attributes: tuple[str, ...], pairs: Pairs) -> Relation:
    """[e, attribute, v] of every fact."""
    got = [(a, *pairs(a)) for a in attributes]
    weighted = any(w for _, _, w in got)
    made = []
    for a, df, w in got:
        weight = (F.col(WEIGHT) if w else F.lit(1)) if weighted else None
        made.append(_out(df, F.array(_text(df, "e")), F.lit(a), _text(df, "v"), weight))
    return Relation(_all(made), (), weighted)


def pull(levels: list[Relation]) -> Relation:
    """All levels' rows, as they are."""
    weighted = any(x.weighted for x in levels)
    return Relation(_all([(x.with_weights() if weighted else x).df for x in levels]), (), weighted)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def nested_json(pulled: DataFrame) -> DataFrame:
    """(entity, json): each entity's own attributes as one object, of a pull's
    rows whose path is the entity alone."""
    top = pulled.where(F.size("path") == 1)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr", "value"))))
    return top.groupBy(F.col("path")[0].alias("entity")).agg(F.to_json(entries).alias("json"))
