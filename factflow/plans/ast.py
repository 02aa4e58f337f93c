"""Query plans and bindings, and their JSON form.

JSON is externally tagged: ``{"Project": {"variables": [...], "plan": ...}}``;
``MatchA``, ``MatchEA``, ``MatchAV`` and ``NameExpr`` take a list.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from factflow.errors import IncorrectError
from factflow.functions.values import Typed, decode

Var = int


class Plan:
    """Base of all plans."""


class Binding:
    """Base of all bindings of a Hector plan."""


@dataclass(frozen=True)
class MatchA(Plan):
    """[?e a ?v]"""

    e: Var
    attribute: str
    v: Var


@dataclass(frozen=True)
class MatchEA(Plan):
    """[e a ?v]"""

    e: Any
    attribute: str
    v: Var


@dataclass(frozen=True)
class MatchAV(Plan):
    """[?e a v]"""

    e: Var
    attribute: str
    v: Any


@dataclass(frozen=True)
class NameExpr(Plan):
    """Another rule's tuples, renamed by position."""

    variables: tuple[Var, ...]
    name: str


@dataclass(frozen=True)
class Project(Plan):
    variables: tuple[Var, ...]
    plan: Plan


@dataclass(frozen=True)
class Filter(Plan):
    """``predicate(x0, x1)``, or with the first set constant in the place of one."""

    variables: tuple[Var, ...]
    predicate: str
    plan: Plan
    constants: tuple[Any, ...] = (None, None)


@dataclass(frozen=True)
class Join(Plan):
    variables: tuple[Var, ...]
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Antijoin(Plan):
    variables: tuple[Var, ...]
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Union(Plan):
    variables: tuple[Var, ...]
    plans: tuple[Plan, ...]


@dataclass(frozen=True)
class Negate(Plan):
    plan: Plan


@dataclass(frozen=True)
class Aggregate(Plan):
    variables: tuple[Var, ...]
    plan: Plan
    aggregation_fns: tuple[str, ...]
    key_variables: tuple[Var, ...]
    aggregation_variables: tuple[Var, ...]
    with_variables: tuple[Var, ...] = ()


@dataclass(frozen=True)
class Transform(Plan):
    variables: tuple[Var, ...]
    result_variable: Var
    plan: Plan
    function: str
    constants: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Hector(Plan):
    """n-way natural join over bindings."""

    variables: tuple[Var, ...]
    bindings: tuple[Binding, ...]


@dataclass(frozen=True)
class PullLevel(Plan):
    variables: tuple[Var, ...]
    plan: Plan
    pull_variable: Var
    pull_attributes: tuple[str, ...]
    path_attributes: tuple[str, ...] = ()
    cardinality_many: bool = False


@dataclass(frozen=True)
class Pull(Plan):
    variables: tuple[Var, ...]
    paths: tuple[Plan, ...]


@dataclass(frozen=True)
class PullAll(Plan):
    variables: tuple[Var, ...]
    pull_attributes: tuple[str, ...]


@dataclass(frozen=True)
class GraphQl(Plan):
    """A GraphQL selection, from the entities of ``root`` or from all."""

    query: str
    root: Plan | None = None


@dataclass(frozen=True)
class Star(Plan):
    """Several attributes of one wide table read in one scan; made by the
    rewriter only. ``columns``: (variable, attribute)."""

    e: Var
    columns: tuple[tuple[Var, str], ...]


@dataclass(frozen=True)
class AttributeBinding(Binding):
    e: Var
    attribute: str
    v: Var


@dataclass(frozen=True)
class ConstantBinding(Binding):
    variable: Var
    value: Any


@dataclass(frozen=True)
class PredicateBinding(Binding):
    """Keeps ``predicate(y, x)``: the operands stand the other way round."""

    predicate: str
    variables: tuple[Var, Var]


@dataclass(frozen=True)
class NotBinding(Binding):
    binding: Binding


@dataclass(frozen=True)
class Rule:
    name: str
    plan: Plan


@dataclass(frozen=True)
class Dependencies:
    names: frozenset[str] = field(default_factory=frozenset)
    attributes: frozenset[str] = field(default_factory=frozenset)


def q(variables: list[Var], bindings: list[Binding]) -> Hector:
    return Hector(tuple(variables), tuple(bindings))


_PLANS = {c.__name__: c for c in (Project, Filter, Join, Antijoin, Union, Aggregate, Transform, Hector, PullLevel, Pull, PullAll)}
_LISTED = {c.__name__: c for c in (MatchA, MatchEA, MatchAV, NameExpr)}
_CHILDREN = {"plan", "left", "right"}
_OPTIONAL = {"with_variables", "path_attributes", "constants", "cardinality_many"}


def _constant(value: Any) -> Any:
    if value is None:
        return None
    tag, payload = decode(value)
    return Typed(tag, payload) if tag in ("Eid", "Instant", "Real") else payload


def plan_from_json(data: Any) -> Plan:
    if not isinstance(data, dict) or len(data) != 1:
        raise IncorrectError(f"not a plan: {data!r}")
    [(tag, body)] = data.items()
    if tag in _LISTED:
        return _listed(tag, body)
    if tag == "Negate":
        return Negate(plan_from_json(body))
    if tag == "GraphQl":
        root = body.get("root") if isinstance(body, dict) else None
        return GraphQl(body["query"] if isinstance(body, dict) else body, plan_from_json(root) if root else None)
    if tag not in _PLANS:
        raise IncorrectError(f"unknown plan {tag!r}")
    made = {}
    for f in fields(_PLANS[tag]):
        if f.name not in body:
            if f.name in _OPTIONAL:
                continue
            raise IncorrectError(f"{tag} lacks {f.name!r}")
        value = body[f.name]
        if f.name in _CHILDREN:
            made[f.name] = plan_from_json(value)
        elif f.name in ("plans", "paths"):
            made[f.name] = tuple(map(plan_from_json, value))
        elif f.name == "bindings":
            made[f.name] = tuple(map(binding_from_json, value))
        elif f.name == "constants":
            pairs = value.items() if isinstance(value, dict) else enumerate(value)
            at = {int(k): _constant(v) for k, v in pairs}
            made[f.name] = tuple(at.get(k) for k in range(max(at, default=-1) + 1))
        else:
            made[f.name] = tuple(value) if isinstance(value, list) else value
    return _PLANS[tag](**made)


def _listed(tag: str, body: list) -> Plan:
    if tag == "NameExpr":
        return NameExpr(tuple(body[0]), body[1])
    a, b, c = body
    if tag == "MatchEA":
        a = decode(a)[1]
    if tag == "MatchAV":
        c = decode(c)[1]
    return _LISTED[tag](a, b, c)


def binding_from_json(data: Any) -> Binding:
    if not isinstance(data, dict) or len(data) != 1:
        raise IncorrectError(f"not a binding: {data!r}")
    [(tag, body)] = data.items()
    if tag == "Attribute":
        if "variables" in body:
            e, v = body["variables"]
            return AttributeBinding(e, body["source_attribute"], v)
        return AttributeBinding(body["e"], body["attribute"], body["v"])
    if tag == "Constant":
        return ConstantBinding(body["variable"], decode(body["value"])[1])
    if tag == "BinaryPredicate":
        x, y = body["variables"]
        return PredicateBinding(body["predicate"], (x, y))
    if tag == "Not":
        return NotBinding(binding_from_json(body["binding"] if "binding" in body else body))
    raise IncorrectError(f"unknown binding {tag!r}")
