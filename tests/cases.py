"""Cases: a plan, transactions, and the exact changes that each one makes."""

from __future__ import annotations

from factflow.operators.attributes import AttributeConfig
from factflow.plans.ast import Rule
from factflow.streaming.domain import Datom
from factflow.streaming.engine import Engine


def attributes(engine: Engine, kinds: dict[str, str], semantics: str = "Distinct") -> None:
    for name, kind in kinds.items():
        engine.create_attribute(name, AttributeConfig.uncompacted(semantics, value_type=kind))


def value(x):
    """Structs as plain tuples."""
    return tuple(x) if hasattr(x, "asDict") else x


def run(spark, kinds, plan, transactions, semantics="Distinct", set_mode=False, rules=()):
    """The changes (tuple, time, diff) of each transaction."""
    engine = Engine(spark, set_mode=set_mode)
    attributes(engine, kinds, semantics)
    engine.register(*rules, Rule("case", plan))
    engine.interest("case")
    out = []
    for t in transactions:
        told = engine.transact(t)
        assert all(o.kind == "diff" for o in told), told
        out.append({(tuple(value(x) if not isinstance(x, list) else tuple(x) for x in o.body), o.time, o.diff) for o in told})
        assert len(out[-1]) == len(told)
    return out


def facts(rows, *names):
    """Datoms of rows (e, value per attribute; None: no fact)."""
    return [Datom.add(r[0], n, v) for r in rows for n, v in zip(names, r[1:], strict=True) if v is not None]


def at(time, *tuples, diff=1):
    return {(t, time, diff) for t in tuples}
