"""Fixed cases of patterns, joins, aggregates, disjunction and bindings."""

import pytest

from factflow.errors import IncorrectError, UnsupportedError
from factflow.plans.ast import (
    Aggregate,
    Antijoin,
    AttributeBinding,
    ConstantBinding,
    Filter,
    GraphQl,
    Hector,
    Join,
    MatchA,
    MatchAV,
    MatchEA,
    Negate,
    NotBinding,
    PredicateBinding,
    Project,
    PullLevel,
    Transform,
    Union,
    q,
)
from factflow.streaming.domain import Datom
from tests.cases import at, facts, run

B, C, P, N = AttributeBinding, ConstantBinding, PredicateBinding, NotBinding
NAMES = [facts([(100, "Dipper"), (100, "Alias"), (200, "Mabel")], ":name")]
PEOPLE = [facts([(1, "Ivan", 15), (2, "Petr", 37), (3, "Ivan", 37), (4, None, 15)], ":name", ":age")]
NAME = {":name": "String"}
NAME_AGE = {":name": "String", ":age": "Number"}


@pytest.mark.parametrize("plan, rows", [
    (MatchA(0, ":name", 1), [(100, "Dipper"), (100, "Alias"), (200, "Mabel")]),
    (MatchEA(100, ":name", 1), [("Alias",), ("Dipper",)]),
    (MatchAV(0, ":name", "Mabel"), [(200,)]),
    (Project((1, 0), MatchA(0, ":name", 1)), [("Dipper", 100), ("Alias", 100), ("Mabel", 200)]),
    (q([0, 1], [B(0, ":name", 1), C(0, 100)]), [(100, "Alias"), (100, "Dipper")]),
])
def test_names(spark, plan, rows):
    assert run(spark, NAME, plan, NAMES) == [at(0, *rows)]


def test_projection_keeps_multiplicity(spark):
    assert run(spark, NAME, Project((0,), MatchA(0, ":name", 1)), NAMES) == [{((100,), 0, 2), ((200,), 0, 1)}]


@pytest.mark.parametrize("plan, rows", [
    (q([0, 1], [B(0, ":name", 2), C(2, "Ivan"), B(0, ":age", 1)]), [(1, 15), (3, 37)]),
    (Project((0, 2), Join((1,), MatchA(0, ":name", 1), MatchA(2, ":name", 1))), [(1, 1), (2, 2), (3, 3), (1, 3), (3, 1)]),
    (q([0, 2, 3], [B(0, ":name", 4), C(4, "Ivan"), B(0, ":age", 1), B(2, ":age", 1), B(2, ":name", 3)]), [(1, 1, "Ivan"), (3, 3, "Ivan"), (3, 2, "Petr")]),
    (Filter((1,), "GT", MatchA(0, ":age", 1), (None, 20)), [(2, 37), (3, 37)]),
    (Filter((1,), "GT", MatchA(0, ":age", 1), (20, None)), [(1, 15), (4, 15)]),
    (Filter((1, 0), "LT", MatchA(0, ":name", 1), (None, None)), [(1, "Ivan"), (2, "Petr"), (3, "Ivan")]),
    (Antijoin((0,), MatchA(0, ":age", 1), Project((0,), MatchA(0, ":name", 1))), [(4, 15)]),
    (Union((0,), (MatchAV(0, ":age", 37), Negate(MatchAV(0, ":name", "Ivan")))), [(2,)]),
])
def test_people(spark, plan, rows):
    assert run(spark, NAME_AGE, plan, PEOPLE) == [at(0, *rows)]


def test_aliases_keep_bag_multiplicity(spark):
    data = [facts([(1, "Ivan"), (2, "Petr")], ":name") + facts([(1, "ivolga"), (1, "pi"), (2, "porosenok"), (2, "pi")], ":aka")]
    plan = q([1, 4], [B(0, ":name", 1), B(0, ":aka", 2), B(3, ":aka", 2), B(3, ":name", 4)])
    assert run(spark, {":name": "String", ":aka": "String"}, plan, data) == [
        {(("Ivan", "Ivan"), 0, 2), (("Petr", "Petr"), 0, 2), (("Ivan", "Petr"), 0, 1), (("Petr", "Ivan"), 0, 1)}]


AMOUNTS = [facts([(1, 5), (1, 2), (1, 4), (1, 6), (2, 10), (2, 10)], ":amount")]


@pytest.mark.parametrize("fn, whole, each", [
    ("COUNT", 6, {1: 4, 2: 2}), ("MAX", 10, {1: 6, 2: 10}), ("MIN", 2, {1: 2, 2: 10}), ("SUM", 37, {1: 17, 2: 20}),
    ("AVG", (37, 6), {1: (17, 4), 2: (10, 1)}), ("VARIANCE", (317, 36), {1: (35, 16), 2: (0, 1)}), ("MEDIAN", 5, {1: 5, 2: 10}),
])
def test_aggregates_of_bags(spark, fn, whole, each):
    kinds, one = {":amount": "Number"}, MatchA(0, ":amount", 1)
    assert run(spark, kinds, Aggregate((1,), one, (fn,), (), (1,)), AMOUNTS, "Raw") == [at(0, (whole,))]
    assert run(spark, kinds, Aggregate((0, 1), one, (fn,), (0,), (1,)), AMOUNTS, "Raw") == [at(0, *each.items())]


@pytest.mark.parametrize("fn, whole", [("COUNT", 5), ("SUM", 27), ("AVG", (27, 5)), ("VARIANCE", (176, 25))])
def test_aggregates_of_sets(spark, fn, whole):
    plan = Aggregate((1,), MatchA(0, ":amount", 1), (fn,), (), (1,))
    assert run(spark, {":amount": "Number"}, plan, AMOUNTS, "Raw", set_mode=True) == [at(0, (whole,))]


def test_several_aggregates_of_a_join(spark):
    data = [facts([(1, a) for a in (5, 2, 6, 9, 10)] + [(2, 2), (2, 4)], ":amount") + facts([(1, d) for d in (13, 4, 9, 15, 10)] + [(2, 5), (2, 42)], ":debt")]
    both = Join((0,), MatchA(0, ":amount", 1), MatchA(0, ":debt", 2))
    kinds = {":amount": "Number", ":debt": "Number"}
    plan = Aggregate((1, 2, 1, 2), both, ("MAX", "MIN", "SUM", "AVG"), (), (1, 2, 1, 2))
    assert run(spark, kinds, plan, data, "Raw") == [at(0, (10, 4, 172, (349, 29)))]
    plan = Aggregate((0, 1, 1, 1, 1, 2, 2, 2, 2), both, ("MIN", "MAX", "MEDIAN", "COUNT") * 2, (0,), (1,) * 4 + (2,) * 4)
    assert run(spark, kinds, plan, data, "Raw") == [at(0, (1, 2, 10, 6, 25, 4, 15, 10, 25), (2, 2, 4, 4, 4, 5, 42, 42, 4))]


def test_with_variables(spark):
    data = [[Datom.add(k, ":heads", n) for k, n in (("Cerberus", 3), ("Medusa", 1), ("Cyclops", 1), ("Chimera", 1))]]
    from factflow.operators.attributes import AttributeConfig
    from factflow.plans.ast import Rule
    from factflow.streaming.engine import Engine

    engine = Engine(spark, set_mode=True)
    engine.create_attribute(":heads", AttributeConfig(value_type="Number", entity_type="String"))
    engine.register(Rule("r", Aggregate((1,), MatchA(0, ":heads", 1), ("SUM",), (), (1,), (0,))))
    engine.interest("r")
    assert [o.body for o in engine.transact(data[0])] == [(6,)]


OR = [facts([(1, "Ivan", 10), (2, "Ivan", 20), (3, "Oleg", 10), (4, "Oleg", 20), (5, "Ivan", 10), (6, "Ivan", 20)], ":name", ":age")]


@pytest.mark.parametrize("plan, rows", [
    (Union((0,), (MatchAV(0, ":name", "Oleg"), MatchAV(0, ":age", 10))), (1, 3, 4, 5)),
    (Union((0,), (MatchAV(0, ":name", "Oleg"), MatchAV(0, ":age", 30))), (3, 4)),
    (Union((0,), (MatchAV(0, ":name", "Petr"), MatchAV(0, ":age", 30))), ()),
    (Union((0,), (q([0], [B(0, ":age", 1), C(2, 1), B(2, ":age", 1), B(0, ":name", 3), C(3, "Ivan")]),
                  q([0], [B(0, ":age", 1), C(2, 2), B(2, ":age", 1), B(0, ":name", 3), C(3, "Oleg")]))), (1, 5, 4)),
])
def test_disjunction(spark, plan, rows):
    assert run(spark, NAME_AGE, plan, OR) == [at(0, *((r,) for r in rows))]


EDGES = [facts([(100, 200), (200, 300), (100, 300), (100, 400), (400, 500), (500, 100)], "edge")]


def test_triangle(spark):
    plan = q([0, 1, 2], [B(0, "edge", 1), B(1, "edge", 2), B(0, "edge", 2)])
    assert run(spark, {"edge": "Eid"}, plan, EDGES) == [at(0, (100, 200, 300))]


def test_binding_predicate_is_inverted(spark):
    data = [facts([(100, 1), (100, 2), (100, 3)], ":num")]
    plan = q([1, 2], [B(0, ":num", 1), B(0, ":num", 2), P("LT", (1, 2))])
    assert run(spark, {":num": "Number"}, plan, data) == [at(0, (2, 1), (3, 1), (3, 2))]


def test_constants_and_predicate(spark):
    data = [facts([(100, 1), (100, 10), (100, 20)], ":num")]
    plan = q([0, 1, 2, 3], [B(0, ":num", 1), C(1, 10), C(2, 18), B(0, ":num", 3), P("GT", (2, 3)), ])
    assert run(spark, {":num": "Number"}, plan, data) == [at(0, (100, 10, 18, 20))]


def test_not_binding(spark):
    plan = q([0, 1], [B(0, "edge", 1), N(B(0, "far", 1))])
    data = [EDGES[0][:3] + [Datom.add(100, "far", 300)], [Datom.add(100, "far", 200)], [Datom.retract(100, "far", 300)]]
    assert run(spark, {"edge": "Eid", "far": "Eid"}, plan, data) == [
        at(0, (100, 200), (200, 300)), at(1, (100, 200), diff=-1), at(2, (100, 300))]


@pytest.mark.parametrize("fn, constants, result", [
    ("TRUNCATE", (), 1540047600000), ("TRUNCATE", (None, ":minute"), 1540048500000), ("TRUNCATE", (None, ":day"), 1539993600000),
    ("TRUNCATE", (None, ":week"), 1539820800000), ("ADD", (None, 5), 1540048515505), ("SUBTRACT", (2000000000000,), 459951484500),
    ("SUBTRACT", (None, 500), 1540048515000),
])
def test_transforms(spark, fn, constants, result):
    data = [facts([(1, 1540048515500)], ":t")]
    plan = Transform((1,), 2, MatchA(0, ":t", 1), fn, constants)
    assert run(spark, {":t": "Instant"}, plan, data) == [at(0, (1, 1540048515500, result))]


def test_pull_level(spark):
    data = [facts([(100, True, "Mabel", 12), (200, False, "Dipper", 13), (300, False, "Soos", None)], "admin?", "name", "age")]
    plan = PullLevel((), MatchAV(0, "admin?", False), 0, ("name", "age"))
    assert run(spark, {"admin?": "Bool", "name": "String", "age": "Number"}, plan, data) == [
        at(0, (("200",), "age", "13"), (("200",), "name", "Dipper"), (("300",), "name", "Soos"))]


HEROES = [facts([(100, "Alice"), (200, "Bob"), (300, "Mabel"), (400, "Dipper")], "name") + facts([(k, True) for k in (100, 200, 300, 400)], "hero")
          + facts([(300, 400), (200, 100)], "bested") + facts([(300, 13), (400, 12)], "age")]
HERO_KINDS = {"name": "String", "hero": "Bool", "bested": "Eid", "age": "Number"}
ROOT = q([0], [B(0, "hero", 11111)])


@pytest.mark.parametrize("text, rows", [
    ("{name age}", [(("100",), "name", "Alice"), (("200",), "name", "Bob"), (("300",), "name", "Mabel"), (("400",), "name", "Dipper"), (("300",), "age", "13"), (("400",), "age", "12")]),
    ('{bested(name: "Dipper") { age }}', [(("300", "bested"), "age", "12"), (("300", "bested"), "db__id", "400")]),
])
def test_graphql(spark, text, rows):
    assert run(spark, HERO_KINDS, GraphQl(text, ROOT), HEROES) == [at(0, *rows)]


def test_graphql_refuses(spark):
    from factflow.plans.graphql import parse

    for text, error in (("query X {a}", UnsupportedError), ("{...f}", UnsupportedError), ("{a(x: 1.5){b}}", UnsupportedError), ("{a", IncorrectError), ("", IncorrectError)):
        with pytest.raises(error):
            parse(text)


@pytest.mark.parametrize("plan, error", [
    (Join((0,), MatchA(0, ":name", 1), MatchA(0, ":age", 1)), IncorrectError),
    (Join((), MatchA(0, ":name", 1), MatchA(2, ":age", 3)), IncorrectError),
    (Project((5,), MatchA(0, ":name", 1)), IncorrectError),
    (q([0, 2], [B(0, ":name", 1), B(2, ":age", 3)]), UnsupportedError),
    (q([0], [B(0, ":age", 1), N(B(0, ":name", 2))]), UnsupportedError),
    (q([0], [B(0, ":name", 1), P("LT", (1, 7))]), UnsupportedError),
    (Hector((0,), ()), UnsupportedError),
])
def test_wrong_plans(spark, plan, error):
    from factflow.streaming.engine import Engine
    from tests.cases import attributes

    engine = Engine(spark)
    attributes(engine, NAME_AGE)
    with pytest.raises(error):
        engine.domain.query(plan)
