"""The clock while no message comes, the engine's own activity, and n-way joins
in which the binding with the fewest values proposes."""

import itertools
import random
import time

import pytest

from factflow.operators.attributes import AttributeConfig
from factflow.plans.ast import AttributeBinding as B
from factflow.plans.ast import Join, MatchA, Rule, q
from factflow.plans.ast import PredicateBinding as P
from factflow.streaming.domain import Datom, Domain
from factflow.streaming.engine import Engine


def test_the_clock_ticks_while_no_message_comes(spark):
    e = Engine(spark, tick=50)
    e.create_attribute("n", AttributeConfig(value_type="Number"))

    def messages():
        yield '{"Transact": [[1, "n", 5, null, 1]]}'
        time.sleep(1.0)
        yield '"Status"'

    told = list(e.serve(messages()))
    assert [o.kind for o in told] == ["message"]
    assert told[0].body["epoch"] >= 3  # its own epoch, and ticks while it slept


def test_earlier_outputs_are_forgotten(spark, monkeypatch):
    from factflow.streaming import engine

    monkeypatch.setattr(engine, "KEPT_OUTPUTS", 3)
    e = Engine(spark)
    for _ in range(10):
        assert len(e.json_message('"Status"')) == 1
    assert len(e.outputs) <= 4


def test_activity_is_told(spark):
    e = Engine(spark)
    for a in ("x", "y"):
        e.create_attribute(a, AttributeConfig(value_type="Number"))
    e.register(Rule("both", Join((0,), MatchA(0, "x", 1), MatchA(0, "y", 2))))
    e.register_introspection()
    e.interest("both")
    e.transact([Datom.add(k, a, k) for k in range(5) for a in ("x", "y") if k < 3 or a == "x"])
    e.transact([])
    rows = lambda a: {r["e"]: r["v"] for r in e.query(MatchA(0, a, 1)).toDF("e", "v").collect()}
    assert rows("join/tuples") == {"both/0": 3} and rows("index/tuples") == {"x": 5, "y": 3}
    assert set(rows("operator/rule").values()) == {"both"} and any("Join" in v for v in rows("operator/name").values())
    ends = rows("channel/to")
    assert ends and set(ends.values()) <= set(rows("operator/name")) and set(rows("channel/from")) == set(ends)
    assert set(rows("schedule/elapsed-ms")) == {"both"}
    e.shutdown()


@pytest.mark.parametrize("seed", [0, 1])
def test_the_binding_with_the_fewest_values_proposes(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(50)} | {(0, k) for k in range(12)} | {(k, 0) for k in range(12)}
    d = Domain(spark)
    d.add_derived("edge", spark.createDataFrame(sorted(edges), "e long, v long"))
    run = lambda variables, bindings: sorted(tuple(r) for r in d.query(q(variables, bindings)).df.collect())
    nodes = range(12)
    triangle = [B(0, "edge", 1), B(1, "edge", 2), B(0, "edge", 2)]
    assert run([0, 1, 2], triangle) == sorted(x for x in itertools.product(nodes, repeat=3) if {(x[0], x[1]), (x[1], x[2]), (x[0], x[2])} <= edges)
    clique = [*triangle, B(0, "edge", 3), B(1, "edge", 3), B(2, "edge", 3), P("LT", (3, 0))]
    assert run([0, 1, 2, 3], clique) == sorted(x for x in itertools.product(nodes, repeat=4) if x[0] < x[3] and all((x[a], x[b]) in edges for a, b in ((0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3))))
    square = [B(0, "edge", 1), B(1, "edge", 2), B(2, "edge", 3), B(3, "edge", 0)]
    assert run([0, 1, 2, 3], square) == sorted(x for x in itertools.product(nodes, repeat=4) if all((x[a], x[b]) in edges for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))))


def test_a_domain_is_as_far_as_its_slowest_input(spark):
    from factflow.errors import ConflictError, NotFoundError

    d = Domain(spark)
    d.create_attribute("n", AttributeConfig(value_type="Number"))
    d.open_input("fast")
    d.open_input("slow")
    assert d.advance_input("fast", 7) == 0 and d.advance_input("slow", 3) == 3 and d.epoch == 3
    d.transact([Datom.add_at(1, "n", 1, 5)])
    for bad in (lambda: d.advance_input("slow", 2), lambda: d.advance_epoch(4), lambda: d.open_input("fast"), lambda: d.transact([Datom.add_at(1, "n", 2, 2)])):
        with pytest.raises(ConflictError):
            bad()
    with pytest.raises(NotFoundError):
        d.advance_input("other", 9)
    assert d.close_named_input("slow") == 7 and d.query(MatchA(0, "n", 1)).df.count() == 1
    assert d.close_named_input("fast") == 7
    d.advance_epoch(9)
    assert d.epoch == 9


def test_an_epoch_goes_on_until_its_inputs_have_passed_it(spark):
    e = Engine(spark)
    e.create_attribute("n", AttributeConfig(value_type="Number"))
    e.register(Rule("r", MatchA(0, "n", 1)))
    e.interest("r")
    e.domain.open_input("files")
    assert e.transact([Datom.add(1, "n", 1)]) == [] and e.domain.epoch == 0
    e.domain.inputs["files"] = 1  # it has told everything before epoch 1
    assert [(o.body, o.time, o.diff) for o in e.transact([Datom.add(2, "n", 2)])] == [((1, 1), 0, 1), ((2, 2), 0, 1)] and e.domain.epoch == 1
