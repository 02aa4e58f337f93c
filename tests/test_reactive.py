"""Inputs over time, incremental results, recursion, domains, requests, sinks."""

import json
import random
import zlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from factflow.errors import ConflictError, IncorrectError, NotFoundError, UnsupportedError
from factflow.functions import time as ft
from factflow.operators.attributes import AttributeConfig
from factflow.plans.ast import (
    Aggregate,
    Antijoin,
    AttributeBinding,
    Filter,
    GraphQl,
    Join,
    MatchA,
    MatchAV,
    NameExpr,
    Negate,
    Project,
    Rule,
    Transform,
    Union,
    plan_from_json,
    q,
)
from factflow.sinks.core import AssocIn, MemorySink, TheVoid
from factflow.sources.files import CsvFile, JsonFile, ParquetTable
from factflow.streaming.domain import Datom, Domain
from factflow.streaming.engine import Engine
from factflow.streaming.incremental import epoch_diffs
from tests.cases import at, facts, run

AMOUNT = {":amount": "Number"}
ALL = MatchA(0, ":amount", 1)


def lww(*transactions):
    return [[Datom.add(*x) if len(x) == 3 else Datom(x[0], x[1], x[2], None, x[3]) for x in t] for t in transactions]


@pytest.mark.parametrize("transactions, expected", [
    ([[(100, ":amount", 5), (200, ":amount", 100)], [(100, ":amount", 10)]], [at(0, (100, 5), (200, 100)), at(1, (100, 10)) | at(1, (100, 5), diff=-1)]),
    ([[(100, ":amount", 10), (200, ":amount", 100)], [(100, ":amount", 5)]], [at(0, (100, 10), (200, 100)), at(1, (100, 5)) | at(1, (100, 10), diff=-1)]),
    ([[(100, ":amount", 5), (200, ":amount", 100)], [(200, ":amount", 100, -1)]], [at(0, (100, 5), (200, 100)), at(1, (200, 100), diff=-1)]),
    ([[(1, ":amount", 5)], [(1, ":amount", 10)], [(1, ":amount", 5)]], [at(0, (1, 5)), at(1, (1, 10)) | at(1, (1, 5), diff=-1), at(2, (1, 5)) | at(2, (1, 10), diff=-1)]),
    ([[(1, ":amount", 7), (1, ":amount", 9)]], [at(0, (1, 9))]),
])
def test_last_write_wins(spark, transactions, expected):
    assert run(spark, AMOUNT, ALL, lww(*transactions), "LastWriteWins") == expected


def test_future_dated(spark):
    t = [[Datom.add(1, ":amount", 0), Datom.add_at(1, ":amount", 2, 2)], [Datom.add(1, ":amount", 1)], []]
    assert run(spark, AMOUNT, ALL, t, "LastWriteWins") == [at(0, (1, 0)), at(1, (1, 1)) | at(1, (1, 0), diff=-1), at(2, (1, 2)) | at(2, (1, 1), diff=-1)]


def test_last_write_diffs_equal_the_snapshots(spark):
    random.seed(4)
    d = Domain(spark)
    d.create_attribute("a", AttributeConfig.uncompacted("LastWriteWins", value_type="Number"))
    for t in range(4):
        d.transact([Datom.add(random.randrange(4), "a", random.randrange(3)) for _ in range(3)])
        d.advance_epoch(t + 1)
    total = d.logs["a"].diffs()
    for t in range(4):
        want = {tuple(r)[:2] for r in d.logs["a"].snapshot(t).collect()}
        got = {(r["e"], r["v"]) for r in total.where(F.col("_time") <= t).groupBy("e", "v").agg(F.sum("_w").alias("w")).where("w > 0").collect()}
        assert got == want


def test_retracting_what_is_not_there(spark):
    d = Domain(spark)
    d.create_attribute("a", AttributeConfig("LastWriteWins", value_type="Number"))
    with pytest.raises(IncorrectError, match="without a value"):
        d.transact([Datom.retract(1, "a", 5)])
    d.transact_frame("a", spark.createDataFrame([(1, 5, -1)], "e long, v long, _w long"))
    with pytest.raises(Exception, match="without a value"):
        d.logs["a"].diffs().collect()


def test_a_wrong_retraction_ends_the_message(spark):
    e = Engine(spark)
    e.create_attribute("a", AttributeConfig("LastWriteWins", value_type="Number"))
    e.create_attribute("b", AttributeConfig("Raw", value_type="Number"))
    [out] = e.transact([Datom.add(1, "b", 1), Datom.retract(7, "a", 5)])
    assert out.kind == "error" and out.body["category"] == "incorrect"
    e.transact([Datom.add(7, "a", 5)])
    e.transact([Datom.retract(7, "a", 1)])
    assert e.query(MatchA(0, "a", 1)).count() == 0 and e.query(MatchA(0, "b", 1)).count() == 0


def test_distinct_and_raw(spark):
    t = [[Datom.add(1, ":amount", 5), Datom.add(1, ":amount", 5)], [Datom.retract(1, ":amount", 5)], [Datom.retract(1, ":amount", 5)]]
    assert run(spark, AMOUNT, ALL, t, "Distinct") == [at(0, (1, 5)), set(), at(2, (1, 5), diff=-1)]
    assert run(spark, AMOUNT, ALL, t, "Raw") == [{((1, 5), 0, 2)}, at(1, (1, 5), diff=-1), at(2, (1, 5), diff=-1)]


def test_compaction_keeps_facts(spark):
    d = Domain(spark)
    for s in ("Raw", "Distinct", "LastWriteWins"):
        d.create_attribute(s, AttributeConfig(s, value_type="Number"))
    for t in range(5):
        d.transact([Datom.add(1, s, t % 2) for s in d.logs])
        d.advance_epoch(t + 1)
    for log in d.logs.values():
        before = sorted(map(tuple, log.snapshot(4).collect()))
        log.compact(3)
        assert sorted(map(tuple, log.snapshot(4).collect())) == before
        with pytest.raises(ConflictError):
            log.snapshot(1)


# -- incremental = from scratch ------------------------------------------------
B = AttributeBinding
PLANS = {
    "project": Project((1,), MatchA(0, "a", 1)),
    "filter": Filter((1,), "GTE", MatchA(0, "a", 1), (None, 2)),
    "transform": Transform((1,), 2, MatchA(0, "a", 1), "ADD", (None, 1)),
    "join": Join((0,), MatchA(0, "a", 1), MatchA(0, "b", 2)),
    "join_collection": Join((1,), MatchA(1, "b", 2), Project((0, 1), MatchA(0, "a", 1))),
    "union": Union((0,), (Project((0,), MatchA(0, "a", 1)), MatchAV(0, "b", 1))),
    "difference": Union((0,), (Project((0,), MatchA(0, "a", 1)), Negate(Project((0,), MatchA(0, "b", 1))))),
    "antijoin": Antijoin((0,), MatchA(0, "a", 1), Project((0,), MatchA(0, "b", 2))),
    "count": Aggregate((0, 1, 1, 1), MatchA(0, "a", 1), ("COUNT", "SUM", "MEDIAN"), (0,), (1, 1, 1)),
    "global": Aggregate((1,), MatchA(0, "a", 1), ("SUM",), (), (1,)),
    "hector": q([0, 2, 3], [B(0, "a", 1), B(1, "b", 2), B(0, "b", 3)]),
    "triangle": q([0, 1, 2], [B(0, "a", 1), B(1, "a", 2), B(0, "a", 2)]),
    "recursive": NameExpr((0, 1), "reach"),
}
REACH = Rule("reach", Union((0, 1), (MatchA(0, "a", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "reach"), MatchA(2, "a", 1))))))


@pytest.mark.parametrize("name", PLANS)
def test_incremental_equals_from_scratch(spark, name):
    random.seed(zlib.crc32(name.encode()))
    semantics = random.choice(("Raw", "Distinct"))
    d = Domain(spark)
    for a in ("a", "b"):
        d.create_attribute(a, AttributeConfig.uncompacted(semantics, value_type="Number"))
    d.register(REACH)
    facts_now = []
    for t in range(2):
        new = [(random.randrange(4), random.choice("ab"), random.randrange(4)) for _ in range(6)]
        gone = random.sample(facts_now, min(3, len(facts_now)))
        d.transact([Datom.add(*f) for f in new] + [Datom.retract(*f) for f in gone])
        facts_now += new
        if t < 1:
            d.advance_epoch(t + 1)
    want = sorted(map(repr, map(tuple, d.diffs(PLANS[name], 1).collect())))
    got = sorted(map(repr, map(tuple, epoch_diffs(d, PLANS[name], 1).collect())))
    assert got == want


def closure_of(edges):
    out, new = set(edges), set(edges)
    while new:
        new = {(a, d) for a, b in new for c, d in edges if b == c} - out
        out |= new
    return out


def test_recursion_on_cycles(spark):
    edges = {(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)}
    data = [facts(sorted(edges), "a"), [Datom.retract(3, "a", 1)]]
    got = run(spark, {"a": "Number"}, NameExpr((0, 1), "reach"), data, rules=(REACH,))
    assert got[0] == at(0, *closure_of(edges))
    assert got[1] == at(1, *(closure_of(edges) - closure_of(edges - {(3, 1)})), diff=-1)


def test_strata_and_missing_rules(spark):
    d = Domain(spark)
    d.create_attribute("a", AttributeConfig(value_type="Number"))
    d.register(
        Rule("bad", Antijoin((0,), MatchA(0, "a", 1), Project((0,), NameExpr((0, 1), "bad")))),
        Rule("loop", Union((0,), (NameExpr((0,), "loop"),))), Rule("lost", NameExpr((0,), "nowhere")), Rule("none", MatchA(0, "zzz", 1)))
    for name, error in (("bad", UnsupportedError), ("loop", IncorrectError), ("lost", NotFoundError), ("none", NotFoundError)):
        with pytest.raises(error):
            d.query(name)


# -- domains and time ----------------------------------------------------------
def test_domain(spark):
    d = Domain(spark)
    d.create_attribute("a", AttributeConfig(value_type="Number"))
    d.advance_epoch(1)
    d.advance_epoch(1)
    with pytest.raises(ConflictError):
        d.advance_epoch(0)
    with pytest.raises(ConflictError):
        d.transact([Datom.add_at(1, "a", 1, 0)])
    with pytest.raises(NotFoundError):
        d.transact([Datom.add(1, "zzz", 1)])
    with pytest.raises(ConflictError):
        d.create_attribute("a")
    d.close_input("a")
    with pytest.raises(ConflictError):
        d.transact([Datom.add(1, "a", 1)])
    other = Domain(spark)
    other.create_attribute("b")
    assert (d + other).epoch == 0 and d.dominates(other)
    with pytest.raises(ConflictError):
        d + d
    d.register(Rule("r", MatchA(0, "a", 1)))
    d.register(Rule("r", MatchA(0, "a", 1)))
    with pytest.raises(ConflictError):
        d.register(Rule("r", MatchA(1, "a", 0)))


def test_time_functions():
    assert [ft.coarsen(t, 10) for t in (0, 6, 11)] == [10, 10, 20]
    assert ft.coarsen_duration(timedelta(0), timedelta(seconds=10)) == timedelta(seconds=10)
    assert ft.coarsen_duration(timedelta(seconds=10, microseconds=5), timedelta(seconds=10)) == timedelta(seconds=20)
    assert ft.rewind(0, 1) == 0 and ft.rewind(10, 5) == 5
    assert ft.rewind(timedelta(milliseconds=12345), timedelta(milliseconds=45)) == timedelta(milliseconds=12300)
    assert not ft.pair_before((1, 2), (2, 1)) and ft.pair_join((1, 2), (2, 1)) == (2, 2) and ft.pair_meet((1, 2), (2, 1)) == (1, 1)


# -- requests ------------------------------------------------------------------
def test_json_requests(spark):
    e = Engine(spark)
    message = [
        {"CreateAttribute": {"name": "name", "config": {"input_semantics": "Distinct", "trace_slack": {"TxId": 1}}}},
        {"Transact": [[100, "name", {"String": "Ann"}, None, 1], [{"Eid": 200}, "name", "Bob", None, 1]]},
        {"Register": {"rules": [{"name": "all", "plan": {"MatchA": [0, "name", 1]}}]}},
        {"Interest": {"name": "all"}},
    ]
    assert {o.body for o in e.json_message(json.dumps(message))} == {(100, "Ann"), (200, "Bob")}
    assert e.json_message(json.dumps([{"Transact": [[100, "name", "Ann", None, -1]]}]))[0].diff == -1
    assert e.json_message("{")[0].body["category"] == "incorrect"
    assert e.json_message('[{"Interest": {"name": "none"}}]')[0].body["category"] == "not-found"
    assert e.json_message('["Setup"]')[0].body["category"] == "unsupported"
    assert e.json_message('[{"AdvanceDomain": ["x", 3]}]')[0].body["category"] == "unsupported"
    assert e.json_message('["Status"]')[0].body["interests"] == {"all": ["self"]}
    e.json_message('[{"Uninterest": "all"}]')
    assert not e.interests
    assert e.json_message('[{"Uninterest": "all"}]')[0].body["category"] == "not-found"
    e.json_message('["Shutdown"]')
    assert not e.running


def test_plans_from_json():
    for body, plan in (
        ({"Project": {"variables": [0], "plan": {"MatchAV": [0, "a", {"Number": 5}]}}}, Project((0,), MatchAV(0, "a", 5))),
        ({"Filter": {"variables": [1], "predicate": "LT", "plan": {"MatchA": [0, "a", 1]}, "constants": [None, {"Number": 3}]}}, Filter((1,), "LT", MatchA(0, "a", 1), (None, 3))),
        ({"Negate": {"NameExpr": [[0], "r"]}}, Negate(NameExpr((0,), "r"))),
        ({"Hector": {"variables": [0], "bindings": [{"Attribute": {"variables": [0, 1], "source_attribute": "a"}}]}}, q([0], [B(0, "a", 1)])),
        ({"GraphQl": {"query": "{a}"}}, GraphQl("{a}")),
    ):
        assert plan_from_json(body) == plan
    for bad in ({}, {"X": 1}, {"Project": {}}, 5):
        with pytest.raises(IncorrectError):
            plan_from_json(bad)


def test_late_registration_and_shared_interest(spark):
    e = Engine(spark)
    e.create_attribute("name", AttributeConfig.uncompacted("Distinct"))
    e.transact([Datom.add(1, "name", "Ann")])
    e.transact([Datom.add(2, "name", "Bob")])
    out = e.message([lambda: e.subscribe("name", "x"), lambda: e.subscribe("name", "y")])
    assert {o.body for o in out} == {(1, "Ann"), (2, "Bob")}
    e.disconnect("x")
    assert e.interests["subscribe/name"].clients == {"y"}


def test_granularity(spark):
    e = Engine(spark)
    e.create_attribute("n", AttributeConfig.uncompacted("LastWriteWins", value_type="Number"))
    e.register(Rule("r", MatchA(0, "n", 1)))
    e.interest("r", granularity=3)
    assert e.transact([Datom.add(1, "n", 1)]) == []
    assert e.transact([Datom.add(1, "n", 2)]) == []
    assert [(o.body, o.time, o.diff) for o in e.transact([Datom.add(1, "n", 3)])] == [((1, 3), 3, 1)]


def test_manual_advance(spark):
    e = Engine(spark, manual_advance=True)
    e.create_attribute("n", AttributeConfig(value_type="Number"))
    e.register(Rule("r", MatchA(0, "n", 1)))
    e.interest("r")
    assert e.transact([Datom.add(1, "n", 1)]) == [] and e.domain.epoch == 0
    assert [o.body for o in e.json_message('["Tick"]')] == [(1, 1)] and e.domain.epoch == 1


def test_derive(spark):
    e = Engine(spark)
    for a, k in (("name", "String"), ("available", "Eid")):
        e.create_attribute(a, AttributeConfig("Distinct", value_type=k))
    e.transact([*facts([(1, "A"), (2, "B")], "name"), Datom.add(9, "available", 1)])
    assert e.derive("shop", "{ available { name } }") == ["shop/name"]
    assert [tuple(r) for r in e.query(MatchA(0, "shop/name", 1)).collect()] == [(1, "A")]
    e.register(Rule("r", MatchA(0, "shop/name", 1)))
    e.interest("r")
    assert [(o.body, o.diff) for o in e.transact([])] == [((1, "A"), 1)]
    told = e.transact([Datom.retract(9, "available", 1), Datom.add(9, "available", 2)])
    assert {(o.body, o.diff) for o in told} == {((1, "A"), -1), ((2, "B"), 1)}
    with pytest.raises(NotFoundError):
        e.derive("x", "{ zzz }")


def test_configuration_and_introspection(spark):
    e = Engine.from_config(spark, {"tick": {"secs": 0, "nanos": 1_000_000}, "manual_advance": True, "enable_logging": True, "enable_optimizer": False})
    assert e.tick == 1 and e.domain.has("query/batch")
    e.listener.waiting = [Datom.add("q", "query/batch", 3)]
    assert list(e.serve(iter(['"Tick"']))) == []
    assert [tuple(r) for r in e.query(MatchA(0, "query/batch", 1)).collect()] == [("q", 3)]
    e.shutdown()


def test_two_dimensions_of_time(spark):
    from factflow.operators.attributes import snapshot_bitemporal

    rows = [(1, 5, 0, 0, 1), (1, 7, 1, 2, 1), (1, 6, 0, 1, 1), (2, 9, 0, 0, 1), (2, 9, 1, 1, -1)]
    df = spark.createDataFrame(rows, "e long, v long, _event long, _system long, _w long")
    at = lambda *t: {(r["e"], r["v"]) for r in snapshot_bitemporal(df, *t).collect()}
    assert at(0, 0) == {(1, 5), (2, 9)} and at(0, 1) == {(1, 6), (2, 9)} and at(1, 1) == {(1, 6)} and at(1, 2) == {(1, 7)}


# -- sinks and sources ---------------------------------------------------------
def test_assoc_in(spark):
    e = Engine(spark)
    for a in ("name", "age"):
        e.create_attribute(a, AttributeConfig.uncompacted("LastWriteWins"))
    from factflow.plans.ast import PullAll

    e.register(Rule("p", PullAll((), ("name", "age"))), Rule("p2", PullAll((), ("name", "age"))))
    e.interest("p", sink=AssocIn(None))
    e.interest("p2", sink=AssocIn(1))
    first = e.transact(facts([(1, "Ann", "7"), (2, "Bob", None)], "name", "age"))
    assert [o.body for o in first if o.name == "p"] == [{"age": "7", "name": "Ann"}, {"name": "Bob"}]
    second = e.transact([Datom.add(1, "age", "8")])
    assert [o.body for o in second if o.name == "p"] == [{"age": "8"}]
    assert [o.body for o in second if o.name == "p2"] == [{"age": "8", "name": "Ann"}]


def test_other_sinks(spark, tmp_path):
    e = Engine(spark)
    e.create_attribute("n", AttributeConfig(value_type="Number"))
    e.register(Rule("r", MatchA(0, "n", 1)), Rule("s", MatchA(0, "n", 1)))
    memory = MemorySink()
    e.interest("r", sink=TheVoid(str(tmp_path / "log")))
    e.interest("s", sink=memory)
    e.transact([Datom.add(1, "n", 1)])
    assert (tmp_path / "log").read_text().endswith(",0\n") and memory.rows == [("s", (1, 1), 0, 1)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,n\n# note\n1,Ann,5\n2,,6\n2,Bob,6\n")
    (tmp_path / "x.json").write_text('{"name": "Ann", "n": 1}\n{"n": 2}\n')
    spark.createDataFrame([(1, "Ann", 5), (2, None, 6)], "id long, name string, n long").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.register_source(CsvFile(str(tmp_path / "x.csv"), {"c/name": (1, "String"), "c/n": (2, "Number")}, has_headers=True, comment="#"))
    e.register_source(JsonFile(str(tmp_path / "x.json"), {"name": "String", "n": "Number"}))
    e.register_source(ParquetTable(str(tmp_path / "t"), "id", {"t/name": "name", "t/twice": "n * 2"}))
    rows = lambda a: sorted(tuple(r) for r in e.query(MatchA(0, a, 1)).collect())
    assert rows("c/name") == [(1, "Ann"), (2, "Bob")] and rows("c/n") == [(1, 5), (2, 6)]
    assert rows("name") == [(0, "Ann")] and rows("n") == [(0, 1), (1, 2)]
    assert rows("t/name") == [(1, "Ann")] and rows("t/twice") == [(1, 10), (2, 12)]
    with pytest.raises(IncorrectError):
        CsvFile("x", {"a": (0, "Bool")}).read(spark)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,Ann\n2,Bob\n")
    e = Engine(spark)
    memory = MemorySink()
    query = e.attach_csv(CsvFile(str(tmp_path / "in"), {"name": (1, "String")}), str(tmp_path / "ck"), availableNow=True)
    e.register(Rule("r", MatchA(0, "name", 1)))
    e.interest("r", sink=memory)
    query.awaitTermination(60)
    assert query.exception() is None
    assert sorted(r[1] for r in memory.rows) == [(1, "Ann"), (2, "Bob")] or sorted(tuple(r) for r in e.query("r").collect()) == [(1, "Ann"), (2, "Bob")]
    from factflow.sources import introspection

    introspection.create(e.domain)
    e.transact(introspection.progress_datoms(query))
    assert e.query(MatchA(0, "query/input-rows", 1)).count() == 1


# -- plan shapes ---------------------------------------------------------------
def test_star_is_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2, 3.0)], "k long, x string, y long, z double").write.parquet(str(tmp_path / "w"))
    d = Domain(spark)
    d.add_table("w", spark.read.parquet(str(tmp_path / "w")), "k", {"x": "x", "y": "y"})
    for plan in (Join((0,), MatchA(0, "x", 1), MatchA(0, "y", 2)), q([0, 1, 2], [B(0, "x", 1), B(0, "y", 2)])):
        text = d.query(plan).df._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1 and "Join" not in text and "z" not in text.split("ReadSchema")[1]
        assert "IsNotNull(x)" in text
    text = d.query(MatchAV(0, "x", "a")).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x,a)" in text
