"""The queries over every line's edge, against brute force on a small table
whose rows a predicate or a modulo would cut or fold."""

from collections import Counter

import pytest

from factflow.queries import QUERIES

#: (supplier, part); parts from 100 on would be folded, quantities and line numbers would cut all but one row.
PAIRS = [(1, 2), (1, 2), (2, 3), (1, 3), (3, 1), (3, 104), (4, 205), (2, 1), (5, 5), (104, 4)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    rows = [(k, s, p, 50.0 if k == 0 else 7.0, 1 if k < 2 else 2) for k, (s, p) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_linenumber int")
    df.write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def closure(edges):
    """{(a, b): parities of the lengths of walks from a to b}."""
    walks, news = set(), {(a, b, 1) for a, b in edges}
    while news:
        walks |= news
        news = {(a, v, 1 - k) for a, b, k in news for e, v in edges if e == b} - walks
    return walks


def want(name):
    edges = set(PAIRS)
    walks = closure(edges)
    reach = {(a, b) for a, b, _ in walks}
    triangles = [(a, b, c) for a, b in edges for b2, c in edges if b2 == b and (a, c) in edges]
    return Counter({
        "hector_triangle": triangles, "triangle_intersection": triangles, "hector_not": [(a, b) for a, b in edges if (b, a) not in edges],
        "recursive_reach": reach, "recursive_nonlinear": reach, "recursive_mutual": [(a, b) for a, b, k in walks if k == 0],
        "rule_reference": Counter(a for a, _ in reach).items(),
    }[name])


@pytest.mark.parametrize("name", ["hector_triangle", "triangle_intersection", "hector_not", "recursive_reach", "recursive_nonlinear", "recursive_mutual", "rule_reference"])
def test_whole_edges(spark, sf, name):
    assert Counter(tuple(r) for r in QUERIES[name](spark, sf).collect()) == want(name)


def test_a_long_chain_is_known_from_few_folders(spark, tmp_path, monkeypatch):
    import os

    from factflow import storage
    from factflow.plans.ast import Join, MatchA, NameExpr, Project, Rule, Union
    from factflow.streaming.domain import Domain

    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    d = Domain(spark)
    d.add_derived("edge", spark.createDataFrame([(k, k + 1) for k in range(40)], "e long, v long"))
    d.register(Rule("reach", Union((0, 1), (MatchA(0, "edge", 1), Project((0, 1), Join((2,), NameExpr((0, 2), "reach"), MatchA(2, "edge", 1)))))))
    r = d.query("reach")
    assert {tuple(x) for x in r.df.collect()} == {(a, b) for a in range(41) for b in range(a + 1, 41)}
    scans = r.df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans <= 6 and len(os.listdir(tmp_path)) == scans
