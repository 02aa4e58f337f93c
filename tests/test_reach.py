"""Walks over classes of nodes, against brute force."""

import os
import random
from collections import Counter

import pytest

from factflow import storage
from factflow.operators import reach
from factflow.plans import compile as compiling
from factflow.plans.ast import Join, MatchA, NameExpr, Project, Rule, Union
from factflow.streaming.domain import Domain

EDGE = MatchA(0, "edge", 1)


def walk(left, right):
    return Project((0, 1), Join((2,), left, right))


RULES = {
    "after": (Rule("r", Union((0, 1), (EDGE, walk(NameExpr((0, 2), "r"), MatchA(2, "edge", 1))))),),
    "before": (Rule("r", Union((0, 1), (EDGE, walk(MatchA(0, "edge", 2), NameExpr((2, 1), "r"))))),),
    "twice": (Rule("r", Union((0, 1), (EDGE, walk(NameExpr((0, 2), "r"), NameExpr((2, 1), "r"))))),),
    "even": (Rule("s", Union((0, 1), (EDGE, walk(NameExpr((0, 2), "r"), MatchA(2, "edge", 1))))),
             Rule("r", Union((0, 1), (walk(NameExpr((0, 2), "s"), MatchA(2, "edge", 1)),)))),
    "other": (Rule("r", Union((0, 1), (EDGE, walk(NameExpr((0, 2), "r"), MatchA(2, "way", 1))))),),
    "other before": (Rule("r", Union((0, 1), (EDGE, walk(MatchA(0, "way", 2), NameExpr((2, 1), "r"))))),),
}


def want(kind, edges, way):
    step = way if kind.startswith("other") else edges
    found, news = set(), {(a, b, 1) for a, b in edges}
    while news:
        found |= news
        meet = (lambda a, b, k: {(e, b, 1 - k) for e, v in step if v == a and v is not None}) if kind == "other before" else (lambda a, b, k: {(a, v, 1 - k) for e, v in step if e == b and e is not None})
        news = {x for y in news for x in meet(*y)} - found
    return {(a, b) for a, b, k in found if kind != "even" or k == 0}


@pytest.mark.parametrize("local", [0, 1000])
def test_walks_equal_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(compiling, "CLASS_EDGES", 0)
    monkeypatch.setattr(reach, "LOCAL_EDGES", local)
    monkeypatch.setattr(reach, "CHUNK", 2)
    rng = random.Random(3 + local)
    ring = [(k, (k + 1) % 4) for k in range(4)]
    edges = set(ring) | {(rng.randrange(-2, 14), rng.randrange(-2, 14)) for _ in range(16)} | {(20, 21), (21, 20), (22, 22), (22, 23), (None, 3), (5, None), (None, None)}
    way = {(rng.randrange(-2, 14), rng.randrange(-2, 14)) for _ in range(12)} | {(2, None), (None, 1)}
    for kind in RULES if local else ("after", "even"):
        d = Domain(spark)
        for name, own in (("edge", edges), ("way", way)):
            d.add_derived(name, spark.createDataFrame(sorted(own, key=repr) , "e long, v long"))
        d.register(*RULES[kind])
        assert Counter(tuple(x) for x in d.query("r").df.collect()) == Counter(want(kind, edges, way)), kind


def test_a_large_class_is_written_as_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(compiling, "CLASS_EDGES", 0, raising=False)
    d = Domain(spark)
    edges = [(k, (k + j) % 300) for k in range(300) for j in (1, 2, 150)]
    d.add_derived("edge", spark.createDataFrame([*edges, (0, 1000), (299, 1001)], "e long, v long"))
    d.register(*RULES["after"])
    r = d.query("r").df
    assert r.count() == r.distinct().count() == 300 * 302
    assert sum(spark.read.parquet(f"{tmp_path}/{p}").count() for p in os.listdir(tmp_path)) <= 4  # 90,600 when each pair was written
