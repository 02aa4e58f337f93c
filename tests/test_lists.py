"""Tuples extended by lists of integers, without a row for every value proposed."""

import random
from collections import Counter

import pytest

from factflow.operators import hector
from factflow.plans.ast import AttributeBinding as B
from factflow.plans.ast import q
from factflow.plans.compile import result_columns
from factflow.streaming.domain import Domain

FAR = 1 << 62


def some_edges():
    rng = random.Random(8)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(250)} | {(0, k) for k in range(60)} | {(1, k) for k in range(60)}
    return edges | {(k, v) for k in (-5, 3, 4) for v in (-FAR, -5, 3, 4, 300, 1000, FAR)} | {(3, None), (None, 3), (None, None), (4, None)}


def closed(edges):
    rest = [(a, b) for a, b in edges if a is not None and b is not None]
    return Counter((a, b, c) for a, b in rest for b2, c in rest if b2 == b and (a, c) in edges)


@pytest.mark.parametrize("most", [2048, 12, 0])
def test_cycles_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(hector, "LIST", most, raising=False)
    edges = some_edges()
    df = spark.createDataFrame(sorted(edges, key=repr), "e long, v long")
    assert Counter(tuple(x) for x in hector.triangles(df).collect()) == closed(edges)
    d = Domain(spark)
    d.add_derived("edge", df)
    r = d.query(q([0, 1, 2], [B(0, "edge", 1), B(1, "edge", 2), B(0, "edge", 2)]))
    assert Counter(tuple(x) for x in result_columns(r).collect()) == closed(edges)


def test_short_lists_are_sent_as_lists(spark):
    df = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "e int, v int")
    out = hector.triangles(df)
    assert out.count() == 8000 and {t for _, t in out.dtypes} == {"int"}
    # each proposed value was a row of a join when it was checked
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_an_entity_with_facts_without_values_has_an_empty_list():
    import numpy as np
    import pyarrow as pa

    pack, common = hector._coding()
    lists = [[], [5], [7, 3, 3 + 255, 3 + 256 * 5], [-FAR, FAR], list(range(900, 0, -2))]
    [packed] = pack([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(lists, pa.list_(pa.int64()))], ["k", "l"])])
    x = packed.column(1)
    got = list(common([pa.RecordBatch.from_arrays([pa.array(range(5)), x, x], ["k", "_l0", "_l1"])]))
    pairs = [(k, v) for b in got for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert pairs == [(k, v) for k, own in enumerate(lists) for v in np.sort(own).tolist()]
