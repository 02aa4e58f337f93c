"""Bindings whose entities nobody asks for: counted before they meet."""

from collections import Counter

from factflow.plans import compile as compiling
from factflow.plans.ast import AttributeBinding as B
from factflow.plans.ast import q
from factflow.plans.compile import result_columns
from factflow.streaming.domain import Domain


def test_entities_are_counted_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(compiling, "COPIES", 7, raising=False)
    d = Domain(spark)
    d.add_derived("left", spark.createDataFrame([(k, k % 3) for k in range(30)] + [(40, 9), (41, None)], "e long, v long"))
    d.add_derived("right", spark.createDataFrame([(k, k % 2) for k in range(12)] + [(50, None)], "e long, v long"))
    d.add_derived("name", spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "e long, v string"))
    r = d.query(q([2, 3], [B(0, "left", 2), B(1, "right", 2), B(2, "name", 3)]))
    assert r.df.count() <= 3  # 120 rows when each met each
    assert Counter(tuple(x) for x in result_columns(r).collect()) == {(0, "a"): 60, (1, "b"): 60}


def test_ranges_that_do_not_meet_propose_nothing(spark, tmp_path, monkeypatch):
    import os
    import random

    from factflow import storage
    from factflow.operators import hector

    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    rng = random.Random(5)
    # nodes 0 to 9 lead to each other; 100 to 109 are led to, and lead to 1000 and more only
    edges = {(rng.randrange(10), rng.randrange(10)) for _ in range(40)} | {(k, 100 + k) for k in range(10)} | {(100 + k, 1000 + j) for k in range(10) for j in range(5)}
    got = hector.triangles(spark.createDataFrame(sorted(edges), "e long, v long"))
    want = Counter((a, b, c) for a, b in edges for b2, c in edges if b2 == b and (a, c) in edges)
    assert Counter(tuple(x) for x in got.collect()) == want
    [folder] = os.listdir(tmp_path)
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/{folder}").select("v1").collect()} <= set(range(10))


def test_rows_of_one_value_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from factflow.operators import algebra
    from factflow.plans.ast import Join, MatchA

    monkeypatch.setattr(algebra, "CHUNK", 8, raising=False)
    rows = [(k, 1 if k < 90 else None if k < 92 else 2) for k in range(100)]
    d = Domain(spark)
    for name in ("one", "other"):
        d.add_derived(name, spark.createDataFrame(rows, "e long, v long"))
    df = d.query(Join((1,), MatchA(0, "one", 1), MatchA(2, "other", 1))).df
    assert Counter(tuple(x) for x in df.collect()) == Counter((v, a, b) for a, v in rows for b, w in rows if v == w and v is not None)
    shares = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(shares) < 90 * 90 / 2  # one task made all rows of a value
