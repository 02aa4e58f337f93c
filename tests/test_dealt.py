"""More rows give more tasks, not larger ones."""

from collections import Counter

from pyspark.sql import functions as F

from factflow.operators import relation
from factflow.queries import QUERIES, tables


def test_edges_of_many_lines_are_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(relation, "TASK_ROWS", 20, raising=False)
    pairs = [(k % 37, k * 7 % 53) for k in range(400)] + [(1, 1)] * 5
    spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = tables(spark, str(tmp_path)).source().pairs("edge")[0]
    shares = [r["n"] for r in edges.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(shares) == len(set(pairs)) and max(shares) < 50  # four tasks, as the session says, had 100 each
    want = Counter((a, b) for a, b in set(pairs) if (b, a) not in set(pairs))
    assert Counter(tuple(r) for r in QUERIES["hector_not"](spark, str(tmp_path)).collect()) == want
