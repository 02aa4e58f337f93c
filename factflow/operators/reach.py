"""Which nodes walks lead to, without a row for every walk.

Nodes that reach each other reach the same. They become one class, the closure is
made over the classes, and its pairs are kept as blocks: a list of nodes and a
list of nodes that all of these reach. Blocks are written; the pairs are made when
they are read, once each. A block has some ``CHUNK`` squared pairs at most, so no
task or row holds a large class.

Classes (strongly connected components) are found among the edges whose ends both
have edges in and out. As long as these are more than ``LOCAL_EDGES``, every node
takes the greatest mark that reaches it; who reaches the mark's own node within the
mark is its class, and edges between marks are in no class and go. What is left,
once it is few edges, is searched by one task (Tarjan).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.storage import discard, settle

#: Edges that one task searches: some 600 MB.
LOCAL_EDGES = 4_000_000
#: Nodes of a block's list, in the mean at most.
CHUNK = 1024


def _tarjan() -> Callable:
    """The search as a function of its own, which is sent to the executors whole: they
    need not have this package."""

    def tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(s, t) of all edges to (v, c): nodes of classes of two at least, and the
        smallest node of the class."""
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        s, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, at = np.unique(np.concatenate([s, t]), return_inverse=True)
        n, s, t = len(ids), at[: len(s)], at[len(s) :]
        order = np.argsort(s, kind="stable")
        first = np.searchsorted(s[order], np.arange(n + 1)).tolist()
        heads = t[order].tolist()
        place, low, mark, own = first[:-1], [0] * n, [0] * n, [-1] * n
        stack: list[int] = []
        turn = 0
        for root in range(n):
            if mark[root]:
                continue
            path = [root]
            while path:
                v = path[-1]
                if not mark[v]:
                    turn += 1
                    mark[v] = low[v] = turn
                    stack.append(v)
                deeper = False
                while place[v] < first[v + 1]:
                    w = heads[place[v]]
                    place[v] += 1
                    if not mark[w]:
                        path.append(w)
                        deeper = True
                        break
                    if own[w] < 0 and mark[w] < low[v]:
                        low[v] = mark[w]
                if deeper:
                    continue
                path.pop()
                if low[v] == mark[v]:
                    while True:
                        w = stack.pop()
                        own[w] = v
                        if w == v:
                            break
                if path and low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
        own = np.array(own)
        least = np.full(n, n)
        np.minimum.at(least, own, np.arange(n))
        kept = np.bincount(own, minlength=n)[own] > 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array(ids[least[own[kept]]])], ["v", "c"])

    return tarjan


def _core(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle of several nodes."""
    out, into = edges.select(F.col("s").alias("t")).distinct(), edges.select(F.col("t").alias("s")).distinct()
    return settle(edges.where("s <> t").join(out, "t", "left_semi").join(into, "s", "left_semi").select("s", "t").distinct())


def _marks(edges: DataFrame) -> DataFrame:
    """(v, k): the greatest mark of the nodes that reach v; a mark is a hash and
    its node, so that marks meet early on long ways."""
    own = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("r")).alias("k")
    state = settle(edges.select(F.col("s").alias("v")).union(edges.select("t")).distinct().select("v", own))
    news = state
    while True:
        offered = news.withColumnRenamed("v", "s").join(edges, "s").groupBy(F.col("t").alias("v")).agg(F.max("k").alias("_k"))
        more = settle(offered.join(state, "v").where("_k > k").select("v", F.col("_k").alias("k")))
        done = more.isEmpty()
        if not done:
            after = settle(state.join(more.withColumnRenamed("k", "_k"), "v", "left").select("v", F.coalesce("_k", "k").alias("k")))
        if news is not state:
            discard(news)
        if done:
            discard(more)
            return state
        discard(state)
        state, news = after, more


def classes(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(v, c) of the nodes that reach another one and are reached by it; c is one
    of the class. Written out."""
    local = LOCAL_EDGES if local_edges is None else local_edges
    rest, found = _core(edges), []
    while n := rest.count():
        if n <= local:
            found.append(settle(rest.repartition(1).mapInArrow(_tarjan(), "v long, c long")))
            break
        marks = _marks(rest)
        of = lambda end: marks.select(F.col("v").alias(end), F.col("k.r").alias(f"_{end}"))
        same = settle(rest.join(of("s"), "s").join(of("t"), "t").where("_s = _t").select("s", "t", F.col("_s").alias("c")))
        news = settle(marks.where("k.r = v").select("v", F.col("v").alias("c")))
        discard(marks)
        parts, known = [news], news
        while True:
            before = news.select(F.col("v").alias("t")).join(same, "t").select(F.col("s").alias("v"), "c").distinct()
            news = settle(before.join(known, "v", "left_anti"))
            parts.append(news)
            if news.isEmpty():
                break
            known = known.union(news)
        several = known.groupBy("c").count().where("count > 1")
        found.append(settle(known.join(several, "c", "left_semi").select("v", "c")))
        gone = known.select("v")
        left = same.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti").select("s", "t")
        after = _core(left)
        for df in (rest, same, *parts):
            discard(df)
        rest = after
    discard(rest)
    if len(found) == 1:
        return found[0]
    out = edges.sparkSession.createDataFrame([], "v long, c long")
    for df in found:
        out = out.union(df)
    out = settle(out)
    for df in found:
        discard(df)
    return out


def between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(e, v): the edges between classes; a node in none is its own. Of a class of
    several there is an edge to itself."""
    to = lambda end: members.toDF(end, f"_{end}")
    df = edges.join(to("s"), "s", "left").join(to("t"), "t", "left")
    return settle(df.select(F.coalesce("_s", "s").alias("e"), F.coalesce("_t", "t").alias("v")).distinct())


def _lists(df: DataFrame, key: str, value: str) -> DataFrame:
    """A key's values in lists of some ``CHUNK``."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    dealt = df.join(sizes, key).withColumn("_k", F.pmod(F.xxhash64(value), "_n"))
    return dealt.groupBy(key, "_k").agg(F.collect_list(value).alias(value)).drop("_k")


def blocks(reach: DataFrame, members: DataFrame, starts: Callable, ends: Callable) -> DataFrame:
    """(a, b): lists of nodes and of what all of these reach. ``reach``: (x, y) of
    classes; ``starts(c)`` and ``ends(c)`` tell which nodes count."""
    spark = reach.sparkSession
    several = members.select("c").distinct()
    own = members.where(starts(F.col("v"))).select(F.col("c").alias("x"), F.col("v").alias("a"))
    # to single nodes: a class's nodes, in lists, with the lists of what it reaches
    single = reach.join(several.toDF("y"), "y", "left_anti").where(ends(F.col("y")))
    wide = _lists(single.join(several.toDF("x"), "x", "left_semi").select("x", F.col("y").alias("b")), "x", "b").join(_lists(own, "x", "a"), "x")
    narrow = single.join(several.toDF("x"), "x", "left_anti").where(starts(F.col("x")))
    narrow = _lists(narrow.select("x", F.col("y").alias("b")), "x", "b").withColumn("a", F.array("x"))
    # to classes: who reaches one, in lists, with the lists of its nodes
    toward = reach.join(several.toDF("y"), "y", "left_semi")
    who = toward.join(own, "x").select("y", "a").union(toward.join(several.toDF("x"), "x", "left_anti").where(starts(F.col("x"))).select("y", F.col("x").alias("a")))
    there = members.where(ends(F.col("v"))).select(F.col("c").alias("y"), F.col("v").alias("b"))
    into = _lists(who, "y", "a").join(_lists(there, "y", "b"), "y")
    df = wide.select("a", "b").union(narrow.select("a", "b")).union(into.select("a", "b"))
    return settle(df.repartition(4 * spark.sparkContext.defaultParallelism))
