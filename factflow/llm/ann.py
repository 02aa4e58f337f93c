"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of
random signs and a Walsh-Hadamard transform) and hashed to the nearest signed
axis. Each of a few tables joins as many of these hashes as the number of vectors
asks for, so that buckets do not grow with it; a query looks up, in each table,
the buckets whose axes it is nearest to. Candidates are reranked by the exact
Euclidean distance of the original vectors.

How many buckets a query looks up is learned: for a sample of at most
``SAMPLE_QUERIES`` queries the exact neighbours are found in one pass over all
rows, and the fewest buckets are taken in which ``RECALL`` of these lie. Data in
clusters so need few, random directions many.

Rows and probes meet by (table, bucket). A bucket of more than ``CHUNK`` rows is
cut into chunks, each met by every query that probes the bucket, so no candidate
is dropped and no task gathers a bucket: it holds one chunk, lets the queries
stream by, and passes on each query's nearest of the chunk only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
numbers take no part, nor do rows without an id; only vectors of equal length
are compared, and very long ones are hashed whole; a row is never its own
neighbour, but another row with the same id, or a repeated row, is a candidate;
equal distances rank by the smaller id; a query for which
the buckets gave fewer than ``k`` meets all rows in a further round, so that it
gets ``k`` of them, or all if there are fewer; further columns, whatever they are
called, are not read and not passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import scratch, settle, table

TABLES = 2
#: Rows of a bucket, expected at most, up to ``MOST_HASHES`` (of 64 numbers: 1e11
#: vectors); beyond, buckets have more chunks.
BUCKET_ROWS = 1 << 16
MOST_HASHES = 3
CHUNK = 8192
SEED = 20
#: Queries whose exact neighbours tell how many buckets are looked up, and the
#: share of these neighbours that lie in them.
SAMPLE_QUERIES = 64
RECALL = 0.96


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """Hashes of vectors of one length, the same on every machine."""

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = 1, seed: int = SEED):
        self.dim, self.tables, self.hashes = dim, tables, hashes
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.buckets = (2 * self.size) ** hashes
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def _turned(self, unit: np.ndarray, t: int, k: int) -> np.ndarray:
        x = np.zeros((len(unit), self.size))
        x[:, : self.dim] = unit
        for s in self.signs[t, k]:
            x = hadamard(x * s)
        return x

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for k in range(self.hashes):
                x = self._turned(unit, t, k)
                axis = np.abs(x).argmax(axis=1)
                code = 2 * axis + (x[np.arange(len(x)), axis] > 0)
                out[:, t] = out[:, t] * 2 * self.size + code
        return out

    def probes(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest buckets of each row in each table: (rows, tables, probes);
        joined hashes are ranked by the sum of their squared shortfalls."""
        probes = min(probes, self.buckets)
        at_once = max(1, (1 << 22) // self.buckets)  # rows whose buckets are ranked together
        if len(unit) > at_once:
            return np.concatenate([self.probes(unit[s : s + at_once], probes) for s in range(0, len(unit), at_once)])
        out = np.zeros((len(unit), self.tables, probes), np.int64)
        for t in range(self.tables):
            code, lack = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
            for k in range(self.hashes):
                x = self._turned(unit, t, k)
                value = np.stack([-x, x], axis=2).reshape(len(x), -1)
                best = np.argsort(-value, axis=1, kind="stable")[:, :probes]
                v = np.take_along_axis(value, best, axis=1)
                short = (v[:, :1] - v) ** 2
                code = (code[:, :, None] * 2 * self.size + best[:, None, :]).reshape(len(x), -1)
                lack = (lack[:, :, None] + short[:, None, :]).reshape(len(x), -1)
                order = np.argsort(lack, axis=1, kind="stable")[:, :probes]
                code, lack = np.take_along_axis(code, order, axis=1), np.take_along_axis(lack, order, axis=1)
            out[:, t] = code
        return out


def hash_count(n: int, dim: int) -> int:
    """Hashes joined in a table over ``n`` vectors."""
    axes = 2 << max(1, (dim - 1).bit_length())
    return min(MOST_HASHES, max(1, math.ceil(math.log(max(1, n) / BUCKET_ROWS) / math.log(axes))))


_HASHERS: dict = {}


def _hasher(dim: int, tables: int, hashes: int) -> CrossPolytope:
    key = (dim, tables, hashes)
    if key not in _HASHERS:
        _HASHERS[key] = CrossPolytope(*key)
    return _HASHERS[key]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepare(vectors: DataFrame, id_col: str, vector_col: str, tables: int, hashes: int | None) -> DataFrame:
    """(uid, id, dim, vec, codes) of the rows that take part; ``vec`` holds the
    numbers in their own precision. Written out, so that ``uid`` stays as it is."""
    v = F.col(vector_col).cast("array<double>")
    kind = _kind(vectors, vector_col)
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    n = rows.count() if hashes is None else 0

    def run(batches):
        for b in batches:
            v = b.column(2)
            sizes = v.value_lengths().to_numpy()
            flat, at = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            vec, codes = [None] * b.num_rows, [None] * b.num_rows
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = flat[at[own][:, None] + np.arange(dim)]
                made = _hasher(int(dim), tables, hashes or hash_count(n, int(dim))).codes(_unit(x))
                for k, row, c in zip(own, x.astype(kind), made, strict=True):
                    vec[k], codes[k] = row.tobytes(), c
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes.astype(np.int32)), pa.array(vec, pa.binary()), pa.array(codes, pa.list_(pa.int64()))],
                names=["uid", "id", "dim", "vec", "codes"])

    out = settle(rows.mapInArrow(run, "uid long, id long, dim int, vec binary, codes array<long>"))
    out._count = n
    return out


def _kind(vectors: DataFrame, vector_col: str) -> type:
    """Numbers are sent in single precision where the column has no more."""
    return np.float32 if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else np.float64


def probed_share(rows: DataFrame, is_query: Column, k: int, tables: int, hashes, kind: type) -> float:
    """The least share of a table's buckets in which ``RECALL`` of the exact
    neighbours of the sampled queries lie; ``hashes``: of a dimension."""
    sample = rows.where(is_query).orderBy(F.xxhash64("uid")).limit(SAMPLE_QUERIES).select("uid", "dim", "vec").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append((r["uid"], np.frombuffer(r["vec"], kind).astype(float)))
    asked = {dim: (np.array([u for u, _ in own]), np.stack([x for _, x in own])) for dim, own in by_dim.items()}
    held = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        best: dict[int, list] = {}
        for b in batches:
            dims, vec, codes = b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for dim, (who, q) in held.value.items():
                own = np.flatnonzero(dims == dim)
                if not len(own):
                    continue
                c = np.stack([np.frombuffer(vec[i], kind) for i in own]).astype(float)
                uid = b.column(0).to_numpy()[own]
                row, col, score = _nearest(who, q, uid, uid, c, k)
                for r, i, s in zip(row.tolist(), col.tolist(), score.tolist(), strict=True):
                    best.setdefault(int(who[r]), []).append((s, int(uid[i]), codes[own[i]]))
            best = {u: sorted(x)[:k] for u, x in best.items()}
        flat = [(u, *x) for u, own in best.items() for x in own]
        cols = list(zip(*flat, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["q", "score", "uid", "codes"])

    near = rows.select("uid", "dim", "vec", "codes").mapInArrow(run, "q long, score double, uid long, codes array<long>")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("score", "uid"))).where(F.col("n") <= k).collect()
    ranks = []
    for dim, (who, q) in asked.items():
        hasher = _hasher(dim, tables, hashes(dim))
        for i, u in enumerate(who.tolist()):
            order = hasher.probes(_unit(q[i : i + 1]), hasher.buckets)[0]
            for codes in (r["codes"] for r in near if r["q"] == u):
                ranks.append(min(int(np.flatnonzero(order[t] == c)[0]) + 1 for t, c in enumerate(codes)) / hasher.buckets)
    return float(np.quantile(ranks, RECALL, method="higher")) if ranks else 1.0


def _probed(queries: DataFrame, tables: int, hashes, share: float | None, probes: int | None, kind: type) -> DataFrame:
    """(uid, id, dim, vec, t, code): a row for each bucket that a query probes."""

    def run(batches):
        for b in batches:
            dims, vec = b.column(2).to_numpy(), b.column(3).to_pylist()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                hasher = _hasher(int(dim), tables, hashes(int(dim)))
                x = np.stack([np.frombuffer(vec[k], kind) for k in own]).astype(float)
                made = hasher.probes(_unit(x), math.ceil(share * hasher.buckets) if probes is None else probes)
                n, each = len(own), made.shape[1] * made.shape[2]
                take = pa.array(np.repeat(own, each))
                t = np.tile(np.repeat(np.arange(made.shape[1]), made.shape[2]), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in range(4)), pa.array(t), pa.array(made.reshape(-1))],
                    names=["uid", "id", "dim", "vec", "t", "code"])

    return queries.select("uid", "id", "dim", "vec").mapInArrow(run, "uid long, id long, dim int, vec binary, t int, code long")


def _nearest(q_uid, q, c_uid, c_id, c, k: int):
    """Each query's k nearest of one chunk, by exact distance and id; products
    find the few that can be among them."""
    rough = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * q @ c.T
    slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
    rough[q_uid[:, None] == c_uid[None]] = np.inf
    if len(c) > k:
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
    else:
        bound = np.full(len(q), np.finfo(float).max)
    row, col = np.nonzero(rough <= bound[:, None])
    d = q[row] - c[col]
    score = np.sqrt((d * d).sum(axis=1))
    order = np.lexsort((c_uid[col], c_id[col], score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep], score[keep]


def _meet(batches, k: int, kind: type):
    """Over a partition sorted by dim, t, code, chunk and role: rows of a chunk
    (role 0) are held, its queries (role 1) stream by."""
    held, key = [], None
    chunk = None
    for b in batches:
        keys = np.stack([b.column(x).to_numpy().astype(np.int64) for x in range(4)], axis=1)
        role = b.column(4).to_numpy()
        vec = b.column(7)
        cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (role[1:] != role[:-1])) + 1).tolist(), len(role)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e == s:
                continue
            own = tuple(keys[s])
            if own != key:
                key, held, chunk = own, [], None
            uid, ids = b.column(5).slice(s, e - s).to_numpy(), b.column(6).slice(s, e - s).to_numpy()
            x = np.frombuffer(b"".join(vec.slice(s, e - s).to_pylist()), kind).reshape(e - s, own[0]).astype(float)
            if role[s] == 0:
                held.append((uid, ids, x))
                chunk = None
            elif held:
                if chunk is None:
                    chunk = tuple(np.concatenate(y) for y in zip(*held, strict=True))
                row, col, score = _nearest(uid, x, *chunk, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[row]), pa.array(ids[row]), pa.array(chunk[0][col]), pa.array(chunk[1][col]), pa.array(score)],
                    names=["q_uid", "query_id", "uid", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                       tables: int = TABLES, hashes: int | None = None, probes: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for
    which ``is_query`` (a condition on the column ``id``) holds. The hashes of a
    table and the buckets that are looked up follow from the data, if not given."""
    with scratch() as left:
        kind = _kind(vectors, vector_col)
        rows = prepare(vectors, id_col, vector_col, tables, hashes)
        n = rows._count
        joined = lambda dim: hashes or hash_count(n, dim)
        share = probed_share(rows, is_query, k, tables, joined, kind) if probes is None else None
        placed = rows.select("uid", "id", "dim", "vec", F.posexplode("codes").alias("t", "code"))
        sizes = placed.groupBy("dim", "t", "code").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        index = placed.join(sizes, ["dim", "t", "code"]).withColumn("chunk", F.pmod(F.xxhash64("uid", "t"), F.col("chunks")).cast("int"))
        asked = _probed(rows.where(is_query), tables, joined, share, probes, kind).join(sizes, ["dim", "t", "code"])
        top = settle(_ranked(index, asked, k, kind))
        # queries for which too few were found meet every row of their length
        peers = rows.groupBy("dim").agg((F.count("*") - 1).alias("peers"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        got = top.groupBy(F.col("q_uid").alias("uid")).agg(F.count("*").alias("got"))
        short = rows.where(is_query).select("uid", "id", "dim", "vec").join(got, "uid", "left").join(peers, "dim")
        short = settle(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("peers"))).select("uid", "id", "dim", "vec", "chunks"))
        if not short.isEmpty():
            one = {"t": F.lit(0), "code": F.lit(0).cast("long")}
            dims = F.broadcast(short.select("dim", "chunks").distinct())
            index = rows.select("uid", "id", "dim", "vec").join(dims, "dim").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
            again = _ranked(index.withColumns(one), short.withColumns(one), k, kind)
            top = settle(top.join(short.select(F.col("uid").alias("q_uid")), "q_uid", "left_anti").union(again.select(top.columns)))
        left.append(top)
    return top.select("query_id", "rank", "vec_id", "score")


def _ranked(index: DataFrame, asked: DataFrame, k: int, kind: type) -> DataFrame:
    """(q_uid, query_id, rank, vec_id, score): the ``k`` nearest of each query
    among the rows that it meets; each query meets all chunks of its bucket."""
    spark = index.sparkSession
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["dim", "t", "code", "chunk", "role", "uid", "id", "vec"]
    both = index.withColumn("role", F.lit(0)).select(names).union(asked.withColumn("role", F.lit(1)).select(names))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = (
        both.repartition(parts, "dim", "t", "code", "chunk").sortWithinPartitions("dim", "t", "code", "chunk", "role")
        .mapInArrow(lambda it: _meet(it, k, kind), "q_uid long, query_id long, uid long, vec_id long, score double")
    )
    found = met.groupBy("q_uid", "query_id", "uid", "vec_id").agg(F.first("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("q_uid").orderBy("score", "vec_id", "uid"))
    return found.select("q_uid", "query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)
