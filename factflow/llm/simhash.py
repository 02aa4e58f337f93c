"""SimHash near-duplicates: fingerprints, then a binary-trie Hamming self-join.

1. Fingerprints: one pass over the texts, Arrow batches in, 8 bytes a row out.
2. Distinct fingerprints are dealt by the blocks of the pigeonhole principle:
   two that differ in at most ``budget`` bits agree on at least ``m - budget``
   of ``m`` blocks, so each is sent once for every choice of that many blocks.
   ``m`` follows from how many fingerprints there are, so a group stays small;
   a group of more than ``CHUNK`` is dealt again, by ``budget + 1`` blocks of the
   bits on which its members need not agree (two within the budget agree on one of
   these at least); what is still larger is cut into chunks that meet by pairs, so
   no task holds more than two chunks of a group at a time.
3. Within a task the fingerprints of a group stand sorted, which is their
   binary trie: a node is a range, its children are split by the next bit. Node
   pairs are followed together from the roots, differing bits add up, and a
   pair over the budget is pruned. All groups of a slab are walked at once.
4. A task returns a star for each local component, never all its pairs; the
   stars are joined by ``connected_components``.

Defined cases: a text that is null, empty or all white space has fingerprint
zero and is linked like any other; a null ``doc_id`` takes part in links but
never names a component (null if a component has no other); repeated rows stay
repeated; very long texts are read whole, their hashes counted in parts; of equal
fingerprints any stands for all; a column that is called like the one made is
replaced, all others pass unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fresh, kept, scratch, settle, table, texts
from factflow.llm.components import connected_components

BITS = 64
#: Mean members of a chunk; larger groups are dealt by pairs of chunks.
CHUNK = 1024
#: Fingerprints walked at once in a task.
SLAB = 1 << 14
#: Expected members of a group, from which more blocks are used.
GROUP = 4096
#: Hashes of a text whose bits are counted at once.
PART = 1 << 16

# byte value -> its 8 bits spread over the 8 bytes of a word, lowest bit first
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[: len(tokens) - words]]
    h = xxhash.xxh64_intdigest
    return [h(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PART):
        own = hashes[at : at + PART]
        spread = _SPREAD[np.array(own, dtype="<u8").view(np.uint8).reshape(-1, 8)]
        # a byte lane holds 255 at most
        lanes = np.add.reduceat(spread, np.arange(0, len(own), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, out: str, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of each row, and ``out``: its
    fingerprint as a signed 64-bit number."""
    keep = kept(docs, keep, out)
    source = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text_")))
    n = len(keep)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in texts(b.column(n))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fp.view(np.int64))], names=[*keep, out])

    schema = T.StructType([*source.schema.fields[:n], T.StructField(out, T.LongType())])
    return source.mapInArrow(run, schema)


class _Links:
    """Local components: every position points at the smallest it is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (nxt := label[label]).tobytes() != label.tobytes():
                label[:] = nxt


def trie_self_join(values: np.ndarray, roots: np.ndarray, budget: int, emit, leaf_pairs: int = 16, block: int = 1 << 20) -> None:
    """Walk pairs of trie nodes together.

    ``values``: uint64, sorted within every root's range. ``roots``: rows
    (lo, hi, lo2, hi2) of node pairs to start from; equal ranges are a self-join,
    others are disjoint. ``emit(i, j)`` gets the positions of pairs that differ
    in at most ``budget`` bits.
    """
    lo, hi, lo2, hi2 = (roots[:, k].astype(np.int64) for k in range(4))
    cost = np.zeros(len(lo), dtype=np.int64)

    def leaves(lo, hi, lo2, hi2):
        left, right = hi - lo, hi2 - lo2
        size = left * right
        for s, e in _blocks(size, block):
            n = size[s:e]
            at = np.repeat(np.arange(s, e), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = lo[at] + k // right[at], lo2[at] + k % right[at]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            near &= i != j
            if near.any():
                emit(i[near], j[near])

    for depth in range(BITS):
        small = (hi - lo) * (hi2 - lo2) <= leaf_pairs
        if small.any():
            leaves(lo[small], hi[small], lo2[small], hi2[small])
            lo, hi, lo2, hi2, cost = (x[~small] for x in (lo, hi, lo2, hi2, cost))
        if not len(lo):
            return
        bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        same = lo == lo2
        parts = [
            (lo, mid, lo2, mid2, cost, slice(None)),
            (mid, hi, mid2, hi2, cost, slice(None)),
            (lo, mid, mid2, hi2, cost + 1, slice(None)),
            (mid, hi, lo2, mid2, cost + 1, ~same),  # in a self-join it is the one above, turned round
        ]
        got = []
        for a, b, c, d, e, which in parts:
            a, b, c, d, e = a[which], b[which], c[which], d[which], e[which]
            ok = (a < b) & (c < d) & (e <= budget) & ~((a == c) & (b - a == 1))
            got.append((a[ok], b[ok], c[ok], d[ok], e[ok]))
        lo, hi, lo2, hi2, cost = (np.concatenate(x) for x in zip(*got, strict=True))
    leaves(lo, hi, lo2, hi2)


def _blocks(size: np.ndarray, most: int):
    """Ranges of nodes whose leaf pairs come to about ``most``."""
    at = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(at)) + 1
    return pairwise([0, *cuts.tolist(), len(size)])


def _slab_stars(group: np.ndarray, part: np.ndarray, values: np.ndarray, budget: int):
    """Stars (fingerprint, smallest linked one) of whole groups; rows are sorted
    by group, part, value. A group with two parts joins them to each other."""
    cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])
    g, p = group[lo], part[lo]
    two = np.flatnonzero((g[1:] == g[:-1]))
    # part 0: alone in its group, joined to itself; parts 1 and 2: to each other
    alone = p == 0
    roots = np.concatenate([
        np.stack([lo[alone], hi[alone], lo[alone], hi[alone]], axis=1),
        np.stack([lo[two], hi[two], lo[two + 1], hi[two + 1]], axis=1),
    ])
    links = _Links(len(values))
    trie_self_join(values, roots, budget, links.add)
    moved = np.flatnonzero(links.label != np.arange(len(values)))
    return values[moved], values[links.label[moved]]


def _stars(batches, budget: int):
    """Over a partition sorted by group key, part and value."""
    names = ["u", "v"]

    def out(key, part, value):
        group = np.cumsum(np.concatenate([[0], np.any(key[1:] != key[:-1], axis=1).astype(np.int64)]))
        u, v = _slab_stars(group, part, value, budget)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=names)

    held, rows = [], 0
    for b in batches:
        key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        value = b.column(5).to_numpy().view(np.uint64)
        held.append((key, b.column(4).to_numpy(), value))
        rows += len(value)
        if rows < SLAB:
            continue
        key, part, value = (np.concatenate(x) for x in zip(*held, strict=True))
        # the last group may go on
        ends = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        if len(ends):
            cut = ends[-1]
            yield out(key[:cut], part[:cut], value[:cut])
            key, part, value = key[cut:], part[cut:], value[cut:]
        held, rows = [(key, part, value)], len(value)
    if rows:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def block_count(n: int, budget: int) -> int:
    """The fewest blocks with which a group is expected to have ``GROUP`` members."""
    m = budget + 1
    while m < 2 * budget + 4 and n > GROUP * 2 ** (BITS * (m - budget) // m):
        m += 1
    return m


def _mask(bits: list[int]) -> int:
    """These bits as a signed 64-bit number."""
    x = sum(1 << b for b in set(bits))
    return x - (1 << BITS) if x >> (BITS - 1) else x


def hamming_links(fps: DataFrame, budget: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Stars (u, v) that connect all distinct fingerprints (column ``fp``,
    unique) within ``budget`` bits of each other, through chains of such."""
    n = fps.count()
    m = block_count(n, budget)
    edges = [BITS * k // m for k in range(m + 1)]
    masks, inner = [], []
    for chosen in combinations(range(m), m - budget):
        bits = [x for k in chosen for x in range(edges[k], edges[k + 1])]
        masks.append(_mask(bits))
        rest = [x for x in range(BITS) if x not in set(bits)]
        inner.append([_mask(bits + rest[len(rest) * k // (budget + 1) : len(rest) * (k + 1) // (budget + 1)]) for k in range(budget + 1)])
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(x)) for x in masks))).alias("t", "block"))
    sizes = settle(keyed.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1"))
    keyed = keyed.join(sizes, ["t", "block"])
    small = keyed.where(F.col("n") <= chunk).select("fp", "t", "block", F.lit(1).alias("s"))
    further = F.get(F.array(*(F.array(*map(F.lit, own)) for own in inner)), F.col("t"))
    large = keyed.where(F.col("n") > chunk).select("fp", "t", F.posexplode(F.transform(further, lambda x: F.col("fp").bitwiseAND(x))).alias("k", "block"))
    large = large.select("fp", (F.col("t") + len(masks) * (1 + F.col("k"))).alias("t"), "block")
    again = settle(large.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1"))
    large = large.join(again, ["t", "block"]).select("fp", "t", "block", F.ceil(F.col("n") / chunk).cast("int").alias("s"))
    dealt = small.union(large).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    part = F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    dealt = dealt.select(
        F.col("t").cast("long"), "block", F.least("c", "o").cast("long").alias("ci"), F.greatest("c", "o").cast("long").alias("cj"),
        part.cast("long").alias("part"), "fp",
    )
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # values are compared as unsigned: flipping the top bit sorts them so
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    return (
        dealt.repartition(parts, "t", "block", "ci", "cj")
        .sortWithinPartitions("t", "block", "ci", "cj", "part", order)
        .mapInArrow(lambda it: _stars(it, budget), "u long, v long")
    )


def fingerprint_components(prints: DataFrame, id_col: str, budget: int = 3) -> DataFrame:
    """(fp, root, component) of every distinct fingerprint of ``prints``
    (columns ``id_col`` and fp): a fingerprint that names the component, and the
    smallest id reachable."""
    classes = settle(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    # the smallest value as unsigned or signed does not matter: a root only names its component
    with scratch() as left:
        roots = settle(connected_components(hamming_links(classes.select("fp"), budget)))
        left.append(roots)
    named = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(ids, "root").select("fp", "root", "component")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, words: int = 3) -> DataFrame:
    """(id, fp, component) of every row; see the module for the defined cases."""
    prints = settle(with_fingerprints(docs, text_col, "fp", words, [id_col]))
    return prints.join(fingerprint_components(prints, id_col, budget), "fp").select(id_col, "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, words: int = 3) -> DataFrame:
    """One row of each component stays, unchanged: that with the smallest id;
    of several rows with that id, one. A component without any id keeps one row."""
    h, who, digest, copies = (fresh(docs.columns, x) for x in ("h", "who", "digest", "copies"))
    # the texts go to Python once and come not back: a row is known by its id and its text's digest
    told = docs.select(F.col(id_col).alias("who"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("h"))
    prints = settle(with_fingerprints(told, "text", "fp", words, ["who", "h"]))
    classes = fingerprint_components(prints, "who", budget)
    counts = prints.groupBy("fp", "who", "h").agg(F.count("*").alias("copies"))
    # the one row that stays of each component
    best = counts.join(classes, "fp").where(F.col("who").eqNullSafe(F.col("component")))
    best = best.groupBy("root").agg(F.min_by(F.struct("who", "h", "copies"), F.struct("fp", "h")).alias("b"))
    best = settle(best.select(F.col("b.who").alias(who), F.col("b.h").alias(digest), F.col("b.copies").alias(copies)))
    marked = docs.withColumn(h, _digest(text_col))
    marked = marked.join(best, marked[h].eqNullSafe(best[digest]) & marked[id_col].eqNullSafe(best[who]))
    single = marked.where(F.col(copies) == 1)
    several = marked.where(F.col(copies) > 1).dropDuplicates([who, digest])
    return single.union(several).select(*docs.columns)


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicate_components(docs)
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
