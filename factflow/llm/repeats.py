"""Removal of every byte that a repeated 400-byte string covers.

Texts are far too many bytes to suffix-sort as they stand, so they are reduced to
what suffixes have to decide:

1. Anchors. In every ``length``-byte window the 32-byte gram with the smallest
   hash is its anchor (the rightmost of equals), so equal windows have equal
   anchors at equal places. A window's anchor is the same for a run of starts;
   one row per run carries the hash of the gram and a digest of all bytes of the
   run's windows. There is about one row for every 190 bytes. Runs whose gram
   occurs once hold no repeated window and go.
2. Equal runs are folded into one class with a count, before anything is gathered;
   what is decided for a class holds for its members.
3. The starts of a class are taken in pieces of ``PIECE`` bytes: the windows of a
   piece have a common core and reach up to 63 bytes to either side of it. Pieces
   of equal cores meet. Of all of a slab that met any one text is made, in symbols
   of ``BLOCK`` bytes: left side, core, right side. Its suffix array, built by linear
   grouping of Lyndon prefixes (see ``suffixes``), puts suffixes with a common
   beginning side by side; where neighbours share all the symbols that a window
   holds whole, they form an interval, and within it the 15 bytes that are left over
   at the window's two ends tell which windows are equal. A window that is
   equal to another's, or whose class has several members, is repeated.
4. A core with more than ``GROUP`` pieces is not gathered: pieces that are alike
   are folded, the rest is halved and meets again by the longer cores, in the same
   way, down to single windows, which are only counted.

Digests have 128 bits and stand for the bytes. Matches never cross documents, as
windows do not.

By the same steps over words instead of bytes, documents are told that share a
passage of more than 50 words with another document (white space parts words, A-Z
is lower-cased; a word is known by its 32-bit checksum): 51 words are a window.
There a class is decided by its fold if it has members in several documents.

Defined cases: null is the empty text; texts shorter than ``length`` lose
nothing but may not be skipped over (they are returned with zero removed bytes);
very long texts are read in overlapping segments, whole; repeated rows are copies
of each other; equal hashes in a window give the rightmost anchor; a column that
is called like the one made is replaced, all others pass unchanged; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import discard, fresh, kept, scratch, settle, table, texts
from factflow.llm.suffixes import suffix_array

LENGTH = 400
#: Words of a passage that documents share.
PASSAGE_WORDS = 51
#: Bytes of the starts of one piece, a power of two.
PIECE = 64
#: Bytes of one symbol of the suffix array.
BLOCK = 16
#: Pieces of one core that a task compares by suffixes; more are halved.
GROUP = 256
#: Pieces of whole groups whose suffixes are sorted at once.
SLAB = 1 << 13
_SEGMENT = 1 << 21
_MIX = np.random.default_rng(3).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class View:
    """A text as symbols of ``unit`` bytes, in windows of ``length`` symbols."""

    unit: int
    length: int
    gram: int  # symbols of an anchor, a power of two
    across: bool  # only what stands in several documents counts

    def symbols(self, text: bytes) -> np.ndarray:
        if self.unit == 1:
            return np.frombuffer(text, np.uint8)
        words = text.lower().split()
        return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))

    @property
    def piece(self) -> int:
        return PIECE // self.unit


def byte_view(length: int = LENGTH) -> View:
    return View(1, length, 32, False)


def word_view(words: int = PASSAGE_WORDS) -> View:
    return View(4, words, 8, True)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` symbols from each place, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    span = 1
    k = 0
    while span < gram:
        h = h[:-span] * _MIX[k] + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
        k += 1
    return h * _MIX[7]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, span = v, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(group: list[np.ndarray], view: View) -> np.ndarray:
    """Rows (text, anchor, far, near, gram hash) of each run of window starts
    ``anchor - far .. anchor - near`` that have the same anchor."""
    length = view.length
    none = np.zeros((0, 5), np.int64)
    data = np.concatenate(group) if group else np.zeros(0, np.uint8)
    if len(data) < length:
        return none
    sizes = np.array([len(t) for t in group])
    ends = np.cumsum(sizes)
    h = _gram_hashes(data, view.gram)
    mask = np.uint64((1 << 24) - 1)
    v = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    at = (mask - (_sliding_min(v, length - view.gram + 1) & mask)).astype(np.int64)
    owner = np.repeat(np.arange(len(group)), sizes)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[owner])
    if not len(start):
        return none
    a, o = at[start], owner[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(o) != 0)]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    base = (ends - sizes)[o[new]]
    return np.stack([o[new], a[new] - base, a[new] - start[new], a[new] - start[last], h[a[new]].view(np.int64)], axis=1)


def _segments(batch: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Groups of (row, offset, symbols) of about ``_SEGMENT`` symbols; a longer
    text is cut into parts that overlap by less than a window."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(batch):
        for s in range(0, max(1, len(text) - length + 1), _SEGMENT):
            part = text[s : s + _SEGMENT + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > 2 * _SEGMENT:
                yield np.array(rows), np.array(offsets), parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(s)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(rows), np.array(offsets), parts


def _anchor_rows(docs: DataFrame, view: View) -> DataFrame:
    """(tk, a, far, near, gram, span) of every run; docs: (tk, text)."""
    length = view.length

    def run(batches):
        for b in batches:
            batch, keys = [view.symbols(t) for t in texts(b.column(1))], b.column(0)
            for rows, offsets, parts in _segments(batch, length):
                found = runs(parts, view)
                if not len(found):
                    continue
                k, a, far, near, gram = found.T
                digest = xxhash.xxh3_128_digest
                spans = [digest(parts[p][s:e]) for p, s, e in zip(k.tolist(), (a - far).tolist(), (a - near + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows[k])), pa.array(a + offsets[k]), pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(gram), pa.array(spans, pa.binary())],
                    names=["tk", "a", "far", "near", "gram", "span"])

    return docs.mapInArrow(run, "tk binary, a long, far int, near int, gram long, span binary")


#: Pieces: left and right are the bytes beside the core; the starts lo to hi are
#: in the run; base is the first start's place from the anchor; w is 2 if the
#: class has several members; kmin and kmax are hashes of the texts that it is in.
_PIECE = ("core", "left", "right", "lo", "hi", "gram", "span", "base", "w", "kmin", "kmax")
_KINDS = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
_PIECE_SCHEMA = "core binary, left binary, right binary, lo int, hi int, gram long, span binary, base int, w int, kmin long, kmax long"


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=list(_PIECE))


def _pieces(chosen: DataFrame, view: View) -> DataFrame:
    """Pieces of the runs listed with each text (text, runs)."""
    length, n, unit = view.length, view.piece, view.unit

    def run(batches):
        for b in batches:
            out = [[] for _ in _PIECE]
            for text, listed in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                data = view.symbols(text).tobytes()
                cut = lambda s, e, d=data: d[max(0, s) * unit : e * unit]
                for r in listed:
                    a, far, near = r["a"], r["far"], r["near"]
                    for g in range(near // n, far // n + 1):
                        d0, d1 = g * n, g * n + n - 1
                        core = xxhash.xxh3_128_digest(cut(a - d0, a - d1 + length) + bytes([g]))
                        row = (core, cut(a - d1, a - d0), cut(a - d1 + length, a - d0 + length), max(0, d1 - far), min(n - 1, d1 - near), r["gram"], r["span"], -d1, r["w"], r["kmin"], r["kmax"])
                        for c, x in zip(out, row, strict=True):
                            c.append(x)
            yield _batch(out)

    return chosen.mapInArrow(run, _PIECE_SCHEMA)


def _halves(rows: DataFrame, e: int, unit: int) -> DataFrame:
    """Each piece of e + 1 starts as two of half of them, by the longer cores."""

    def run(batches):
        h = (e + 1) // 2
        n = e - h  # the last start of a half
        for b in batches:
            out = [[] for _ in _PIECE]
            for core, left, right, lo, hi, gram, span, base, *rest in zip(*(b.column(c).to_pylist() for c in range(len(_PIECE))), strict=True):
                # the nearer half: its core takes in symbols on the right; the other's on the left
                for k, s in enumerate((0, h)):
                    if lo > s + n or hi < s:
                        continue
                    want_left, want_right = (e - s - n) * unit, s * unit  # bytes of either side that the half's windows all have
                    if len(left) < want_left or len(right) < want_right:
                        continue
                    near = len(left) - want_left
                    key = xxhash.xxh3_128_digest(b"%d|%d|" % (e, k) + core + left[near:] + b"|" + right[:want_right])
                    row = (key, left[max(0, near - n * unit) : near], right[want_right : want_right + n * unit], max(lo - s, 0), min(hi - s, n), gram, span, base + s, *rest)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield _batch(out)

    return rows.select(*_PIECE).mapInArrow(run, _PIECE_SCHEMA)


def _intervals(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each piece and each number m of whole left blocks (0 up to their
    count less one), the interval of the suffix array in which the suffix of m
    left blocks, the core and the right side stands: neighbours belong together
    that share as many symbols as there are blocks on a side. Blocks are pairs of
    numbers: left and right have the shape (pieces, blocks, 2)."""
    n, blocks, _ = left.shape
    both = np.concatenate([left, right]).reshape(-1, 2)
    by = np.lexsort((both[:, 1], both[:, 0]))
    rank = np.empty(len(both), np.int64)
    rank[by] = np.concatenate([[0], np.cumsum(np.any(both[by][1:] != both[by][:-1], axis=1))])
    rank = rank.reshape(2, n, blocks)
    text = np.concatenate([rank[0], (len(both) + group)[:, None], rank[1]], axis=1).reshape(-1)
    order = np.array(suffix_array(text.tolist()), np.int64)
    padded = np.concatenate([text, np.full(blocks, -1)])
    shared = np.ones(len(order) - 1, bool)
    for k in range(blocks):
        shared &= padded[order[1:] + k] == padded[order[:-1] + k]
    interval = np.empty(len(order), np.int64)
    interval[order] = np.concatenate([[0], np.cumsum(~shared)])
    # the suffix of m left blocks begins m symbols before the core
    return interval.reshape(n, 2 * blocks + 1)[:, blocks:0:-1]


def _pairs(data: np.ndarray) -> np.ndarray:
    """Rows of up to 16 bytes as two numbers each."""
    full = np.zeros((*data.shape[:-1], 16), np.uint8)
    full[..., : data.shape[-1]] = data
    return full.view(">u8").astype(np.uint64)


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, w: np.ndarray,
                    kmin: np.ndarray, kmax: np.ndarray, e: int, unit: int = 1, across: bool = False) -> np.ndarray:
    """Which of the e + 1 window starts of each piece is repeated in its group.
    At start j a window has the last e - j symbols of the left side and the
    first j of the right side."""
    n, wide = len(left), (e + 1) * unit
    width = min(BLOCK, wide)
    per, blocks = width // unit, wide // width  # symbols of a block, blocks of a side
    # sides that the text's ends cut short are filled; no valid window reads the filling
    lefts = np.frombuffer(b"".join([x.rjust(wide, b"\0") for x in left]), np.uint8).reshape(n, blocks, width)
    rights = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in right]), np.uint8).reshape(n, blocks, width)
    interval = _intervals(group, _pairs(lefts), _pairs(rights))
    hit = np.zeros((n, e + 1), bool)
    for m in range(blocks):
        own = interval[:, m]
        # alone in its interval, a piece is repeated only by its weight
        _, back, many = np.unique(own, return_inverse=True, return_counts=True)
        may = (many[back] > 1) | (w > 1)
        for t in range(per):
            j = e - per * m - t
            at = np.flatnonzero(may & (lo <= j) & (hi >= j))
            if not len(at):
                continue
            # what the window's ends hold beside whole blocks
            rest = _pairs(np.concatenate([lefts[at, blocks - 1 - m, width - t * unit :], rights[at, blocks - 1 - m, : (per - 1 - t) * unit]], axis=1))
            by = np.lexsort((rest[:, 1], rest[:, 0], own[at]))
            s, rest = at[by], rest[by]
            first = np.flatnonzero(np.concatenate([[True], (own[s][1:] != own[s][:-1]) | np.any(rest[1:] != rest[:-1], axis=1)]))
            if across:
                again = np.minimum.reduceat(kmin[s], first) < np.maximum.reduceat(kmax[s], first)
            else:
                again = np.add.reduceat(w[s], first) > 1
            hit[s, j] = np.repeat(again, np.diff(np.append(first, len(s))))
    return hit


def _compare(batches, e: int, view: View):
    """Over a partition sorted by core: (gram, span, first, last) of repeated
    starts, as places from the anchor."""

    def out(rows):
        core, left, right, lo, hi, gram, span, base, w, kmin, kmax = rows
        group = np.cumsum(np.array([False] + [x != y for x, y in zip(core, core[1:], strict=False)]))
        lo, hi, w = np.array(lo), np.array(hi), np.array(w)
        # a piece that is alone in its group is repeated only by its weight; its suffixes need not be sorted
        crowd = np.bincount(group)[group] > 1
        keep = np.flatnonzero(crowd | (w > 1)) if not view.across else np.flatnonzero(crowd)
        if not len(keep):
            return None
        together = crowd[keep]
        own = keep[together]
        hit = np.zeros((len(keep), e + 1), bool)
        start = np.arange(e + 1)
        hit[~together] = (start >= lo[keep][~together, None]) & (start <= hi[keep][~together, None])
        if len(own):
            take = lambda c: [c[k] for k in own]
            hit[together] = repeated_starts(group[own], take(left), take(right), lo[own], hi[own], w[own], np.array(kmin)[own], np.array(kmax)[own], e, view.unit, view.across)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        k, first = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        k = keep[k]
        b = np.array(base, np.int32)[k]
        return pa.RecordBatch.from_arrays(
            [pa.array([gram[x] for x in k], pa.int64()), pa.array([span[x] for x in k], pa.binary()), pa.array((b + first).astype(np.int32)), pa.array((b + after - 1).astype(np.int32))],
            names=["gram", "span", "first", "last"])

    held = [[] for _ in _PIECE]
    for b in batches:
        for c, column in zip(held, b.columns, strict=True):
            c.extend(column.to_pylist())
        if len(held[0]) < SLAB:
            continue
        cut = len(held[0]) - 1
        while cut > 0 and held[0][cut - 1] == held[0][-1]:
            cut -= 1
        if cut:
            if (made := out([c[:cut] for c in held])) is not None:
                yield made
            held = [c[cut:] for c in held]
    if held[0] and (made := out(held)) is not None:
        yield made


_HITS = "gram long, span binary, first int, last int"


def _decided(pieces: DataFrame, view: View) -> DataFrame:
    """(gram, span, first, last) of the repeated starts of each class. Of pieces
    that are folded in a large group, all are told of what the fold decides; in
    the view across documents, of pieces of one document, one is."""
    alike = ["core", "left", "right", "lo", "hi"]
    spark = pieces.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found: list[DataFrame] = []
    e, rows = view.piece - 1, pieces
    span_of = lambda df: df.select("gram", "span", (F.col("base") + F.col("lo")).alias("first"), (F.col("base") + F.col("hi")).alias("last"))
    repeated = F.col("kmin") < F.col("kmax") if view.across else F.col("w") > 1
    told = {"w": F.least(F.lit(2), F.sum("w")).cast("int"), "kmin": F.min("kmin"), "kmax": F.max("kmax")}
    while True:
        if e == 0:
            same = rows.groupBy("core").agg(*(x.alias(c) for c, x in told.items())).where(repeated).select("core")
            found.append(span_of(rows.where("lo <= 0 and hi >= 0").join(same, "core")))
            break
        large = settle(rows.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("core"))
        crowded = not large.isEmpty()
        small = rows
        if crowded:
            # in large groups, pieces that are alike are one with their weight
            small, big = rows.join(large, "core", "left_anti"), rows.join(large, "core", "left_semi")
            one = F.min(F.struct("gram", "span", "base")).alias("one")
            folds = settle(big.groupBy(*alike).agg(one, *(x.alias(c) for c, x in told.items())))
            found.append(span_of(big.select(*alike, "gram", "span", "base").join(folds.where(repeated).select(*alike), alike)))
            left = folds.select(*alike, "one.*", *told)
            sizes = settle(left.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("core"))
            small = small.select(*_PIECE).union(left.join(sizes, "core", "left_anti").select(*_PIECE))
            left = left.join(sizes, "core", "left_semi").select(*_PIECE)
        dealt = small.select(*_PIECE).repartition(parts, "core").sortWithinPartitions("core", "gram", "span", "base")
        found.append(settle(dealt.mapInArrow(lambda it, e=e: _compare(it, e, view), _HITS)))
        if not crowded or left.isEmpty():
            break
        rows, e = settle(_halves(left, e, view.unit)), (e + 1) // 2 - 1
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return settle(out)


def decided_runs(docs: DataFrame, text_col: str, view: View) -> tuple[DataFrame, DataFrame]:
    """All runs of texts (known by their MD5, tk) whose gram occurs again: (tk,
    a, far, near, gram, span); and the repeated starts of their classes: (gram,
    span, first, last), as places from the anchor."""
    text = F.col(text_col).cast("string")
    source = docs.where(F.octet_length(text) >= view.length).select(F.unhex(F.md5(text.cast("binary"))).alias("tk"), text.alias("text"))
    anchors = settle(_anchor_rows(source, view))
    # counts are written out before they are joined: a frequent gram's rows then need not meet in one task
    several = F.min("tk") < F.max("tk") if view.across else F.count("*") > 1
    twice = settle(anchors.groupBy("gram").agg(several.alias("again")).where("again").select("gram"))
    again = settle(anchors.join(twice, "gram"))
    discard(anchors, twice)
    # a run and its copies count alike: what counts is where the bytes stand
    key = F.xxhash64("tk")
    classes = settle(again.groupBy("gram", "span").agg(
        F.least(F.lit(2), F.count("*")).cast("int").alias("w"), F.min(key).alias("kmin"), F.max(key).alias("kmax"),
        F.min(F.struct("tk", "a", "far", "near")).alias("run")))
    folded = None
    asked = classes
    if view.across:
        folded = classes.where("kmin < kmax")
        # a gram is gone into where it stands in a document that no fold has told of
        known = settle(again.join(folded.select("gram", "span"), ["gram", "span"], "left_semi").select("tk").distinct())
        open_ = classes.where("kmin = kmax").join(known, F.col("run.tk") == F.col("tk"), "left_anti").select("gram").distinct()
        mixed = classes.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
        asked = classes.join(settle(open_.join(mixed, "gram")), "gram", "left_semi")
    run = F.struct("run.a", "run.far", "run.near", "gram", "span", "w", "kmin", "kmax").alias("r")
    listed = asked.select("run.tk", run).groupBy("tk").agg(F.collect_list("r").alias("runs"))
    own = source.join(listed.select("tk"), "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text"))
    pieces = settle(_pieces(own.join(listed, "tk").select("text", "runs"), view))
    hits = _decided(pieces, view)
    discard(pieces)
    if folded is not None:
        hits = hits.union(folded.select("gram", "span", -F.col("run.far"), -F.col("run.near")))
    return again, hits


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(tk, ranges): by the MD5 of each text that has any, the first and last
    starts of repeated windows; array of struct(first, last)."""
    again, hits = decided_runs(docs, text_col, byte_view(length))
    # a run has at most as many ranges as starts; written out, so that a large class's members need not meet in one task
    ranges = settle(hits.groupBy("gram", "span").agg(F.collect_set(F.struct("first", "last")).alias("own")))
    at = again.select("tk", "a", "gram", "span").join(ranges, ["gram", "span"])
    at = at.select("tk", F.transform("own", lambda r: F.struct((r["first"] + F.col("a")).alias("first"), (r["last"] + F.col("a")).alias("last"))).alias("own"))
    return at.groupBy("tk").agg(F.flatten(F.collect_set("own")).alias("ranges"))


def sharing_texts(docs: DataFrame, text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """(tk): the MD5 of each text of which ``words`` words in a row stand in a
    different text, too."""
    again, hits = decided_runs(docs, text_col, word_view(words))
    return again.join(settle(hits.select("gram", "span").distinct()), ["gram", "span"], "left_semi").select("tk").distinct()


def _merge(ranges: list[dict], length: int) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted((r["first"], r["last"] + length) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, out: str = "repeats",
                   passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``: struct of n_bytes,
    n_removed, spans (maximal removed runs, in bytes, ends exclusive), kept
    (the remaining bytes, which may part a character) and shares (does another
    row hold ``passage_words`` words in a row of this text; null if None)."""
    keep = kept(docs, keep, out)
    tk, text, ranges, shares, copied = (fresh([*keep, out], x) for x in ("tk", "text_", "ranges", "shares", "copied"))
    t = F.col(text_col).cast("string")
    key = F.unhex(F.md5(t.cast("binary")))
    kind = "array<struct<first:long,last:long>>"
    with scratch() as left:
        found = repeated_ranges(docs, text_col, length).select("tk", F.col("ranges").cast(kind).alias("ranges"), F.lit(False).alias("shares"), F.lit(False).alias("copied"))
        if passage_words is not None:
            copies = docs.select(key.alias("tk")).groupBy("tk").agg(F.count("*").alias("n")).where("n > 1")
            found = found.union(sharing_texts(docs, text_col, passage_words).select("tk", F.lit(None).cast(kind), F.lit(True), F.lit(False)))
            found = found.union(copies.select("tk", F.lit(None).cast(kind), F.lit(False), F.lit(True)))
        # one row of each kind at most
        found = settle(found.groupBy("tk").agg(F.first("ranges", ignorenulls=True).alias(ranges), F.max("shares").alias(shares), F.max("copied").alias(copied)))
        left.append(found)
    rows = docs.select(*keep, t.alias(text), key.alias(tk))
    rows = rows.join(found.withColumnRenamed("tk", tk), tk, "left").select(*keep, text, ranges, shares, copied)
    n = len(keep)
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("shares", pa.bool_())])

    def run(batches):
        for b in batches:
            made = []
            for data, listed, shared, copy in zip(texts(b.column(n)), *(b.column(n + k).to_pylist() for k in (1, 2, 3)), strict=True):
                spans = _merge(listed or [], length)
                rest = b"".join(data[s:e] for s, e in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(data)], strict=True))
                if passage_words is None:
                    shared = None
                else:
                    shared = bool(shared) or (bool(copy) and len(data.split()) >= passage_words)
                made.append({"n_bytes": len(data), "n_removed": len(data) - len(rest), "spans": spans, "kept": rest, "shares": shared})
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(made, kind)], names=[*keep, out])

    field = T.StructField(out, T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType()), T.StructField("shares", T.BooleanType()),
    ]))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:n], field]))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select(
        "doc_id", "repeats.n_bytes", "repeats.n_removed", F.size("repeats.spans").cast("long").alias("n_spans"),
        F.sha2(F.col("repeats.kept"), 256).alias("kept_sha256"), F.col("repeats.shares").alias("shares_passage"),
    )


def oracle_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, sha256(b[i:i + {LENGTH - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN again USING (h)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + {LENGTH} AS hi FROM g GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM spans
  UNION ALL SELECT doc_id, 1, min(lo) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[lo:coalesce(hi, octet_length(b) + 1) - 1]), '' ORDER BY lo) AS x
  FROM gaps JOIN d USING (doc_id) WHERE lo < coalesce(hi, octet_length(b) + 1) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM spans GROUP BY doc_id),
v AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, sha256(array_to_string(words[i:i + {PASSAGE_WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {PASSAGE_WORDS - 2})) AS i FROM v)),
shared AS (SELECT DISTINCT doc_id FROM p SEMI JOIN (SELECT h FROM p GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256,
  shared.doc_id IS NOT NULL AS shares_passage
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN shared USING (doc_id)"""
