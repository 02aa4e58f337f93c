"""Benchmark decontamination with a generalised suffix automaton.

The items' normalised words go into one generalised suffix automaton. Training
texts are streamed through it word by word; the automaton keeps the longest
suffix read so far that occurs in an item, and where that reaches a window's
length the window ends there. Windows are ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window.

The texts are never shuffled. The automaton is built once per Python worker
from the items' words, which are sent in shards of at most ``SHARD_WORDS``
words; a longer benchmark takes one pass per shard, and passes are merged per
document. A pass is written out and its shard let go before the next, so what is
broadcast, and what the driver holds, has a fixed bound at any size. (An item is
never parted: one of more words is a shard of its own.)

The time is linear in the words of a text, however it repeats itself: every state
links to its nearest suffix in which windows end, of which there are at most as
many as windows have lengths.

Defined cases: null or wordless texts have zero words and no hits; null or
wordless items have no windows; an item with a null id marks hit words but is
not listed among the items; repeated items count once by id; repeated documents
are judged each by itself; very long texts are read whole; a column that is
called like the one made is replaced, all others pass unchanged; empty tables
give empty results (an empty benchmark: nothing is hit).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fresh, kept, settle, table

WINDOW = 13
#: Words of the items in one automaton (at most twice as many states).
SHARD_WORDS = 400_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Words of the text with A-Z lower-cased."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


class SuffixAutomaton:
    """All factors of several word sequences, with the windows they end."""

    def __init__(self, items: Iterable[tuple[str | None, list[str]]], window: int = WINDOW):
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[str | None, int, list[int]]] = []
        for item, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            if words:
                ends.append((item, min(window, len(words)), path))
        self._mark(ends)

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: str, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def _mark(self, ends: list[tuple[str | None, int, list[int]]]) -> None:
        """ends[state]: window length -> items, of the windows that are among
        the state's own factors; up[state]: the nearest suffix that has any."""
        self.ends: list[dict[int, set]] = [{} for _ in self.next]
        above: dict[int, dict[int, int]] = {}  # window length -> state -> the suffix that has its windows of this length
        for item, n, path in ends:
            known = above.setdefault(n, {})
            for s in path[n - 1 :]:
                passed = []
                while s not in known and self.length[self.link[s]] >= n:
                    passed.append(s)
                    s = self.link[s]
                s = known.setdefault(s, s)
                known.update(dict.fromkeys(passed, s))
                self.ends[s].setdefault(n, set()).add(item)
        # shortest window that ends in a state or a suffix of it; 0: none
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.least, self.up = [0] * len(self.next), [0] * len(self.next)
        for s in order[1:]:
            link = self.link[s]
            self.up[s] = link if self.ends[link] else self.up[link]
            own = min(self.ends[s], default=0)
            self.least[s] = self.least[link] or own  # a suffix has the shorter windows

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, set]]:
        """(start, end, items) of every occurrence of a window. At each word at
        most as many suffixes are looked at as windows have lengths."""
        nxt, link, length, least, ends, up = self.next, self.link, self.length, self.least, self.ends, self.up
        root = nxt[0]
        state, here, n = 0, root, 0
        for at, w in enumerate(words):
            to = here.get(w)
            if to is None:
                if state == 0:
                    continue
                while state and w not in nxt[state]:
                    state = link[state]
                n = length[state]
                to = nxt[state].get(w)
                if to is None:
                    state, here, n = 0, root, 0
                    continue
            state, n = to, n + 1
            here = nxt[state]
            if least[state] and n >= least[state]:
                s = state if ends[state] else up[state]
                while s:
                    for k, items in ends[s].items():
                        if k <= n:
                            yield at + 1 - k, at + 1, items
                    s = up[s]


def _merge(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_BUILT: dict = {}


def _automaton(key: str, shard: list[tuple[str | None, str]], window: int) -> SuffixAutomaton:
    """One automaton at a time stays in a worker; it is made again elsewhere."""
    if _BUILT.get("key") != key:
        _BUILT.clear()
        _BUILT.update(key=key, automaton=SuffixAutomaton(((i, t.split(" ")) for i, t in shard), window))
    return _BUILT["automaton"]


def item_shards(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    """The items' normalised words in shards; the driver holds one at a time."""
    shard: list[tuple[str | None, str]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).distinct()
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if size and size + len(words) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((item, " ".join(words)))
        size += len(words)
    if shard:
        yield shard


_HITS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.list_(pa.int32()))), ("chars", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())),
])
_HITS_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("chars", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def hits_of(automaton: SuffixAutomaton, text: str | None, before: dict | None = None) -> dict:
    """Hits of one text, with those of an earlier shard merged in."""
    words = words_of(text)
    spans, items, met = set(), set(), {}
    if before:
        spans |= {tuple(x) for x in before["spans"]}
        items |= set(before["items"])
    for s, e, who in automaton.spans(words):
        spans.add((s, e))
        met[id(who)] = who
    items.update(*met.values())
    items.discard(None)
    merged, chars = _merge(spans), []
    if merged:
        at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        chars = [[at[s][0], at[e - 1][1]] for s, e in merged]
    return {"n_words": len(words), "n_hit": sum(e - s for s, e in merged), "spans": merged, "chars": chars, "items": sorted(items)}


def _scan(source: DataFrame, text: str, shard: list, held: Broadcast, window: int, out: str, last: bool) -> DataFrame:
    """Set the struct ``out`` of each row from its column ``text``; the text
    itself goes no further than the last pass."""
    key = hashlib.sha256(repr((window, shard)).encode()).hexdigest()
    names = source.columns
    at, prior = names.index(text), names.index(out) if out in names else None
    kept = [k for k, c in enumerate(names) if c != out and not (last and c == text)]

    def run(batches):
        automaton = _automaton(key, held.value, window)
        for b in batches:
            olds = b.column(prior).to_pylist() if prior is not None else [None] * b.num_rows
            made = [hits_of(automaton, t, o) for t, o in zip(b.column(at).to_pylist(), olds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in kept), pa.array(made, _HITS)], names=[*(names[k] for k in kept), out])

    fields = [source.schema.fields[k] for k in kept]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField(out, _HITS_SCHEMA)]))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, out: str = "hits",
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``: struct of n_words, n_hit,
    spans (merged [start, end) word ranges), chars (the same in characters of
    the text) and items (ids as text, sorted)."""
    keep = kept(docs, keep, out)
    text = fresh([*keep, out], "text_")
    result = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    shards = item_shards(benchmark, item_col, item_text_col, shard_words)
    shard = next(shards, [])
    while True:
        following = next(shards, None)
        held = docs.sparkSession.sparkContext.broadcast(shard)
        result = _scan(result, text, shard, held, window, out, following is None)
        if following is None:
            return result
        # written out, so that one shard at a time is held by the executors
        result = settle(result)
        held.destroy()
        shard = following


def contaminated(hits: str):
    """At least a twentieth of the words is hit."""
    h = F.col(hits)
    return (h["n_hit"] > 0) & (20 * h["n_hit"] >= h["n_words"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows over the coverage limit go; from the others every hit span is cut
    out of the text. Rows without hits stay as they are."""
    out = fresh(docs.columns, "hits")
    hit = benchmark_hits(docs, benchmark, text_col, window=window, out=out)
    chars = F.col(out)["chars"]
    t = F.col(text_col)
    cut = F.aggregate(
        chars,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["done"], F.substring(t, acc["at"] + 1, s[0] - acc["at"])).alias("done"), s[1].alias("at")
        ),
        lambda acc: F.concat(acc["done"], F.substring(t, acc["at"] + 1, F.length(t))),
    )
    clean = hit.where(~contaminated(out)).withColumn(text_col, F.when(F.size(chars) > 0, cut).otherwise(t))
    return clean.select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), contaminated("hits").alias("contaminated"),
    )


def oracle_sql() -> str:
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {words} AS w FROM documents),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN wins USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""
