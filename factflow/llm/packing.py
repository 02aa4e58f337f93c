"""Best-fit packing of token sequences, online and in bounded space.

A packer keeps a fixed number of open bins in a bitset keyed by free space: bit
f is set if a bin with f free places is open. A piece goes into the bin whose
free space is the smallest that holds it; if none does, a new bin opens, and if
that is one too many, the fullest closes first. It sees each piece once, in the
order of arrival, and never moves one that is placed.

Pieces are dealt evenly to shards of a fixed count of tokens, each the stream of
one task, in the order of ids and pieces. At a shard's end the fullest bins close
until ``carried`` are left; these are not shipped half empty: their pieces are
streamed once more in a further round of far fewer shards, until one shard is
left. Only lengths and checksums are shuffled, never texts.

Defined cases: a null or empty text is the single closing id; a document longer
than ``capacity``, however long, is cut into pieces of ``capacity``, the last may
be shorter; of bins with equally much free space the one that got there last is
taken; repeated rows and null ids are packed like any other row; further columns
of the documents, whatever they are called, are not read and not passed on; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import settle, table

CAPACITY = 4096
#: Bins that may be open at a time.
OPEN_BINS = 64
#: Tokens of one packing task.
SHARD_TOKENS = 1 << 24
SHARD_ROWS = 1 << 20
#: Bins that may still be open when a shard ends; beyond, the fullest close.
CARRIED_BINS = 64
#: Words whose ids a Python worker keeps, and as many that were not used lately.
CACHED_WORDS = 400_000
#: Text that is looked up at once, and words of one call of the tokenizer.
GROUP_BYTES = 8_000_000
CALL_WORDS = 4_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte value -> the character that stands for it in a byte-level vocabulary:
    printable bytes themselves, the others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(own)]
    return {x: chr(x) for x in own} | {x: chr(256 + k) for k, x in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


_BYTE_TABLE = "".join(chr(x) if x in (10, 32) else _BYTE_LETTERS[x] for x in range(256))
#: Letters below U+0250 but U+0130: there, no normal form changes a letter and
#: lower case is one letter for one.
_PLAIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what white space parts, so
    each white-space-free unit is encoded once and remembered.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cached
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # hashes of words met before: most words are met once and not worth keeping
        self.met = bytearray(1 << 22)
        self.merges = self._bare_merges(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    @staticmethod
    def _bare_merges(spec: dict):
        """The model over words parted by spaces, if the tokenizer is of the
        known kind: lower case, byte letters, and ids that end a word."""
        from tokenizers import Tokenizer

        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or split != ["Split", "ByteLevel"] or spec["model"].get("end_of_word_suffix") != "</w>":
            return None
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))

    def _encode_each(self, units: list[bytes]) -> list[bytes]:
        out = []
        for part in batched(units, CALL_WORDS):
            made = self.tokenizer.encode_batch_fast([u.decode() for u in part], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in made]
        return out

    def __call__(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP_BYTES)) + 1).tolist(), len(column)]
        for s, e in pairwise(cuts):
            yield from self._group(column.slice(s, e - s))

    def _group(self, column: pa.Array) -> Iterator[bytes]:
        """Equal units of a group are looked up once."""
        # a copy of its own: lower-casing a slice that does not begin its buffer gives wrong offsets
        column = column.take(pa.array(np.arange(len(column))))
        # lower case is the same for a text that is ASCII throughout; special tokens are case-sensitive
        plain = pc.and_(pc.string_is_ascii(column), pc.invert(pc.match_substring(column, "<|")))
        units = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(column), column))
        own = units.flatten().dictionary_encode()
        code = own.indices.to_numpy()
        words = own.dictionary.cast(pa.large_binary()).to_pylist()
        ids, start, length = self._look_up(words, np.bincount(code, minlength=len(words)))
        n = length[code]
        end = np.cumsum(n)
        made = ids[np.repeat(start[code] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        at = np.concatenate([[0], end])[np.cumsum(np.concatenate([[0], pc.list_value_length(units).to_numpy()]))].tolist()
        for s, e in pairwise(at):
            yield made[s:e].tobytes()

    def _look_up(self, units: list[bytes], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units together, and where each unit's begin and how many
        they are. Of new units, those met for a second time are remembered."""
        if len(self.known) > self.cached:
            # what is used again comes back from there
            self.known, self.old, self.met = {}, self.known, bytearray(1 << 22)
        known, old = self.known, self.old
        known[b""] = b""
        data = list(map(known.get, units))
        plain: list[int] = []
        text: list[bytes] = []
        rest: list[int] = []
        for k in [k for k, x in enumerate(data) if x is None]:
            u = units[k]
            x = old.get(u)
            if x is not None:
                known[u] = data[k] = x
            elif u.isalpha():  # of bytes: ASCII letters
                plain.append(k)
                text.append(u)
            elif u[-1] in b".," and u[:-1].isalpha():  # letters and a mark after them are always parted
                plain.append(k)
                text.append(u[:-1] + b" " + u[-1:])
            else:
                rest.append(k)
        written = b"\n".join(text).decode("ascii").lower().split("\n") if text else []
        if rest and self.merges:
            read = b" ".join([units[k] for k in rest]).decode().split(" ")
            wide = [(k, w if _PLAIN(w) else f"{w[:-1]} {w[-1]}") for k, w in zip(rest, read, strict=True) if _PLAIN(w) or (w[-1] in ".," and _PLAIN(w[:-1]))]
            plain += [k for k, _ in wide]
            written += "\n".join([w for _, w in wide]).lower().encode().decode("latin-1").translate(_BYTE_TABLE).split("\n") if wide else []
            rest = sorted(set(rest).difference(plain))
        if not self.merges:
            plain, written, rest = [], [], sorted([*plain, *rest])
        for k, x in zip(rest, self._encode_each([units[k] for k in rest]), strict=True):
            data[k] = x
            if self._again(units[k], seen[k]):
                known[units[k]] = x
        have = np.array([k for k, x in enumerate(data) if x is not None], np.int64)
        start, length = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        length[have] = [len(data[k]) // 4 for k in have.tolist()]
        start[have] = np.cumsum(length[have]) - length[have]
        parts = [np.frombuffer(b"".join([data[k] for k in have.tolist()]), "<u4")]
        size = len(parts[0])
        for own, words in zip(batched(plain, CALL_WORDS), batched(written, CALL_WORDS), strict=True):
            ids, ends = self._encode_plain(words)
            which = np.array(own)
            length[which] = np.diff(ends, prepend=0)
            start[which] = size + ends - length[which]
            parts.append(ids)
            size += len(ids)
            for k, e in zip(own, ends.tolist(), strict=True):
                if self._again(units[k], seen[k]):
                    known[units[k]] = ids[e - length[k] : e].tobytes()
        return np.concatenate(parts), start, length

    def _again(self, unit: bytes, seen: int) -> bool:
        at = hash(unit) & 0x3FFFFF
        if seen > 1 or self.met[at]:
            return True
        self.met[at] = 1
        return False

    def _encode_plain(self, words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Words of byte letters, some with a mark apart: encoded as one text by
        the bare merges. Returns the ids, and after how many each word ends."""
        [made] = self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(made.ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return ids, ends[np.cumsum([1 + (" " in w) for w in words]) - 1]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes: equal words
    are looked up once in each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every piece of every row;
    ``ids`` holds little-endian unsigned 32-bit numbers."""
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")
    source = docs.select(id_col, F.col(text_col).cast("string").alias("text_"))

    def run(batches):
        encode = _encoder(path)
        for b in _gathered(batches, GROUP_BYTES * 3 // 4):
            who, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, made in enumerate(encode(b.column(1))):
                made += end
                for k, s in enumerate(range(0, len(made), 4 * capacity)):
                    part = made[s : s + 4 * capacity]
                    who.append(row)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            columns = [b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [
        source.schema.fields[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return source.mapInArrow(run, T.StructType(fields))


class BestFit:
    """Bounded-space best fit over lengths of at most ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0
        self.at: dict[int, list[int]] = {}
        self.opened = self.open = self.forced = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; closed bins are just forgotten."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            which = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.forced += 1
            which, free = self.opened, self.capacity
            self.opened += 1
        left = free - length
        if left:
            self.bits |= 1 << left
            self.at.setdefault(left, []).append(which)
            self.open += 1
        return which, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.at[free]
        which = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return which

    def still_open(self, most: int) -> list[int]:
        """The ``most`` open bins with the most free space; the others close."""
        return [x for free in sorted(self.at, reverse=True) for x in self.at[free]][:most]


def _pack_round(rows: DataFrame, shards: int, turn: int, capacity: int, open_bins: int, carried: int, final: bool, base: list[str]) -> DataFrame:
    """``rows`` with sequence_id, offset and closed; each shard is one task."""
    at = base.index("length")

    def run(batches):
        packer, held, lengths = BestFit(capacity, open_bins), [], []
        for b in batches:
            held.append(b)
            lengths.extend(b.column(at).to_pylist())
        if not held:
            return
        placed = np.array([packer.place(n) for n in lengths], dtype=np.int64).reshape(-1, 2)
        opened = np.array(packer.still_open(carried), dtype=np.int64)
        closed = np.ones(len(placed), bool) if final else ~np.isin(placed[:, 0], opened)
        ids = placed[:, 0] + (TaskContext.get().partitionId() << 26) + (turn << 58)
        done = 0
        for b in held:
            s = slice(done, done := done + b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(ids[s]), pa.array(placed[s, 1]), pa.array(closed[s])],
                names=[*base, "sequence_id", "offset", "closed"])

    schema = T.StructType([
        *rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("closed", T.BooleanType()),
    ])
    order = [c for c in base if c != "ids"]  # the id and the piece come first
    return rows.repartition(shards).sortWithinPartitions(*order).mapInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS,
         carried: int = CARRIED_BINS) -> DataFrame:
    """``rows`` (with a column length of at most ``capacity``) and sequence_id,
    offset. A shard holds its rows' numbers in memory; ``shard_tokens`` and
    ``SHARD_ROWS`` bound them."""
    base = rows.columns  # their order is the order of arrival
    rows, turn, done, shards = settle(rows), 0, None, None
    while True:
        size = rows.agg(F.sum("length").alias("tokens"), F.count("*").alias("rows")).first()
        need = max(1, math.ceil((size["tokens"] or 0) / shard_tokens), math.ceil(size["rows"] / SHARD_ROWS))
        # fewer each round, so that it ends
        shards = need if shards is None else min(need, max(1, shards // 2))
        final = shards == 1
        packed = settle(_pack_round(rows, shards, turn, capacity, open_bins, carried, final, base))
        closed = packed.where("closed").drop("closed")
        done = closed if done is None else done.unionByName(closed)
        if final:
            return done
        rows, turn = packed.where("not closed").select(*base), turn + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   open_bins: int = OPEN_BINS, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset[, ids]."""
    return pack(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids=with_ids), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces' ids put together; a group is at most
    ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
