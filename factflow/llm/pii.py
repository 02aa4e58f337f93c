"""Personal data: fixed patterns, plus spans added by weak supervision.

Base spans are given by patterns and always stay. Wider patterns find further
candidates (written-out addresses, numbers without a country code, card-like
numbers without a checksum, IPv6). Labelling functions of three kinds vote on
every candidate, base or not: regular expressions, gazetteers and context.
Expectation-maximisation over the counts of all vote patterns in the whole
corpus estimates each function's reliability and each pattern's probability;
those train a logistic span classifier on votes and shape, which decides which
candidates are added.

A candidate is known by its pattern, a number of ``PATTERN_BITS`` bits of kind,
votes and shape, so the corpus is counted in full and what comes to the driver
is bounded by the patterns, at any size.

Defined cases: null is empty text; texts without candidates have no spans and
the digest of the empty string; an added span never overlaps a base span or an
added one before it; of candidates that begin together the first kind listed comes
first; very long texts are read whole; a column that is called like one that is
made is replaced, all others pass unchanged; repeated rows are judged alike; an
empty table gives an empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fresh, kept, settle, table

KINDS = ("email", "ip", "card", "phone")
#: From this probability a candidate is added.
ADD_FROM = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole: nothing can match from within one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7})(?![0-9])")
_DIGIT = re.compile(r"[0-9]")

_WRITTEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?[A-Za-z0-9-]{1,63}"
    r"(?:[ ]?(?:[(\[{][ ]?dot[ ]?[)\]}]|\.)[ ]?[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
_LOCAL_PHONE = re.compile(r"(?<![\w+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![\w-])")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")

# gazetteers and words of context
_TOP_LEVELS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au jp cn in br ch at be se no fi dk pl".split())
_HINTS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv[46]|host|server|address|addr|client|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|call|mobile|cell|fax|whatsapp|sms)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|v|isbn|issn|order|invoice|ref|id|token|sha[0-9]*|hash|key|password|build|release|section|page|doi|sku)\b", re.I)

_FUNCTIONS = 6
_SHAPES = 6
PATTERN_BITS = 2 + 2 * _FUNCTIONS + _SHAPES + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the part before it is the whole run
    of its characters, so no start is tried twice."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _wide_cards(m: re.Match) -> list[tuple[int, int, int]]:
    """Of a run of digits that is no card: the numbers in it that are, where
    another number runs into them, else the run itself if it is as long as one."""
    n = len(d := _digits(m[0]))
    if 12 <= n <= 19 and _luhn(d):
        return []
    inside = [t for t in _NUMBER.finditer(m[0]) if _luhn(t[0])]
    if inside:
        return [(m.start() + t.start(), 2, m.start() + t.end()) for t in inside]
    return [(m.start(), 2, m.end())] if 13 <= n <= 19 else []


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates beyond the base."""
    out = []
    if "(" in text or "[" in text or "{" in text:
        out += [(m.start(), 0, m.end()) for m in _WRITTEN_EMAIL.finditer(text)]
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in _IPV6.finditer(text)]
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                out += _wide_cards(m)
        out += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    return sorted(out)


# Labelling functions: 1 for, 2 against, 0 no vote. Each sees the text, the span and its kind.
def _lf_layout(text: str, s: int, e: int, kind: int) -> int:
    x = text[s:e]
    if kind == 0:
        return 1 if "@" in x or re.search(r"[(\[{] ?dot ?[)\]}]", x, re.I) else 0
    if kind == 1:
        return 1
    if kind == 2:
        return 1 if re.fullmatch(r"(?:[0-9]{4}[ -]?){3}[0-9]{1,7}", x) else 2
    return 1 if x[0] == "+" or re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", x) else 0


def _lf_valid(text: str, s: int, e: int, kind: int) -> int:
    x = text[s:e]
    if kind == 2:
        return 1 if _luhn(_digits(x)) else 2
    if kind == 3:
        return 1 if 9 <= len(_digits(x)) <= 15 else 2
    return 0


def _lf_gazetteer(text: str, s: int, e: int, kind: int) -> int:
    x = text[s:e]
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9]+", x.lower().rstrip(")]} "))[-1] in _TOP_LEVELS else 2
    if kind == 2:
        return 1 if re.match(r"4|5[1-5]|2[2-7]|3[4-7]|6(?:011|5)", _digits(x)) else 2
    if kind == 3:
        return 1 if x[0] == "+" or "2" <= _digits(x)[0] <= "9" else 2
    return 0


def _lf_hint(text: str, s: int, e: int, kind: int) -> int:
    return 1 if _HINTS[KINDS[kind]].search(text, max(0, s - 30), s) else 0


def _lf_against(text: str, s: int, e: int, kind: int) -> int:
    return 2 if _AGAINST.search(text, max(0, s - 16), s) else 0


def _lf_apart(text: str, s: int, e: int, kind: int) -> int:
    before, after = text[s - 1 : s], text[e : e + 1]
    return 2 if before.isalnum() or after.isalnum() or before in ("_", "=", "#", "/") else 1


LABELLERS: tuple[Callable, ...] = (_lf_layout, _lf_valid, _lf_gazetteer, _lf_hint, _lf_against, _lf_apart)


def pattern(text: str, s: int, e: int, kind: int, base: bool) -> int:
    """Kind, votes and shape of a candidate as one number."""
    x = text[s:e]
    code = kind
    for f in LABELLERS:
        code = code << 2 | f(text, s, e, kind)
    shape = (" " in x, "-" in x, "." in x, "(" in x, s == 0 or text[s - 1] == "\n", len(x) >= 16)
    for bit in (*shape, base):
        code = code << 1 | bit
    return code


def candidates(text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Base and further spans as (start, kind, end, pattern)."""
    base = base_spans(text)
    covered = sorted((s, e) for s, _, e in base)
    extra, last = [], 0
    for s, kind, e in wide_spans(text):
        if s >= last and not any(a < e and s < b for a, b in covered):
            extra.append((s, kind, e, pattern(text, s, e, kind, False)))
            last = e
    return [(s, k, e, pattern(text, s, e, k, True)) for s, k, e in base], extra


def unpack(code: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and shape (the last: is it base) of a pattern."""
    bits = [code >> k & 1 for k in range(_SHAPES, -1, -1)]
    code >>= _SHAPES + 1
    votes = [code >> 2 * k & 3 for k in range(_FUNCTIONS - 1, -1, -1)]
    return code >> 2 * _FUNCTIONS, votes, bits


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes: each vote pattern's probability
    of being personal data, and the functions' reliabilities
    P(vote | class), shape (functions, class, vote)."""
    p = np.clip(0.5 + 0.2 * ((votes == 1).sum(axis=1) - (votes == 2).sum(axis=1)), 0.05, 0.95)
    reliability = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for f in range(votes.shape[1]):
            for v in range(3):
                own = weight * (votes[:, f] == v)
                reliability[f, 1, v] = (own * p).sum() + 0.5
                reliability[f, 0, v] = (own * (1 - p)).sum() + 0.5
        reliability /= reliability.sum(axis=2, keepdims=True)
        prior = np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99)
        log = np.log(reliability)
        yes = np.log(prior) + sum(log[f, 1, votes[:, f]] for f in range(votes.shape[1]))
        no = np.log(1 - prior) + sum(log[f, 0, votes[:, f]] for f in range(votes.shape[1]))
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return p, reliability


def train_classifier(counts: dict[int, int], steps: int = 300, rate: float = 0.5) -> dict[int, float]:
    """Probability of each pattern from the final span classifier: logistic
    regression on votes and shape, taught by the estimated probabilities. Base
    spans teach as what they are."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = sorted(c for c in counts if unpack(c)[0] == kind)
        if not own:
            continue
        weight = np.array([counts[c] for c in own], float)
        votes = np.array([unpack(c)[1] for c in own])
        shape = np.array([unpack(c)[2] for c in own], float)
        p, _ = estimate(votes, weight)
        p = np.where(shape[:, -1] > 0, 1.0, p)
        x = np.concatenate([votes == 1, votes == 2, shape[:, :-1], np.ones((len(own), 1))], axis=1).astype(float)
        # a pattern weighs by the logarithm of its count, so that rare ones are heard
        w = np.log1p(weight) / np.log1p(weight).sum()
        theta = np.zeros(x.shape[1])
        for _ in range(steps):
            q = 1 / (1 + np.exp(-x @ theta))
            theta -= rate * (x.T @ (w * (q - p)) + 1e-3 * theta)
        q = 1 / (1 + np.exp(-x @ theta))
        # the classifier may only confirm what the votes make likely
        out.update(zip(own, np.minimum(q, p).tolist(), strict=True))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))
_SPANS_SCHEMA = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "kind", "end", "pattern")]))


def find_candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, base_out: str = "base", extra_out: str = "extra") -> DataFrame:
    """The columns ``keep`` (all, if None), base spans and further candidates:
    arrays of struct(start, kind, end, pattern)."""
    keep = kept(docs, keep, base_out, extra_out)
    source = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text_")))
    n = len(keep)
    names = ("start", "kind", "end", "pattern")

    def run(batches):
        for b in batches:
            base, extra = [], []
            for text in b.column(n).to_pylist():
                x, y = candidates(text or "")
                base.append([dict(zip(names, s, strict=True)) for s in x])
                extra.append([dict(zip(names, s, strict=True)) for s in y])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(base, _SPANS), pa.array(extra, _SPANS)], names=[*keep, base_out, extra_out])

    fields = [*source.schema.fields[:n], T.StructField(base_out, _SPANS_SCHEMA), T.StructField(extra_out, _SPANS_SCHEMA)]
    return source.mapInArrow(run, T.StructType(fields))


def learn_accepted(found: DataFrame, base: str = "base", extra: str = "extra", add_from: float = ADD_FROM) -> list[int]:
    """Patterns of further candidates that the classifier accepts, from the
    counts of all patterns in ``found``."""
    spans = F.explode(F.concat(F.col(base), F.col(extra))["pattern"])
    counts = found.select(spans.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    likely = train_classifier({r["p"]: r["n"] for r in counts})
    return sorted(c for c, p in likely.items() if p >= add_from and not unpack(c)[2][-1])


def accepted_spans(found: DataFrame, accepted: list[int], base: str = "base", extra: str = "extra"):
    """All spans of a row, sorted by start, kind and end."""
    known = F.from_json(F.lit(str(accepted)), "array<int>")
    added = F.filter(F.col(extra), lambda s: F.array_contains(known, s["pattern"]))
    return F.array_sort(F.concat(F.col(base), added))


def _joined(spans):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every span of personal data is replaced by its kind in angle brackets;
    overlapping spans by that of the first. Rows and other columns stay."""
    base, extra, spans = (fresh(docs.columns, x) for x in ("base", "extra", "spans"))
    # the search is cheap against storing the texts once more
    accepted = learn_accepted(settle(find_candidates(docs, text_col, [], base, extra)), base, extra)
    found = find_candidates(docs, text_col, None, base, extra)
    found = found.withColumn(spans, accepted_spans(found, accepted, base, extra))
    t, kinds = F.col(text_col), F.array(*(F.lit(k) for k in KINDS))
    done = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["done"]).otherwise(
                F.concat(acc["done"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.get(kinds, s["kind"]), F.lit(">"))
            ).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(t, acc["at"] + 1, F.length(t))),
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(t)).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(find_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))
    accepted = learn_accepted(found)
    base = F.array_sort(F.col("base"))
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *(n(k) for k in range(4)), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(accepted_spans(found, accepted)).alias("spans"),
    )
