"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the
hashed character n-grams that it holds; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are given: the gradient of the
noisy-or shares a document's blame among its sentences, and afterwards the
sentence probabilities locate the offending ones.

The weights are fitted on a sample of at most ``train_rows`` labelled documents
in expectation, chosen by a hash of their ids; the sample is the only thing that
is broadcast or sent to the driver, as counts of n-grams and sparse features.
Every text is scored whole.

Defined cases: a null, empty or letterless text has no sentence and score 0; no
labels to learn from give score 0 to all; a document with several labels counts
as toxic if one says so; of rows with one id, one teaches; null labels and ids do not teach; repeated rows are
scored alike; very long texts are scored whole, in parts; a column that is called
like one that is made is replaced, all others pass unchanged; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fold, fresh, kept, sampled, settle, table
from factflow.llm.ngrams import Stream, groups

ORDER = 5
BUCKET_BITS = 18
#: Labelled documents that the weights are fitted on (expected at most).
TRAIN_ROWS = 16_384
#: n-grams may get a weight from this z-score on, for either side; however many they are.
LEAST_Z = 3.0
#: Features that the fit looks at together, whole sentences at least.
BLOCK = 1 << 17
THRESHOLD = 0.3
_BREAKS = np.array([ord(c) for c in ".!?\n\r…。！？"], np.uint32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # bucket -> weight, float32; most are 0
    bias: float


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class _Sentences:
    """The n-grams of a group of texts and the sentence of each; a mark that
    ends a sentence is the first place of the next."""

    def __init__(self, parts: list[str]):
        self.stream = stream = Stream(parts)
        self.ends = np.isin(stream.chars, _BREAKS)
        number = np.cumsum(self.ends)  # parts are parted by line ends, so no sentence goes over
        at = number[stream.at]
        self.bucket, self.valid = stream.hashed(ORDER, BUCKET_BITS)
        middle = slice(ORDER // 2, ORDER // 2 + len(self.bucket))
        self.sentence, self.part = at[middle], stream.part[middle]
        letters = stream.codes > 0
        own, first = np.unique(at[letters], return_index=True)
        self.count = np.bincount(stream.part[letters][first], minlength=len(parts))
        self.number, self.own = number, own


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, seed: int = 11) -> DataFrame:
    """(text, toxic) of a sample; its ids, bounded by ``train_rows``, are
    broadcast, so that the texts are not shuffled."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg((F.max(label_col) > 0).alias("toxic_"))
    share = min(1.0, train_rows / max(1, known.count()))
    own = known.where(sampled(F.xxhash64(F.col(id_col), F.lit(seed)), share)).select(F.col(id_col).alias("id_"), "toxic_")
    chosen = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    taken = chosen.join(F.broadcast(own), "id_").groupBy("id_")
    taken = taken.agg(F.min_by("text_", F.xxhash64("text_")).alias("text_"), F.first("toxic_").alias("toxic_"))
    return settle(taken.select("text_", "toxic_"))


def select_features(sample: DataFrame, least_z: float = LEAST_Z) -> tuple[np.ndarray, int]:
    """The buckets that tell toxic documents from others, whichever they speak
    for: all with a z-score of the difference of document shares from
    ``least_z``; and the sample's size."""

    def run(batches):
        counts, docs = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            docs += np.bincount(toxic, minlength=2)
            for rows, parts, _ in groups(_strings(b.column(0))):
                own = _Sentences(parts)
                cuts = np.searchsorted(own.part, np.arange(len(parts) + 1))
                for k in range(len(parts)):
                    s = slice(cuts[k], cuts[k + 1])
                    counts[toxic[rows[k]], np.unique(own.bucket[s][own.valid[s]])] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], docs[0])), pa.array(np.append(counts[1, used], docs[1]))],
            names=["bucket", "clean", "toxic"])

    made = sample.mapInArrow(run, "bucket long, clean long, toxic long")
    # at most one row per bucket
    total = made.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    size = total[total.bucket < 0]
    if not len(size) or not int(size.clean.iloc[0]) or not int(size.toxic.iloc[0]):
        return np.zeros(0, np.int64), int(size.clean.sum() + size.toxic.sum())
    n0, n1 = float(size.clean.iloc[0]), float(size.toxic.iloc[0])
    total = total[total.bucket >= 0]
    a, c = total.clean.to_numpy() / n0, total.toxic.to_numpy() / n1
    share = (total.clean.to_numpy() + total.toxic.to_numpy() + 1) / (n0 + n1 + 2)
    z = (c - a) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    return np.sort(total.bucket.to_numpy()[np.abs(z) >= least_z]), int(n0 + n1)


def _bags(sample: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels and counts of sentences of the documents; how many sentences of
    each hold a chosen n-gram; how many features each of these has; and the
    features, sentence by sentence. Flat, four bytes a feature."""
    held = sample.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        place = np.full(1 << BUCKET_BITS, -1, np.int64)
        place[held.value] = np.arange(len(held.value))
        for b in batches:
            toxic, count, pairs = b.column(1).to_pylist(), np.zeros(b.num_rows, np.int64), {}
            for rows, parts, _ in groups(_strings(b.column(0))):
                own = _Sentences(parts)
                np.add.at(count, rows, own.count)
                f = np.where(own.valid, place[own.bucket], -1)
                hit = f >= 0
                got = np.unique(np.stack([own.part[hit], own.sentence[hit], f[hit]], axis=1), axis=0)
                for k in np.unique(got[:, 0]):
                    mine = got[got[:, 0] == k, 1:]
                    pairs.setdefault(int(rows[k]), []).append((np.unique(mine[:, 0], return_counts=True)[1], mine[:, 1]))
            merged = [[np.concatenate([x[c] for x in pairs[r]]).astype(np.int32) if r in pairs else np.zeros(0, np.int32) for r in range(b.num_rows)] for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic), pa.array(count), *(pa.array(x, pa.list_(pa.int32())) for x in merged)], names=["toxic", "count", "run", "feature"])

    got = sample.mapInArrow(run, "toxic boolean, count long, run array<int>, feature array<int>").toArrow()
    flat = [np.concatenate([c.flatten().to_numpy() for c in got.column(x).chunks] or [np.zeros(0, np.int32)]) for x in ("run", "feature")]
    sentences = np.concatenate([c.value_lengths().to_numpy() for c in got.column("run").chunks] or [np.zeros(0, np.int32)])
    return got.column("toxic").to_numpy().astype(bool), got.column("count").to_numpy(), sentences, *flat


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit_noisy_or(y: np.ndarray, count: np.ndarray, sentences: np.ndarray, run: np.ndarray, feature: np.ndarray, features: int,
                 steps: int = 400, rate: float = 0.1, l1: float | None = None, bias: float = -6.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean negative log-likelihood of the
    noisy-or, with an L1 penalty on the weights (by default as the root of the
    sample's size asks for). Features are gone through ``BLOCK`` at a time."""
    l1 = 0.03 / np.sqrt(len(y)) if l1 is None else l1
    owner, end = np.repeat(np.arange(len(y)), sentences), np.cumsum(run, dtype=np.int64)
    first = end - run
    cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(feature), BLOCK)), len(run))).tolist()
    blocks = [(lo, hi, feature[first[lo] : end[hi - 1]]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    z = np.zeros(len(run))
    empty = np.maximum(count - np.bincount(owner, minlength=len(y)), 0)
    theta = np.zeros(features + 1)
    theta[-1] = bias
    m = v = np.zeros(features + 1)
    for t in range(1, steps + 1):
        b = theta[-1]
        for lo, hi, f in blocks:
            z[lo:hi] = np.add.reduceat(theta[f], first[lo:hi] - first[lo]) + b
        a = np.bincount(owner, _softplus(z), minlength=len(y)) + empty * _softplus(b)
        blame = np.where(y, -1 / np.expm1(np.clip(a, 1e-9, 500)), 1.0) / len(y)
        gz = _sigmoid(z) * blame[owner]
        gw = sum(np.bincount(f, np.repeat(gz[lo:hi], run[lo:hi]), minlength=features) for lo, hi, f in blocks)
        g = np.append(gw + l1 * np.sign(theta[:-1]), gz.sum() + (blame * empty).sum() * _sigmoid(b))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = theta[:-1]
    w[np.abs(w) < 0.05] = 0
    return w, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel | None:
    """Learn from all of ``labels``; None if both kinds are not among them."""
    sample = sample_labelled(docs, labels, id_col, text_col, label_col, train_rows)
    chosen, _ = select_features(sample)
    if not len(chosen):
        return None
    w, bias = fit_noisy_or(*_bags(sample, chosen), len(chosen))
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    weights[chosen] = w
    return ToxicityModel(weights, bias)


def score_texts(texts: list[str], model: ToxicityModel | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores, and (start, end, probability) of the sentences from ``threshold``."""
    risk, spans = np.zeros(len(texts)), [[] for _ in texts]
    if model is None:
        return risk, spans
    for rows, parts, offsets in groups(texts):
        own = _Sentences(parts)
        hit = np.flatnonzero(own.valid & (model.weights[own.bucket] != 0))
        pairs = np.unique(np.stack([own.part[hit], own.sentence[hit], own.bucket[hit].astype(np.int64)], axis=1), axis=0)
        found, s = np.unique(pairs[:, :2], axis=0, return_inverse=True)
        z = np.bincount(s.reshape(-1), model.weights[pairs[:, 2]], minlength=len(found)) + model.bias
        np.add.at(risk, rows[found[:, 0]], _softplus(z))
        plain = own.count - np.bincount(found[:, 0], minlength=len(parts))
        np.add.at(risk, rows, np.maximum(plain, 0) * _softplus(model.bias))
        p = _sigmoid(z)
        for k in np.flatnonzero(p >= threshold):
            part, number = found[k]
            lo, hi = np.searchsorted(own.number, [number, number + 1])
            start = lo + (1 if own.ends[lo] else 0)
            base = own.stream.starts[part] + 1
            end = min(hi + 1, base + len(parts[part]))  # the mark that ends it belongs to it
            spans[rows[part]].append((int(start - base) + offsets[part], int(end - base) + offsets[part], float(p[k])))
    return -np.expm1(-risk), spans


def with_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep: list[str] | None = None,
                  score_out: str = "score", spans_out: str = "sentences", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` (all, if None), the score, and the offending
    sentences: array of struct(start, end, score), in characters."""
    keep = kept(docs, keep, score_out, spans_out)
    source = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text_")))
    n = len(keep)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            score, spans = score_texts(_strings(b.column(n)), held.value, threshold)
            found = [[{"start": s, "end": e, "score": p} for s, e, p in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(score), pa.array(found, kind)], names=[*keep, score_out, spans_out])

    one = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    fields = [*source.schema.fields[:n], T.StructField(score_out, T.DoubleType()), T.StructField(spans_out, T.ArrayType(one))]
    return source.mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 4) == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = with_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"),
    )
