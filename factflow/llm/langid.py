"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed
character n-grams, trained with follow-the-regularised-leader under an elastic
net, then calibrated by one temperature.

A feature is a bucket's share of the text, by the logarithms of the counts,
times its inverse document frequency. Document frequencies are counted over all rows to learn
from; the counts have one number per bucket, at any size. The weights are fitted
on a sample of at most ``train_rows`` rows in expectation, chosen by a hash of
the whole text, copies once; a fifth of it is kept from the fit for the
temperature. The languages are those of all rows that have a letter: of one with
a smaller share of the sample, ``least_rows`` different texts are taken in
expectation, or all it has, which adds at most as many rows for each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text if there is nothing to learn from; with one language to learn, it
is predicted with score 1; equal scores give the language that sorts first; null
ids are outside the held-out fold; very long texts are read whole, in parts; a
column that is called like one that is made is replaced, all others pass
unchanged; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.llm.common import fold, fresh, kept, sampled, table
from factflow.llm.ngrams import Stream, groups

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
#: Rows that the weights and the temperature are fitted on (expected at most).
TRAIN_ROWS = 4096
#: Different texts that each language is learned from (expected at least, if it has as many).
LEAST_ROWS = 128
UNKNOWN = "und"
#: Below this score the pipeline takes a text for no known language.
REJECT_BELOW = 0.3


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(row, buckets, counts, has letters) of each text, in order."""
    counts, row, letters = None, -1, False

    def done():
        used = np.flatnonzero(counts)
        return row, used, counts[used], letters

    for rows, parts, _ in groups(texts):
        stream = Stream(parts)
        every = [stream.hashed(n, BUCKET_BITS) for n in ORDERS]
        cuts = np.searchsorted(stream.part, np.arange(len(parts) + 1))
        for k, r in enumerate(rows.tolist()):
            if r != row:
                if counts is not None:
                    yield done()
                counts, row, letters = np.zeros(1 << BUCKET_BITS, np.int64), r, False
            letters = letters or bool(stream.codes[cuts[k] : cuts[k + 1]].any())
            own = []
            for bucket, valid in every:
                s = slice(cuts[k], min(cuts[k + 1], len(bucket)))
                own.append(bucket[s][valid[s]])
            counts += np.bincount(np.concatenate(own), minlength=1 << BUCKET_BITS)
    if counts is not None:
        yield done()


def _shares(counts: np.ndarray) -> np.ndarray:
    """Term frequencies grow with the logarithm of a count, so that a line that
    is repeated a hundred times does not outvote the rest of a text."""
    x = np.log1p(counts)
    return x / max(x.sum(), 1e-12)


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(rows that hold each bucket, all rows)."""

    def run(batches):
        counts, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, used, _, _ in _features(_strings(b.column(0))):
                counts[used] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[used], n), pa.int64())], names=["bucket", "n"])

    made = rows.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long")
    total = made.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BUCKET_BITS, np.int64)
    inside = total[total.bucket >= 0]
    df[inside.bucket.to_numpy()] = inside.n.to_numpy()
    return df, int(total.n[total.bucket < 0].sum())


def _sample_features(rows: DataFrame, text_col: str, lang_col: str):
    """Languages and sparse counts of the sampled rows."""

    def run(batches):
        for b in batches:
            got = [(i.astype(np.int32), n.astype(np.int32)) for _, i, n, _ in _features(_strings(b.column(0)))]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), *(pa.array([x[c] for x in got], pa.list_(pa.int32())) for c in (0, 1))], names=["lang", "idx", "n"])

    sent = rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return sent.mapInArrow(run, "lang string, idx array<int>, n array<int>").toPandas()


class Ftrl:
    """Proximal follow-the-regularised-leader for a softmax, per coordinate."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket -> weight times inverse document frequency, float32
    bias: np.ndarray
    temperature: float


#: Shares of n-grams are small numbers; this brings features near one.
SCALE = 30.0


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, epochs: int = 4, seed: int = 7,
          least_rows: int = LEAST_ROWS) -> LanguageModel | None:
    """Learn from all rows of ``docs`` with a language; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    df, n = document_frequencies(rows, text_col)
    if not n:
        return None
    # a row is in by its hash: the share, not a count, is fixed before the rows are seen
    share = min(1.0, train_rows / n)
    rows = rows.select(F.col(text_col).alias("text_"), F.col(lang_col).alias("lang_"))
    different = rows.where(F.col("text_").rlike(r"\p{L}")).select("lang_", F.xxhash64("text_").alias("h_")).distinct().groupBy("lang_").count()
    # one row per language
    below = different.select("lang_", F.greatest(F.lit(share), F.lit(float(least_rows)) / F.col("count")).alias("below_"))
    inside = sampled(F.xxhash64(F.col("text_"), F.lit(seed)), F.col("below_"))
    # copies fall on one hash: they teach once, or a large group would be the sample
    own = rows.join(F.broadcast(below), "lang_").where(inside).groupBy(F.xxhash64("text_").alias("h_"), "lang_").agg(F.first("text_").alias("text_"))
    got = _sample_features(own, "text_", "lang_")
    got = got[got.n.map(sum) > len(ORDERS)].sort_values(["lang"], kind="stable") if len(got) else got
    if not len(got):
        return None
    idf = np.log((1 + n) / (1 + df)) + 1.0
    languages = sorted(set(got.lang))
    y = got.lang.map(languages.index).to_numpy()
    size = 1 << BUCKET_BITS  # the last feature is the bias
    vectors = []
    for i, c in zip(got.idx, got.n, strict=True):
        i, c = np.asarray(i, np.int64), np.asarray(c, float)
        vectors.append((np.append(i, size), np.append(_shares(c) * idf[i] * SCALE, 1.0)))
    order = np.random.default_rng(seed).permutation(len(y))
    held, fitted = order[::5], np.delete(order, np.s_[::5])
    alone = ~np.isin(y[held], y[fitted])  # else such a language would not be learned
    held, fitted = held[~alone], np.append(fitted, held[alone])
    model = Ftrl(size + 1, len(languages))
    for _ in range(epochs):
        for k in fitted:
            model.learn(*vectors[k], y[k])
    w = model.weights()
    logits = np.array([x @ w[i] for i, x in (vectors[k] for k in held)]).reshape(-1, len(languages))
    return LanguageModel(languages, (w[:size] * idf[:, None] * SCALE).astype(np.float32), w[size], fit_temperature(logits, y[held]))


def predict(texts: list[str], model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return out, score
    for row, used, counts, letters in _features(texts):
        if letters:
            p = softmax((_shares(counts) @ model.table[used] + model.bias) / model.temperature)
            best = int(p.argmax())
            out[row], score[row] = model.languages[best], p[best]
    return out, score


def with_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", keep: list[str] | None = None,
                  lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns ``keep`` (all, if None), the predicted language and its score."""
    keep = kept(docs, keep, lang_out, score_out)
    source = docs.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text_")))
    n = len(keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score = predict(_strings(b.column(n)), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, lang_out, score_out])

    fields = [*source.schema.fields[:n], T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    return source.mapInArrow(run, T.StructType(fields))


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = REJECT_BELOW) -> DataFrame:
    """Rows whose text is in a learned language; without letters, or with a
    score under ``below``, they go. Nothing learned: nothing is rejected but
    texts without letters."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    if model is None:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    judged = with_language(docs, model, text_col, None, lang, score)
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= below)).select(*docs.columns)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    judged = with_language(docs, model, keep=["doc_id"])
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
