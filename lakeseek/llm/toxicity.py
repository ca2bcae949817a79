"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Rates are per coordinate and L1 keeps most weights at zero; what is broadcast are the
slots and weights that are not, 2^DIM_BITS of them at most, whatever the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import fresh

DIM_BITS = 20
#: Bound on the labelled rows that are learnt from: those of the smallest hash of doc_id.
MAX_TRAIN = 12_000
PASSES = 3

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SHIFT = np.uint64(64 - DIM_BITS)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str | None) -> np.ndarray:
    """Slots, repeats included, of the words, bigrams and one-word skip-grams of a whole text; slot 0 is the bias."""
    w = _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(xxhash.xxh32_intdigest, w), np.uint64, len(w))
    m = h * _M1
    grams = [m, m[:-1] ^ (h[1:] * _M2 + _M3), m[:-2] ^ (h[2:] * _M3 + _M2)]
    return (np.concatenate(grams) * _M2 >> _SHIFT).astype(np.int32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates, L1 and L2."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _fit(frames):
    """All examples of the one partition, in the order given, PASSES times -> the weights that are not zero."""
    x, y = [], []
    for f in frames:
        x += [np.unique(np.append(features(t), 0)) for t in f["text"]]
        y += f["toxic"].tolist()
    model = Ftrl()
    for _ in range(PASSES):
        for at, label in zip(x, y, strict=True):
            model.learn(at, label)
    w = model.weights(slice(None))
    keep = np.flatnonzero(w)
    yield pd.DataFrame({"slot": keep, "weight": w[keep]})


def held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights learnt from labelled rows whose crc32(doc_id) mod 5 is not 0, max_train of them at most.

    An id with labels of both kinds counts as toxic; null labels and ids are left
    out. Of rows that share an id one is learnt from: that of the least text hash.
    With no label left all weights are zero: every score is 0.5.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    some = known.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("o", "doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # else a repeated id could bring any number of rows
    fitted = rows.repartition(1).sortWithinPartitions("o", "doc_id").select("x.text", "toxic").mapInPandas(_fit, "slot int, weight double")
    got = fitted.toPandas()  # at most 2^DIM_BITS rows
    w = np.zeros(1 << DIM_BITS, np.float32)
    w[got["slot"].to_numpy(np.int64)] = got["weight"]
    return w


def scorer(spark: SparkSession, weights: np.ndarray):
    """Column function text -> probability of label 1."""
    keep = np.flatnonzero(weights)
    shared = spark.sparkContext.broadcast((keep.astype(np.int32), weights[keep]))
    dense: list[np.ndarray] = []

    def score(texts: pa.Array) -> pa.Array:
        if not dense:
            slots, values = shared.value
            dense.append(np.zeros(1 << DIM_BITS, np.float32))
            dense[0][slots] = values
        w, out = dense[0], np.zeros(len(texts))
        for i, t in enumerate(texts.to_pylist()):
            at = features(t)
            out[i] = w[np.unique(at[w[at] != 0])].sum(dtype=np.float64) if len(at) else 0
        return pa.array(1 / (1 + np.exp(-np.clip(out + w[0], -35, 35))))

    return F.arrow_udf(score, DoubleType()).asNondeterministic()


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row; the inputs of a score are the whole text and nothing else.

    A null or empty text has the bias alone. A null id is never held out.
    """
    spark = docs.sparkSession
    score = scorer(spark, train(docs, labels, max_train))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic. Null and empty texts have the bias alone; repeated rows are judged alike. A score of just 0.5, as all have without weights, says nothing: the row stays."""
    score = scorer(docs.sparkSession, train(docs, labels, max_train))
    (name,) = fresh(docs, "__toxic")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) <= 0.5).drop(name)
