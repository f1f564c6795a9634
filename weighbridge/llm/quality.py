"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader and scored as a sparse dot product.

Features are words (runs of letters and digits, or of other signs, by UTF-8 bytes,
in their own case) and pairs of neighbours, each hashed to one of ``DIM`` weights;
a pair of equal words is one feature of its own whatever the word. A document's
values are its feature counts over the square root of their number, plus a bias.

The model is fitted on a bounded sample: of the labelled documents at hand, those
whose hashed id falls below ``max_docs`` over their number, so some ``max_docs``
of them at most, in hashed order, as far as their features add up to ``max_features``, ``epochs`` times. So the one
task that fits holds at most that many features, as the bytes it was sent, whatever the texts' length. Scoring covers every whole text.

Defined cases: null and empty texts have the bias alone; conflicting labels of an id
are averaged and a half counts as 1, null labels and ids are not learned from; a null
id is scored and not held out; with nothing to learn from, every score is 0.5.
Rows that repeat an id are scored each, and learned from once (the smallest feature bytes); very long texts are whole features of
one document; ties of hashed ids are one place, learned from once; empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.session import materialize

DIM = 1 << 20
WORD = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
MAX_DOCS = 16_384
MAX_FEATURES = 24_000_000  # 96 MB


def features(text: bytes | None) -> np.ndarray:
    """Feature index of each word and pair of one text (with repeats), the bias first."""
    words = WORD.findall(text or b"")
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)
    two = (two ^ (two >> np.uint64(29))) % np.uint64(DIM - 2) + np.uint64(2)
    two[one[:-1] == one[1:]] = 1
    return np.concatenate([np.zeros(1, np.uint64), one % np.uint64(DIM - 2) + np.uint64(2), two]).astype(np.int64)


def values(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values."""
    unique, counts = np.unique(index, return_counts=True)
    x = counts / np.sqrt(max(len(index) - 1, 1))
    x[0] = 1.0  # the bias, index 0, is always there
    return unique, x


class Ftrl:
    """FTRL-proximal logistic regression; weights are derived from ``z`` and ``n`` when used."""

    def __init__(self):
        self.z, self.n = np.zeros(DIM), np.zeros(DIM)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_docs: int = MAX_DOCS, epochs: int = 3, label_col: str = "quality", max_features: int = MAX_FEATURES) -> np.ndarray:
    """Weights learned from ``labels`` (``doc_id``, label 0 or 1) of documents that are not ``held_out``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40))
    picked = known.withColumn("place", place).where(F.col("place") < int((1 << 40) * min(1.0, max_docs / max(n, 1))))

    def prepare(batches):
        for batch in batches:
            at = pa.array([features(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at], names=["place", "y", "at"])

    def train(batches):
        rows = [r for batch in batches for r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(epochs):
            for y, at in rows:
                index, x = values(np.frombuffer(at, np.int32))
                model.learn(index, x.astype(np.float32), y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["w"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = texts.join(picked, "doc_id").select("place", "y", "text").mapInArrow(prepare, "place long, y int, at binary")
    sample = materialize(sample.groupBy("place").agg(F.max("y").alias("y"), F.min("at").alias("at")), "quality-sample")
    sizes = sample.select("place", (F.length("at") / 4).alias("n")).orderBy("place").collect()  # at most some ``max_docs`` rows
    total = np.cumsum([r["n"] for r in sizes])
    last = sizes[max(int(np.searchsorted(total, max_features, side="right")), 1) - 1]["place"] if sizes else -1
    dealt = sample.where(F.col("place") <= last).repartition(1).sortWithinPartitions("place")
    model = dealt.mapInArrow(train, "w binary").collect()
    return np.frombuffer(model[0]["w"], np.float32) if model else np.zeros(DIM, np.float32)


def scorer(spark: SparkSession, weights: np.ndarray):
    """Column function: the score of a text column."""
    model = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w, out = model.value, np.empty(len(texts))
        for i, text in enumerate(texts):
            at = features(text)
            out[i] = w[0] + w[at[1:]].sum(dtype=np.float64) / np.sqrt(max(len(at) - 1, 1))
        return pd.Series(sigmoid(out))

    return lambda text: run(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int = 1, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns only from labels outside ``out_fold``."""
    held = fold(F.col("doc_id"), folds) == out_fold
    score = scorer(docs.sparkSession, fit(docs, labels, held, max_docs))
    scored = docs.select("doc_id", held.alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int = 1, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be of quality 1."""
    held = fold(F.col("doc_id"), folds) == out_fold
    return docs.where(scorer(docs.sparkSession, fit(docs, labels, held, max_docs))(F.col("text")) >= 0.5)
