"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (first 3 to 8 characters, so that a
word seen only in other forms counts), word pairs and pairs with one word between, hashed
to `DIMENSIONS` places. Training follows the regularised leader, one document at
a time with a rate of its own for each coordinate; the L1 term leaves most weights at
exactly zero, so the model that is broadcast has a few thousand numbers.

Training takes at most `MAX_TRAIN_DOCS` labelled documents, half of either label, those
with the smallest hash of the id, and never one whose crc32(doc_id) mod 5 is 0: these are
held out. Their features are hashed where the documents lie, and of a longer text the `MAX_TRAIN_PLACES`
lowest places train; so the sample that goes through the one task that fits the weights is bounded
(some 500 MB at most). Scores see whole texts.

Defined results: a null or empty text has no features and scores as the bias says; a null
id is not held out and never trains; null or other labels train nothing; with labels of
one kind only every score is 0; repeated rows score alike, and one row trains for all rows
of an id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import add_columns, bounded_sample, table
from barlens.llm.decontaminate import words_of

DIMENSIONS = 1 << 20
MAX_TRAIN_DOCS = 8_000
MAX_TRAIN_PLACES = 1 << 14
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0
STEMS = range(3, 9)
# Words whose hashes a task keeps.
MAX_WORDS = 200_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    """word -> its hash and those of its stems, as little-endian 64-bit integers."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        parts = [word, *(b"%d:" % n + text[:n].encode() for n in STEMS if len(text) > n)]
        out = self[word] = b"".join(xxhash.xxh3_64_intdigest(x).to_bytes(8, "little") for x in parts)
        return out


def features(text: bytes | None, hashes: dict) -> np.ndarray:
    """Hashed places of all words, stems, neighbouring pairs and pairs around a word; some repeat."""
    found = words_of(text)
    words = np.frombuffer(b"".join([hashes[w][:8] for w in found]), dtype="<u8")
    stems = np.frombuffer(b"".join([hashes[w] for w in set(found)]), dtype="<u8")
    pairs = words[:-1] * _ODD[0] + words[1:] * _ODD[1]
    skips = words[:-2] * _ODD[2] + words[2:] * _ODD[3]
    every = np.concatenate([stems, pairs, skips])
    every = (every ^ (every >> np.uint64(29))) * _ODD[0]
    return (every >> np.uint64(44)).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
        l1: float = L1, l2: float = L2, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias.

    `rows`: distinct feature places and label of each document, in the order of training.
    The bias is one more coordinate without L1.
    """
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    bias = dimensions
    lasso = np.full(dimensions + 1, l1)
    lasso[bias] = 0.0

    def weights(at):
        away = np.abs(z[at]) - lasso[at]
        return np.where(away > 0, -np.sign(z[at]) * away / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for places, label in rows:
            at = np.append(places, bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = weights(np.arange(dimensions + 1))
    found = np.flatnonzero(all_weights[:bias])
    return found, all_weights[found], float(all_weights[bias])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          label_id: str = "doc_id", label: str = "toxic", max_docs: int = MAX_TRAIN_DOCS):
    """(places, weights, bias), or None with labels of one kind only."""
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull() & ~is_held_out(F.col(label_id)))
    wanted = wanted.groupBy(F.col(label_id).alias("sample_id")).agg(F.max(label).cast("int").alias("sample_label"))
    each = [bounded_sample(wanted.where(F.col("sample_label") == y), "sample_id", max_docs // 2) for y in (0, 1)]
    sample = F.broadcast(each[0].unionByName(each[1]))
    rows = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("sample_text")).join(sample, "sample_id")

    def maker():
        hashes = _WordHashes()
        return lambda texts: [pa.array([np.unique(features(t, hashes))[:MAX_TRAIN_PLACES].tobytes() for t in texts], type=pa.binary())]

    hashed = add_columns(rows, "sample_text", [T.StructField("places", T.BinaryType())], maker,
                         keep=["sample_id", "sample_label"])
    hashed = hashed.groupBy("sample_id", "sample_label").agg(F.max("places").alias("places"))

    def fit_all(batches):
        ids, sets, marks = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
            sets += [np.frombuffer(x, dtype=np.uint32) for x in batch.column(2).to_pylist()]
        # An order that mixes the labels and is the same in every run.
        order = sorted(range(len(ids)), key=lambda i: xxhash.xxh3_64_intdigest(str(ids[i])))
        if len(set(marks)) == 2:
            places, weights, bias = fit([(sets[i], marks[i]) for i in order])
            yield pa.RecordBatch.from_pydict({"places": pa.array([places.tolist()], pa.list_(pa.int32())),
                                              "weights": pa.array([weights.tolist()], pa.list_(pa.float64())),
                                              "bias": pa.array([bias])})

    fitted = hashed.coalesce(1).mapInArrow(fit_all, "places array<int>, weights array<double>, bias double").collect()
    if not fitted:
        return None
    places, weights, bias = fitted[0]
    return np.array(places, dtype=np.int64), np.array(weights, dtype=np.float64), bias


def score(docs: DataFrame, model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def maker():
        hashes, dense = _WordHashes(), np.zeros(DIMENSIONS)
        if known.value is not None:
            places, weights, bias = known.value
            dense[places] = weights

        def work(texts):
            out = []
            for t in texts:
                if known.value is None:
                    out.append(0.0)
                    continue
                found = features(t, hashes)
                found = np.unique(found[dense[found] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(dense[found].sum() + bias, -35, 35)))))
            return [pa.array(out, type=pa.float64())]

        return work

    scored = add_columns(rows, "text", [T.StructField("score", T.DoubleType())], maker, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
