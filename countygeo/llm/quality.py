"""Quality scores from hashed word n-grams and follow-the-regularised-leader updates (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.model import fold, logistic_fit, sample, sigmoid
from countygeo.llm.text import VISIBLE, blocks, mix, raw, words

# Hash buckets, longest n-gram in words, labelled documents to learn from at most.
BUCKETS, NGRAM, SAMPLE = 1 << 18, 2, 12_000
# Learning rate and penalties of the updates; passes over the sample; every HOLD-th document calibrates.
ALPHA, BETA, L1, L2, PASSES, HOLD = 0.5, 1.0, 0.3, 1.0, 3, 5
# Score from which a document counts as label 1.
LIMIT = 0.3


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all texts, sorted by text; number for each text).

    Each word n-gram is a feature once in a text; a word said for the second,
    fourth, eighth ... time is one more. Two features name the tenth in which the
    share of distinct words, and of words equal to the one before, lies.
    """
    n = batch.num_rows
    data, bounds = raw(pc.utf8_lower(pc.fill_null(batch.column("text"), "")))
    hashed, _, _, row = words(data, bounds, VISIBLE)
    keys = []
    gram = np.zeros(len(hashed), dtype=np.uint64)
    for k in range(min(NGRAM, len(hashed))):
        gram = mix(gram[:len(hashed) - k] * np.uint64(3) + hashed[k:])
        at = np.flatnonzero(row[:len(gram)] == row[k:])
        bucket = gram[at] & np.uint64(BUCKETS - 1)
        key, times = np.unique(row[at].astype(np.uint64) * np.uint64(BUCKETS) + bucket, return_counts=True)
        keys.append(key)
        power = 2
        while k == 0 and len(again := key[times >= power]):
            step = mix(again + np.uint64(power)) & np.uint64(BUCKETS - 1)
            keys.append(again - again % np.uint64(BUCKETS) + step)
            power *= 2
    if keys:
        size = np.maximum(np.bincount(row, minlength=n), 1)
        distinct = np.bincount((keys[0] // np.uint64(BUCKETS)).astype(np.int64), minlength=n)
        again = np.bincount(row[1:][(hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])], minlength=n)
        some = np.unique(row)
        for k, count in enumerate((distinct, again)):
            tenth = mix((1000 * (k + 1) + np.minimum(10 * count // size, 9)[some]).astype(np.uint64)) & np.uint64(BUCKETS - 1)
            keys.append(some.astype(np.uint64) * np.uint64(BUCKETS) + tenth)
    flat = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    owner = (flat // np.uint64(BUCKETS)).astype(np.int64)
    return (flat % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=n)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        bucket, size = features(batch)
        cut = np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"),
             pa.array([bucket[b - n:b].tobytes() for b, n in zip(cut, size, strict=True)], pa.binary())],
            ["doc_id", "label", "ids"])


@dataclass
class Model:
    """Weights of the buckets that are not zero, and slope and bias of the calibration."""

    bucket: np.ndarray
    weight: np.ndarray
    slope: float
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.bucket] = self.weight
        return out


def train(rows: list[np.ndarray], label: np.ndarray, seed: int = 11) -> Model:
    """FTRL-proximal with per-coordinate rates; a text's features all weigh 1 / sqrt(their number)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weight(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    held = np.arange(len(rows)) % HOLD == HOLD - 1
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    share = np.clip(label[fit].mean(), 1e-3, 1 - 1e-3) if len(fit) else 0.5
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in rng.permutation(fit):
            at = rows[k]
            if not len(at):
                continue
            x = 1 / np.sqrt(len(at))
            w = weight(at)
            g = (sigmoid(w.sum() * x) - label[k]) * x * balance[k]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weight(np.arange(BUCKETS))
    check = np.flatnonzero(held) if held.any() else fit
    margin = np.array([every[rows[k]].sum() / np.sqrt(max(len(rows[k]), 1)) for k in check]).reshape(-1, 1)
    slope, bias = logistic_fit(margin, label[check])
    kept = np.flatnonzero(every)
    return Model(kept, every[kept], float(slope), float(bias))


def fit_model(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
              limit: int = SAMPLE) -> Model:
    """Model from the ``limit`` labelled documents that come first by hash of the id; only bucket numbers reach the driver."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = sample(marked.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", limit)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(_features, f"doc_id {kind}, label int, ids binary").toPandas().sort_values("doc_id", ignore_index=True))
    return train([np.frombuffer(x, dtype=np.int32) for x in rows["ids"]], rows["label"].to_numpy())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.dense()
        for batch in blocks(batches):
            bucket, size = features(batch)
            row = np.repeat(np.arange(batch.num_rows), size)
            margin = np.bincount(row, weights=weight[bucket], minlength=batch.num_rows) / np.sqrt(np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(model.slope * margin + model.bias))],
                                             ["doc_id", "score"])

    return run


def score_quality(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, score and predicted of every row, from its whole text.

    Null and empty texts have no features and get the score of the bias. Each
    repeated row has its own result; columns of other names are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.mapInArrow(_score(model), f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= limit).cast("int")))


def grade(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          folds: int = 5, held_out: int = 0) -> DataFrame:
    """Scores of all documents by a model that never saw labels of the held-out fold."""
    model = fit_model(documents, labels.where(fold(doc_id, folds) != held_out), doc_id, text, label)
    return score_quality(documents, model, doc_id, text).withColumn(
        "held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)))
