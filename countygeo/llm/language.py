"""Language identification by averaged hashed subword embeddings (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.model import fold, softmax
from countygeo.llm.text import LETTERS, blocks, mix, raw
from countygeo.operators.ranking import top_k_per_key

# Hash buckets of subwords, size of their vectors, and subword lengths in bytes.
BUCKETS, WIDTH, LENGTHS = 1 << 14, 16, (1, 2, 3)
# Text bytes scored at once; each has several subwords.
BYTES = 500_000
# Labelled documents for each language at most, for fitting and calibrating.
PER_LANGUAGE = 1200
# Every HOLD-th document of the sample calibrates instead of fitting.
HOLD = 5
# Passes over the sample, or more until MIN_STEPS batches are seen.
EPOCHS, MIN_STEPS, BATCH, RATE = 12, 900, 64, 0.5
# A text is rejected if its calibrated confidence is lower than this, or than all but one in a thousand of the
# calibration texts have, whichever is less.
REJECT, TAIL = 0.4, 0.001


def subwords(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, has a byte of a word by row) of every subword: byte n-grams inside words with a mark on either side."""
    symbol = LETTERS[data].astype(np.int64)
    inside = symbol > 0
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    letters = np.bincount(row[inside], minlength=len(bounds) - 1) > 0
    buckets, rows = [], []
    for n in LENGTHS:
        last = len(data) - n + 1
        if last <= 0:
            continue
        value = np.zeros(last, dtype=np.int64)
        some = np.zeros(last, dtype=bool)
        for k in range(n):
            value = value * 257 + symbol[k:last + k]
            some |= inside[k:last + k]
        # Marks stand for any other byte, at the ends only.
        for k in range(1, n - 1):
            some &= inside[k:last + k]
        some &= row[:last] == row[n - 1:]
        at = np.flatnonzero(some)
        buckets.append((mix(value[at].astype(np.uint64) + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        rows.append(row[at])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), letters
    return np.concatenate(buckets), np.concatenate(rows), letters


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


@dataclass
class Model:
    """Softmax weights of each bucket (its vector times the output layer), bias, temperature and rejection limit."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float = REJECT

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, has a letter) of each text."""
        lower = _lower(texts)
        data, bounds = raw(lower)
        bucket, row, _ = subwords(data, bounds)
        letters = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)
        n = len(texts)
        size = np.maximum(np.bincount(row, minlength=n), 1)
        scores = np.stack([np.bincount(row, weights=self.weights[bucket, k], minlength=n) for k in range(len(self.languages))], axis=1)
        return softmax((scores / size[:, None] + self.bias) / self.temperature), letters


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, limit=BYTES):
        data, bounds = raw(_lower(batch.column("text")))
        bucket, row, _ = subwords(data, bounds)
        key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(batch.num_rows + 1) * BUCKETS)
        ids = (key % BUCKETS).astype(np.uint16)
        shares = (count / np.maximum(np.bincount(row, minlength=batch.num_rows), 1)[key // BUCKETS]).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"),
             pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
             pa.array([shares[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
            ["doc_id", "lang", "ids", "shares"])


def _dense(ids: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(ids), BUCKETS), dtype=np.float32)
    for k, (i, s) in enumerate(zip(ids, shares, strict=True)):
        out[k, i] = s
    return out


def train(languages: list[str], label: np.ndarray, ids: list[np.ndarray], shares: list[np.ndarray], seed: int = 7) -> Model:
    """Stochastic gradient descent on the mean vector's softmax loss, languages weighted alike; then a temperature."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    vectors = rng.normal(0, 1 / np.sqrt(WIDTH), (BUCKETS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((WIDTH, n_lang), dtype=np.float32), np.zeros(n_lang, dtype=np.float32)
    held = np.arange(len(label)) % HOLD == HOLD - 1
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(label))
    weight = len(fit) / n_lang / np.maximum(np.bincount(label[fit], minlength=n_lang), 1)
    batches = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    steps, at = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), BATCH):
            part = order[k:k + BATCH]
            rate = RATE * (1 - at / steps)
            at += 1
            x = _dense([ids[i] for i in part], [shares[i] for i in part])
            mean = x @ vectors
            error = softmax(mean @ output + bias)
            error[np.arange(len(part)), label[part]] -= 1
            error *= (np.minimum(weight[label[part]], 10) / len(part))[:, None]
            back = error @ output.T
            output -= rate * (mean.T @ error) * 4
            bias -= rate * error.sum(axis=0)
            # A bucket's gradient is scaled by its share of a text, about 1 in 100, so vectors take larger steps.
            vectors -= rate * 20 * (x.T @ back)
    weights = vectors @ output
    check = np.flatnonzero(held) if held.any() else fit
    scores = np.concatenate([_dense([ids[i] for i in check[k:k + BATCH]], [shares[i] for i in check[k:k + BATCH]]) @ weights + bias
                             for k in range(0, len(check), BATCH)])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(softmax(scores / t)[np.arange(len(check)), label[check]] + 1e-9).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    tail = float(np.quantile(softmax(scores / temperature).max(axis=1), TAIL))
    return Model(languages, weights.astype(np.float64), bias.astype(np.float64), temperature, min(REJECT, tail))


def fit_model(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
              per_language: int = PER_LANGUAGE) -> Model:
    """Model from labelled documents: for each language the ``per_language`` first by hash of the id.

    Only bucket shares of the sampled documents, at most 96 kB each and usually
    a tenth, reach the driver. With no labelled text the model knows ``und``.
    """
    known = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    keys = known.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    chosen = top_k_per_key(keys, ["lang"], [F.xxhash64("doc_id"), "doc_id"], per_language).select("doc_id").distinct()
    rows = (known.where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen), "doc_id", "left_semi")
            .mapInArrow(_counts, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, lang string, ids binary, shares binary")
            .toPandas().sort_values("doc_id", ignore_index=True))
    if rows.empty:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    languages = sorted(rows["lang"].unique())
    label = rows["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy()
    return train(languages, label, [np.frombuffer(x, dtype=np.uint16) for x in rows["ids"]],
                 [np.frombuffer(x, dtype=np.float32) for x in rows["shares"]])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=BYTES):
            p, letters = model.probabilities(batch.column("text"))
            best, score = p.argmax(axis=1), p.max(axis=1)
            name = np.where(letters, np.array(model.languages, dtype=object)[best], "und")
            score = np.where(letters, score, 0.0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(name, pa.string()), pa.array(score), pa.array(~letters | (score < model.reject))],
                [*keep, "lang_pred", "score", "rejected"])

    return run


def predict_language(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, lang_pred, score and rejected of every row, from its whole text.

    The score is the calibrated probability of lang_pred. Null texts and texts
    without a letter are ``und`` with score 0 and rejected; so is, with its best
    language still named, a text whose score is under the model's limit. Letters are
    those of Unicode. Each repeated row has its own result; columns of other
    names are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_predict(model), f"doc_id {kind}, text_key long, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4,
             held_out: int = 2) -> DataFrame:
    """Predictions of all documents by a model fitted without the held-out fold; null ids are never learnt from."""
    model = fit_model(documents.where(fold(doc_id, folds) != held_out), doc_id, text, lang)
    return predict_language(documents, model, doc_id, text).withColumn(
        "held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)))
