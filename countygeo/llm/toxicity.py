"""Toxic spans and document scores from a linear-chain conditional random field (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countygeo.llm.model import fold, logistic_fit, sample, sigmoid
from countygeo.llm.text import LETTERS, blocks, byte_sums, code_points, mix, raw, spans_hash, words
from countygeo.runtime import broadcast_if_small, checkpoint

# Labelled documents that the field is fitted on at most, and those of label 1 among them at least, if there are.
SAMPLE, SAMPLE_TOXIC = 4_000, 1_500
# Besides a whole word, its first bytes in these numbers are features, for stems with many endings.
PREFIXES = (3, 4, 5, 6, 7, 8)
# A feature marks toxic tokens if it is in LEAST toxic families of documents or more and in PART of those of the commonest
# such feature, its surplus is this SURE (likelihood ratio), and a share PURE of the documents with it is toxic.
LEAST, PART, SURE, PURE = 4, 0.05, 25.0, 0.9
# Features of toxic documents, the commonest first, that are looked for in the others.
CANDIDATES = 200_000
# Optimiser steps, learning rate, ridge; weights under PRUNE are dropped.
STEPS, RATE, RIDGE, PRUNE = 80, 0.2, 1e-4, 0.05
# Tokens with a marginal under FLOOR say nothing about a document, however many there are; tokens from SPAN on are
# part of a span; documents from LIMIT on get label 1.
FLOOR, SPAN, LIMIT = 0.1, 0.5, 0.3


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def sentences(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(hash, start, end, row of each token; first token and size of each sentence; bytes, row offsets).

    Tokens are runs of letters in lower case. A sentence ends at . ! ? or a line end.
    """
    data, bounds = raw(_lower(batch.column("text")))
    hashed, start, end, row = words(data, bounds, LETTERS)
    stop = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(np.isin(data, np.frombuffer(b".!?\n", dtype=np.uint8)), out=stop[1:])
    first = np.ones(len(start), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (stop[start[1:]] != stop[end[:-1]])
    begin = np.flatnonzero(first)
    return hashed, start, end, row, begin, np.diff(np.append(begin, len(start))), data, bounds


def token_features(data: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Feature hashes of each token, a row each: the word and its prefixes, 0 where the word is no longer than the prefix."""
    total = byte_sums(data, LETTERS)
    out = np.zeros((len(hashed), 1 + len(PREFIXES)), dtype=np.uint64)
    out[:, 0] = hashed
    for k, n in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(end - start > n)
        out[longer, k] = mix(spans_hash(total, start[longer], start[longer] + n) + np.uint64(n))
    return out


class Sieve:
    """Sorted hashes with a quick test that rules most others out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat positions of values that are members, their numbers)."""
        flat = values.ravel()
        at = np.flatnonzero(self.bits[flat >> np.uint64(44)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.hashes, flat[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == flat[at]
        return at[same], slot[same]


def families(hashed: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Family of each of n texts: the least hash of four words in a row, alike in most copies, or with fewer words of all."""
    count = np.bincount(row, minlength=n)
    gram = hashed[:max(0, len(hashed) - 3)].copy()
    for k in (1, 2, 3):
        gram = mix(gram * np.uint64(3) + hashed[k:len(gram) + k])
    family = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    whole = row[:len(gram)] == row[3:] if len(gram) else np.zeros(0, dtype=bool)
    np.minimum.at(family, row[:len(gram)][whole], gram[whole])
    first = np.cumsum(count) - count
    family[count < 4] = mix(count[count < 4].astype(np.uint64))
    for k in range(3):
        at = np.flatnonzero((count > k) & (count < 4))
        family[at] = mix(family[at] * np.uint64(3) + hashed[first[at] + k])
    return family


def _families(sieve: Sieve | None = None, bits: int = 0):
    """Distinct (feature, family) of each block, with feature 0 once a family.

    With a sieve only its features count; of the families those whose first
    ``bits`` hash bits are 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashed, start, end, row, _, _, data, _ = sentences(batch)
            family = families(hashed, row, batch.num_rows)
            value = token_features(data, hashed, start, end)
            at = np.flatnonzero(value.ravel()) if sieve is None else sieve.find(value)[0]
            pair = np.stack([np.append(value.ravel()[at], np.zeros(len(family), dtype=np.uint64)),
                             np.append(family[row[at // value.shape[1]]], family)])
            if bits:
                pair = pair[:, mix(pair[1]) >> np.uint64(64 - bits) == 0]
            pair = np.unique(pair, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["feature", "family"])

    return run


def _family_counts(texts: DataFrame, *args) -> DataFrame:
    return texts.mapInArrow(_families(*args), "feature long, family long").distinct().groupBy("feature").agg(F.count("*").alias("n"))


def toxic_features(marked: DataFrame) -> np.ndarray:
    """Hashes of the words and prefixes that label tokens as toxic, from counts over all labelled documents.

    Documents of either label are counted by families, so that copies of one
    neither make its words look toxic nor clear them. Features that the clean
    families of a sixteenth rule out alone are not counted in the others.
    """
    toxic, clean = marked.where("label = 1").select("text"), marked.where("label = 0").select("text")
    rows = (_family_counts(toxic).where(f"n >= {LEAST} OR feature = 0")
            .orderBy(F.col("feature") != 0, F.desc("n"), "feature").limit(CANDIDATES + 1).toPandas())
    n1, rows = rows.loc[rows["feature"] == 0, "n"].sum(), rows[rows["feature"] != 0]
    if rows.empty:
        return np.zeros(0, dtype=np.uint64)

    def clean_counts(features: pd.Series, *args) -> pd.Series:
        found = _family_counts(clean, Sieve(features.to_numpy().view(np.uint64)), *args).toPandas()
        return found.set_index("feature")["n"]

    some = clean_counts(rows["feature"], 4).reindex(rows["feature"], fill_value=0).to_numpy()
    rows = rows[rows["n"].to_numpy() >= PURE * (rows["n"].to_numpy() + some)]
    found = clean_counts(rows["feature"])
    n0 = found.get(0, 0)
    if rows.empty or not n0:
        return np.zeros(0, dtype=np.uint64)
    feature, t = rows["feature"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
    c = found.reindex(rows["feature"], fill_value=0).to_numpy().astype(float)
    share = n1 / (n1 + n0)
    n = t + c
    sure = 2 * (t * np.log(t / (n * share)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / (n * (1 - share))), 0))
    good = (sure >= SURE) & (t >= PURE * n)
    good &= t >= PART * t[good].max(initial=0)
    return np.sort(feature[good])


def _steps(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences by falling size, and how many have a token at each step."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), side="right")


def marginals(emission: np.ndarray, begin: np.ndarray, size: np.ndarray, start: np.ndarray,
              move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(toxic) of each token, summed pair marginals, log partition) by forward-backward over all sentences at once.

    ``emission`` is the score of the toxic tag over the clean one, ``start`` and
    ``move`` are scores of first tags and of tag pairs.
    """
    order, alive = _steps(size)
    begin, size = begin[order], size[order]
    trans = np.exp(move)
    forward = np.zeros((len(emission), 2))
    local = np.stack([np.zeros(len(emission)), emission], axis=1)
    shift = local.max(axis=1)
    local = np.exp(local - shift[:, None])
    log_z = float(shift.sum())
    scale = np.ones(len(emission))
    for t, n in enumerate(alive):
        at = begin[:n] + t
        now = local[at] * (np.exp(start) if t == 0 else forward[at - 1] @ trans)
        scale[at] = now.sum(axis=1)
        forward[at] = now / scale[at, None]
    log_z += float(np.log(scale).sum())
    backward = np.ones((len(emission), 2))
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = begin[:alive[t]] + t
        ahead = local[at] * backward[at] / scale[at, None]
        backward[at - 1] = ahead @ trans.T
        pairs += (forward[at - 1].T @ ahead) * trans
    tag = forward * backward
    return tag[:, 1] / tag.sum(axis=1), pairs, log_z


@dataclass
class Model:
    """Emission scores by feature, score of any token, start and transition scores, calibration of the document score."""

    features: Sieve
    weight: np.ndarray
    other: float
    start: np.ndarray
    move: np.ndarray
    calibration: np.ndarray

    def tag(self, features: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, slot = self.features.find(features)
        emission = self.other + np.bincount(at // features.shape[1], weights=self.weight[slot], minlength=len(features))
        return marginals(emission, begin, size, self.start, self.move)[0]


def evidence(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Features of documents: log-odds that any token is toxic, and the logarithm of the expected toxic tokens."""
    p = np.where(p < FLOOR, 0.0, p)
    none = np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    any_ = np.clip(-np.expm1(none), 1e-12, 1 - 1e-12)
    return np.stack([np.clip(np.log(any_ / (1 - any_)), -10, 10), np.log1p(np.bincount(row, weights=p, minlength=n))], axis=1)


def train_field(features: np.ndarray, begin: np.ndarray, size: np.ndarray, tag: np.ndarray) -> Model:
    """Maximum conditional likelihood with a ridge, by Adam; weights of features near zero are dropped."""
    vocabulary, code = np.unique(features, return_inverse=True)
    code = code.reshape(features.shape)
    theta = np.zeros(len(vocabulary) + 7)
    absent = np.flatnonzero(vocabulary == 0)
    gold = np.zeros(len(theta))
    gold[:len(vocabulary)] = np.bincount(code[tag].ravel(), minlength=len(vocabulary))
    gold[-7] = tag.sum()
    heads = tag[begin].astype(int)
    gold[-6:-4] = np.bincount(heads, minlength=2)
    later = np.ones(len(tag), dtype=bool)
    later[begin] = False
    at = np.flatnonzero(later)
    np.add.at(gold[-4:], 2 * tag[at - 1].astype(int) + tag[at].astype(int), 1)
    m = v = np.zeros(len(theta))
    for k in range(1, STEPS + 1):
        emission = theta[code].sum(axis=1) + theta[-7]
        p, pairs, _ = marginals(emission, begin, size, theta[-6:-4], theta[-4:].reshape(2, 2))
        model = np.zeros(len(theta))
        model[:len(vocabulary)] = np.bincount(code.ravel(), weights=np.repeat(p, code.shape[1]), minlength=len(vocabulary))
        model[-7] = p.sum()
        model[-5] = p[begin].sum()
        model[-6] = len(begin) - model[-5]
        model[-4:] = pairs.ravel()
        gradient = (gold - model) / max(len(begin), 1) - RIDGE * theta
        gradient[absent] = 0
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    weight = theta[:-7]
    keep = np.abs(weight) >= PRUNE
    return Model(Sieve(vocabulary[keep]), weight[keep], float(theta[-7]), theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy(), np.zeros(3))


def _tokens(lexicon: Sieve):
    """Sentences with a toxic token whole, and of the others every one whose hash falls in a sixteenth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashed, start, end, row, begin, size, data, _ = sentences(batch)
            value = token_features(data, hashed, start, end)
            tag = np.zeros(len(hashed), dtype=bool)
            tag[lexicon.find(value)[0] // value.shape[1]] = True
            if len(begin):
                toxic = np.add.reduceat(tag, begin) > 0
                pick = toxic | (mix(hashed[begin] + size.astype(np.uint64)) >> np.uint64(60) == 0)
            else:
                pick = np.zeros(0, dtype=bool)
            owner = row[begin]
            for k in range(batch.num_rows):
                chosen = np.flatnonzero(pick & (owner == k)) if pick.any() else pick.nonzero()[0]
                token = np.concatenate([np.arange(begin[j], begin[j] + size[j]) for j in chosen]) if len(chosen) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(k, 1), pa.array([value[token].tobytes()], pa.binary()),
                     pa.array([size[chosen].tobytes()], pa.binary()), pa.array([tag[token].tobytes()], pa.binary())],
                    ["doc_id", "features", "sizes", "tags"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashed, start, end, row, begin, size, data, _ = sentences(batch)
            e = evidence(model.tag(token_features(data, hashed, start, end), begin, size), row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(e[:, 0]), pa.array(e[:, 1])], ["label", "a", "b"])

    return run


def fit_model(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from labelled documents.

    Word counts cover all of them; the field and the calibration are fitted on
    SAMPLE documents, the first by hash of the id, among them SAMPLE_TOXIC of
    label 1 if there are that many.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    # Read three times below; written once, so that texts are shuffled once at most.
    known = checkpoint(docs.join(broadcast_if_small(marked), "doc_id"))
    lexicon = Sieve(toxic_features(known.select("text", "label")))
    chosen = sample(marked.where("label = 1"), "doc_id", SAMPLE_TOXIC).unionAll(
        sample(marked.where("label = 0"), "doc_id", SAMPLE - SAMPLE_TOXIC))
    fitted = checkpoint(known.drop("label").join(F.broadcast(chosen), "doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (fitted.select("doc_id", "text").mapInArrow(_tokens(lexicon), f"doc_id {kind}, features binary, sizes binary, tags binary")
            .toPandas().sort_values("doc_id", ignore_index=True))
    size = np.frombuffer(b"".join(rows["sizes"]), dtype=np.int64)
    features = np.frombuffer(b"".join(rows["features"]), dtype=np.uint64).reshape(-1, 1 + len(PREFIXES))
    tag = np.frombuffer(b"".join(rows["tags"]), dtype=bool)
    model = train_field(features, np.cumsum(size) - size, size, tag)
    seen = fitted.select("label", "text").mapInArrow(_evidence(model), "label int, a double, b double").toPandas()
    share = marked.agg(F.avg("label")).first()[0] or 0.0
    model.calibration = calibrate(seen[["a", "b"]].to_numpy(), seen["label"].to_numpy(), share)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic weights; the bias is moved from the sample's share of label 1 to that of all labels."""
    w = logistic_fit(x, y)
    own = y.mean() if len(y) else 0.0
    if 0 < own < 1 and 0 < share < 1:
        w[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return w


def _score(model: Model):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            n = batch.num_rows
            hashed, start, end, row, begin, size, data, bounds = sentences(batch)
            p = model.tag(token_features(data, hashed, start, end), begin, size)
            score = sigmoid(np.hstack([evidence(p, row, n), np.ones((n, 1))]) @ model.calibration)
            bad = p >= SPAN
            joined = np.zeros(len(p), dtype=bool)  # toxic like the token before, in the same sentence
            joined[1:] = bad[1:] & bad[:-1]
            joined[begin] = False
            first = np.flatnonzero(bad & ~joined)
            last = np.flatnonzero(bad & ~np.append(joined[1:], False))
            owner = row[first]
            spans = pa.StructArray.from_arrays([pa.array(code_points(data, bounds, owner, start[first])),
                                                pa.array(code_points(data, bounds, owner, end[last]))], fields=list(span))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.ListArray.from_arrays(offsets, spans)],
                                             ["doc_id", "score", "toxic_spans"])

    return run


def score_toxicity(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """doc_id, score, predicted and toxic_spans (code points, end exclusive) of every row, from its whole text.

    Null and empty texts have no tokens: their score is that of a text without
    any sign of toxicity. Each repeated row has its own result; columns of other
    names are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.mapInArrow(_score(model), f"doc_id {kind}, score double, toxic_spans array<struct<start:bigint,end:bigint>>")
            .withColumn("predicted", (F.col("score") >= limit).cast("int")))


def grade(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 4, held_out: int = 2) -> DataFrame:
    """Scores of all documents by a model that never saw labels of the held-out fold."""
    model = fit_model(documents, labels.where(fold(doc_id, folds) != held_out), doc_id, text, label)
    return score_toxicity(documents, model, doc_id, text).withColumn(
        "held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)))
