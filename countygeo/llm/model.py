"""What the classifiers share: folds, bounded training samples and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``limit`` rows at most, the least by hash of ``key``: the same whatever the partitions."""
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a small dense logistic regression (last one: bias), by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x) or y.min() == y.max():
        w[-1] = 4.0 if len(y) and y.min() == 1 else -4.0
        return w
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) / len(x) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
