"""Row-local array helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may inline a projected column into a lambda, which would then
    evaluate it for every array element; a one-element transform prevents that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_total(array: Column) -> Column:
    """Sum of a double array."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def normalize(array: Column) -> Column:
    """Array divided by its sum."""
    return bind(array, lambda a: bind(array_total(a), lambda s: F.transform(a, lambda v: v / s)))


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum (WIN8)."""
    return bind(scores, lambda x: bind(F.array_max(x), lambda m: normalize(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(scores: Column) -> Column:
    """x - max - ln(sum(exp(x - max)))."""
    def shifted(x: Column) -> Column:
        return bind(F.array_max(x), lambda m: bind(
            F.ln(array_total(F.transform(x, lambda v: F.exp(v - m)))) + m,
            lambda lse: F.transform(x, lambda v: v - lse)))

    return bind(scores, shifted)


def mean_of(array: Column) -> Column:
    """Mean of a double array."""
    return array_total(array) / F.size(array)


def expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + size), one range after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)
