"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
# An entry c becomes the integer floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
# Entries beyond this have no integer of 64 bits and count as not finite.
LARGEST = 2.0 ** 56
# Vectors worked on at once in a task.
ROWS = 4096


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``a = L @ L.T``, its columns as many as the rank of ``a``.

    Rows stay in the order of ``a``; sorted by the order of the pivots L is lower
    triangular. The largest remaining diagonal entry is the next pivot, and the
    factor ends where that is nothing but rounding.
    """
    m = len(a)
    left = a.diagonal().copy()
    least = m * np.finfo(np.float64).eps * left.max(initial=0.0)
    factor = np.zeros((m, m))
    done = np.zeros(m, dtype=bool)
    for k in range(m):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if left[p] <= least:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[done] = 0.0
        column[p] = np.sqrt(left[p])
        factor[:, k] = column
        left -= column * column
        done[p] = True
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor @ Q`` for the rotation Q that makes its columns orthogonal.

    A round rotates half as many pairs of columns as there are columns, none
    twice; the rounds of a sweep pair each with each. It ends with the first
    sweep in which all pairs are orthogonal to working precision.
    """
    m, n = factor.shape
    odd = n % 2
    rows = np.vstack([factor.T, np.zeros((odd, m))])
    size = n + odd
    if size < 2:
        return factor.copy()
    seat = np.arange(size)
    tolerance = max(m, n) * np.finfo(np.float64).eps
    for _ in range(sweeps):
        still = True
        for _ in range(size - 1):
            p, q = seat[:size // 2], seat[size // 2:][::-1]
            x, y = rows[p], rows[q]
            xx, yy, xy = (np.einsum("ij,ij->i", *pair) for pair in ((x, x), (y, y), (x, y)))
            turn = np.abs(xy) > tolerance * np.sqrt(xx) * np.sqrt(yy)
            if turn.any():
                still = False
                p, q, x, y, xx, yy, xy = p[turn], q[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
                zeta = (yy - xx) / (2.0 * xy)
                tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = (1.0 / np.hypot(1.0, tan))[:, None]
                sin = cos * tan[:, None]
                rows[p], rows[q] = cos * x - sin * y, sin * x + cos * y
            seat = np.concatenate([seat[:1], np.roll(seat[1:], 1)])
        if still:
            break
    return rows[:n].T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from above, unit eigenvectors as columns) of a positive semidefinite matrix, without its null space."""
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    norm = np.linalg.norm(rotated, axis=0)
    order = np.argsort(-norm, kind="stable")
    order = order[norm[order] > 0]
    return norm[order] ** 2, rotated[:, order] / norm[order]


@dataclass(frozen=True)
class Whitening:
    """What a fit keeps: bounded by the square of the dimension, whatever the rows."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x - S/n in double precision, sum over dimensions of (n*x - S)^2 as objects, both from exact integers)."""
        nearest = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * r for s, r in zip(self.sums, nearest, strict=True)]
        near = x - np.array(nearest, dtype=np.int64)
        fits = float(self.n) ** 2 * (near.astype(np.float64) ** 2).sum(axis=1) < 2.0 ** 60
        fits &= float(self.n) ** 2 * self.dim < 2.0 ** 60
        whole = self.n * np.where(fits[:, None], near, 0) - np.array(rest, dtype=np.int64)
        deviation = (whole * whole).sum(axis=1).astype(object)
        z = whole / self.n
        for k in np.flatnonzero(~fits):
            exact = [self.n * int(v) - r for v, r in zip(near[k], rest, strict=True)]
            deviation[k] = sum(v * v for v in exact)
            z[k] = [v / self.n for v in exact]
        return z, deviation

    def project(self, z: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return (z @ self.components[:, :k]) / np.sqrt(self.values[:k])


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    value = F.col(embedding)
    good = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    return vectors.select(F.col(vec_id).alias("vec_id"), value.alias("embedding")).where(value.isNotNull() & good & (F.size(value) > 0))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(STEPS * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _integers(part.column("embedding"), dim)


def _totals(usable: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums of each dimension; a task sends one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for part, x in _parts(batches, dim):
            n += part.num_rows
            # Halves of 32 bits cannot overflow in a part, and objects hold any sum.
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([int(t) for t in total], pa.decimal128(38, 0)),
                                              pa.array(np.full(dim, n, dtype=np.int64))], ["place", "total", "n"])

    rows = (usable.select("embedding").mapInArrow(run, "place int, total decimal(38,0), n long")
            .groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("place").collect())
    return (rows[0]["n"] if rows else 0), tuple(int(r["total"]) for r in rows)


def _scatter(usable: DataFrame, dim: int, size: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of ``values`` of each row; a task sends one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        seen = False
        for _, x in _parts(batches, dim):
            z = values(x)
            total += z.T @ z
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size, dtype=np.int64)), pa.array(total.ravel())], ["cell", "total"])

    rows = usable.select("embedding").mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(size * size)
    for r in rows:
        out[r["cell"]] = r["total"]
    out = out.reshape(size, size)
    return (out + out.T) / 2


def _of_size(usable: DataFrame) -> tuple[DataFrame, int]:
    sizes = usable.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    return usable.where(F.size("embedding") == dim), dim


def fit_whitening(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Means, eigenvalues and components of all usable vectors, in three passes over them.

    The first pass takes exact integer sums, the second the scatter of the rows
    centred by them, the third the covariance of the whitened rows, whose
    distance from the identity is ``identity_error``. Tasks send one row for each
    dimension or cell. The scatter is factored by Cholesky with pivots, then
    Jacobi rotations act on the columns of the factor itself: their squared
    norms become the eigenvalues and the normalised columns the components.
    Directions without variance are left out.

    Null vectors, those with null or non-finite parts or parts beyond 2**56, and
    empty ones are left out. All others must have one size: those of another
    than the commonest (of equals the largest) are left out too. An empty table
    or equal vectors give no components. Equal eigenvalues have any orthogonal
    directions of their space, the same for all rows.
    """
    usable, dim = _of_size(_usable(vectors, vec_id, embedding))
    n, sums = _totals(usable, dim) if dim else (0, ())
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    plain = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    covariance = _scatter(usable, dim, dim, lambda x: plain.centred(x)[0]) / n
    values, directions = eigen(covariance)
    model = Whitening(n, sums, values, directions, float(np.trace(covariance)))
    k = min(components, len(values))
    if not k:
        return model
    white = _scatter(usable, dim, k, lambda x: model.project(model.centred(x)[0], k)) / n
    return Whitening(n, sums, values, directions, model.trace, float(np.abs(white - np.eye(k)).max()))


def whiten(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and the whitened vector of each usable row: uncorrelated parts of variance one.

    Rows that a fit would leave out, or of another size than the model's, are
    left out. ``deviation`` is the exact sum of (n*x - S)**2, null beyond 64
    bits. Repeated rows stay, a null id too; other columns are ignored.
    """
    usable = _usable(vectors, vec_id, embedding).where(F.size("embedding") == model.dim)
    kind = usable.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, model.dim):
            z, deviation = model.centred(x)
            white = model.project(z, components)
            offsets = pa.array(np.arange(part.num_rows + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"])

    return usable.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def by_component(whitened: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component, with the share of variance that the component explains."""
    share: Column = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values] or [F.lit(None).cast("double")]),
                                 F.col("__at") + 1)
    return whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("__at", "whitened")).select(
        "vec_id", (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
