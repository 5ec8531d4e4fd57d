"""Whitening of embeddings by LOBPCG, whose products with the covariance are distributed.

The driver holds blocks of a few vectors as long as an embedding is wide, never the covariance and never rows. In each
iteration the tasks centre their rows and multiply the covariance with a block of directions: ``(1/n) sum y (y' B)``; Spark
sums the parts by dimension. Rayleigh-Ritz on the iterates, their residuals and the previous directions gives the next
iterates. It ends when a product of its own certifies each wanted pair: the norm of ``V u - e u`` is at most ``TOLERANCE`` of the highest
eigenvalue, or at most ``ACCEPTED`` where rounding lets it fall no further. Otherwise it fails and says so.

Entries become integers, ``floor(64 c) + 1000000``. Their sums are exact, and rows are centred in integers (``n x - S``) before
anything is multiplied, so the offset costs no digits. Entries beyond 2**53 count as 2**53.

Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those that are not as long as most (ties:
the longer). Rows that repeat count each and keep their own rows; a null ``vec_id`` stays null. Components whose variance is
below ``NEGLIGIBLE`` of the highest can't be whitened and are left out; so equal vectors, or a single one, give no rows. A deviation beyond a
long is null. The result of an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, CAP = 64, 1_000_000, 2**53
#: Components that are returned, directions that are iterated beside them, and rows of one product.
COMPONENTS, GUARD, ROWS = 32, 8, 4_096
#: Residuals as parts of the highest eigenvalue, iterations at most, and the least variance as a part of the highest.
TOLERANCE, ACCEPTED, ITERATIONS, NEGLIGIBLE = 1e-14, 1e-11, 300, 1e-11
LONG = 2**63 - 1

Product = Callable[[np.ndarray], np.ndarray]


class NotConverged(ArithmeticError):
    """The residuals could not be certified."""


def integers(df: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.greatest(F.lit(-CAP), F.least(F.lit(CAP), F.floor(F.greatest(F.lit(-2.0**56), F.least(F.lit(2.0**56), c * SCALE))) + OFFSET)))
    return df.where(F.size("embedding") > 0).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact: 64-bit integers where these suffice, else Python's."""
    most = float(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < 2.0**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, null beyond a long."""
    if d.dtype != object and float(np.abs(d.astype(float)).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [v if v <= LONG else None for v in exact.tolist()]


def parts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            yield b.slice(s, ROWS)


class Fit:
    """Number, sums and covariance products of the vectors that take part."""

    def __init__(self, rows: DataFrame) -> None:
        sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        self.d, self.n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
        self.rows = rows.where(F.size("x") == self.d)
        self.sums = self._sums() if self.n else []
        self.trace = 0.0

    def _sums(self) -> list[int]:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d, object)
            for b in parts(batches):
                x = matrix(b.column(0))
                total = total + (x.sum(axis=0) if float(np.abs(x).max(initial=0)) * len(x) < 2.0**62 else x.astype(object).sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

        found = self.rows.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
        return [int(r.s) for r in sorted(found, key=lambda r: r.i)]

    def _summed(self, of: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
        """The sum over all rows of a matrix that ``of`` gives for a block of centred ones; Spark adds the tasks' parts, row by row of the matrix."""
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for b in parts(batches):
                total += of((centred(matrix(b.column(0)), n, sums) / n).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

        made = self.rows.select("x").mapInArrow(run, "i int, v array<double>")
        added = made.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(width)])
        out = np.zeros((height, width))
        for r in added.collect():
            out[r[0]] = r[1:]
        return out

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns."""
        if not block.shape[1]:
            return block
        return self._summed(lambda y: y.T @ (y @ block), self.d, block.shape[1]) / self.n

    def moments(self, turned: np.ndarray) -> tuple[float, np.ndarray]:
        """The covariance's trace, and the covariance of the rows turned by ``turned``, centred by their own means."""
        k = turned.shape[1]

        def of(y: np.ndarray) -> np.ndarray:
            w = y @ turned
            out = np.zeros((k + 1, k + 1))
            out[:k, :k], out[k, :k], out[k, k] = w.T @ w, w.sum(axis=0), (y * y).sum()
            return out

        m = self._summed(of, k + 1, k + 1) / self.n
        return float(m[k, k]), m[:k, :k] - np.outer(m[k, :k], m[k, :k])


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the block's columns add to the orthonormal columns of ``against``; dependent ones go."""
    norms = np.linalg.norm(block, axis=0)
    out = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        out = out - against @ (against.T @ out)
        if not out.shape[1]:
            break
        u, s, _ = np.linalg.svd(out, full_matrices=False)
        out = u[:, s > 1e-8 * max(s[0], 1e-300)] if s[0] > 1e-12 else out[:, :0]
    return out


def lobpcg(product: Product, d: int, k: int, tolerance: float = TOLERANCE, accepted: float = ACCEPTED, iterations: int = ITERATIONS, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest eigenvalues of a symmetric matrix, their unit vectors and certified residuals (parts of the highest).

    The matrix is only ever multiplied with a block.
    """
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(5).standard_normal((d, m)))[0]
    p, best, still = x[:, :0], np.inf, 0
    for _ in range(iterations):
        ax = product(x)  # anew in each iteration: what certifies a pair is no combination of older products
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        top = max(values[0], 0.0)
        parts_ = np.linalg.norm(residual, axis=0)[:k] / top if top else np.zeros(k)
        worst = parts_.max(initial=0.0)
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        if worst <= tolerance or (worst <= accepted and still >= 3):
            return values[:k], x[:, :k], parts_
        w = orthonormal(np.hstack((residual, p)), x)
        if not w.shape[1]:  # no direction is left: the iterates span all that the matrix reaches from them
            if worst <= accepted:
                return values[:k], x[:, :k], parts_
            break
        aw = product(w)
        basis, images = np.hstack((x, w)), np.hstack((ax, aw))
        gram = basis.T @ images
        turn = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :m]
        p = w @ turn[m:]
        x = np.linalg.qr(basis @ turn)[0]
    raise NotConverged(f"residuals of {best:.1e} of the highest eigenvalue after {iterations} iterations; {accepted:.0e} is asked")


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(df: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual) of each row and component.

    ``residual`` is the certified norm of ``V u - e u`` as a part of the highest eigenvalue.
    """
    fit = Fit(integers(df))
    values = np.zeros(0)
    if fit.n:
        values, vectors, residuals = lobpcg(fit.product, fit.d, min(components, fit.d), tolerance)
        there = values > NEGLIGIBLE * max(values[0], 0.0)
        values, residuals = values[there], residuals[there]
    if not len(values):
        return df.sparkSession.createDataFrame([], OUT)
    turned = vectors[:, there] / np.sqrt(values)
    trace, covariance = fit.moments(turned)
    error = float(np.abs(covariance - np.eye(len(values))).max())
    n, sums, k = fit.n, fit.sums, len(values)
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            d = centred(matrix(b.column(1)), n, sums)
            rows = len(d)
            deviation = pa.array(deviations(d), pa.int64())
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    deviation.take(each),
                    pa.array(((d / n).astype(float) @ turned).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array(np.tile(residuals, rows)),
                ],
                OUT.replace(",", "").split()[::2],
            )

    return fit.rows.mapInArrow(run, OUT)
