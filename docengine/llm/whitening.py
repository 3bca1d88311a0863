"""Embedding whitening by LOBPCG: leading eigenvectors of the covariance from distributed products with blocks of directions.

The covariance is never formed. A pass over the rows gives its product with a block B: each task centres its rows, multiplies,
Y'(Y B), and hands on one small matrix; products are summed by row of the matrix. An iteration takes one such pass: residuals are made orthonormal to
the iterate and the previous directions, multiplied, and Rayleigh-Ritz on the span of the three gives the next iterate. Products of the
iterate and the directions follow by the same combinations. Residuals are then certified by a fresh product of the final
iterate; if combining has lost digits, iterations go on from there. A few directions more than asked for (`guard`) are iterated,
so that the last one asked for converges by its distance to what's beyond them.

Vectors are integers, floor(scale * c) + offset, so distinct vectors, counts and sums are exact, and rows are centred by an exactly
rounded mean before they are multiplied. The covariance is that of the distinct vectors, so copies, however many, weigh once; they collapse before the
shuffle. All that reaches the driver is as large as the dimensions, never as the rows.

Rows whose vector is null or empty, holds null or non-finite components, or has another length than most (of two that tie, the longer) are
dropped. Components whose variance is nothing but rounding (under 1e-12 of the largest) are not given: with fewer than two distinct vectors there
are none, and no rows. Repeated rows and ids are rows like others, null ids too. An empty table gives no rows. A deviation that is over a
long's range is null. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import finite_vectors, usual_length, written


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, *, guard: int = 8, tol: float = 1e-12, most_rounds: int = 200, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns, certified residual norms relative to the largest eigenvalue) of the k leading
    pairs of a symmetric positive semidefinite matrix that's known by its products with blocks."""
    m = min(dims, k + guard)
    k = min(k, m)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, m)))[0]
    vx = product(x)
    x, vx, theta = _ritz(x, vx, m)
    p = vp = np.zeros((dims, 0))
    certified = True  # whether vx is a product, not a combination of products
    rest, stalled = np.inf, 0
    for _ in range(most_rounds):
        scale = max(theta[0], np.finfo(float).tiny)
        residual = vx - x * theta
        norms = np.linalg.norm(residual, axis=0) / scale
        worst = float(norms[:k].max())
        w = np.zeros((dims, 0))
        if worst > tol:
            w = _fresh(residual[:, norms > tol / 10], np.hstack([x, p]))
        # no direction is left, or rounding stops the progress: what there is must be certified
        stalled = stalled + 1 if worst > rest / 2 else 0
        rest = min(rest, worst)
        if worst <= tol or not w.shape[1] or stalled > 12:
            if certified and (worst <= max(tol, 1e-10) or not w.shape[1]):
                return theta[:k], x[:, :k], norms[:k]
            x = np.linalg.qr(x)[0]
            vx, p, vp, certified, stalled = product(x), p[:, :0], vp[:, :0], True, 0
            x, vx, theta = _ritz(x, vx, m)
            continue
        s, vs = np.hstack([x, w, p]), np.hstack([vx, product(w), vp])
        gram = s.T @ vs
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        c = vectors[:, ::-1][:, :m]
        theta = values[::-1][:m]
        # the previous direction: what moved the iterate, made orthonormal to it in coefficients
        d = c.copy()
        d[:m] = 0
        d -= c @ (c.T @ d)
        d -= c @ (c.T @ d)
        u, sizes, _ = np.linalg.svd(d, full_matrices=False)
        d = u[:, sizes > 1e-8]
        x, vx, p, vp, certified = s @ c, vs @ c, s @ d, vs @ d, False
    raise RuntimeError(f"LOBPCG has not converged: residual {rest:.2g}")


def _ritz(x: np.ndarray, vx: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gram = x.T @ vx
    values, c = np.linalg.eigh((gram + gram.T) / 2)
    c = c[:, ::-1][:, :m]
    return x @ c, vx @ c, values[::-1][:m]


def _fresh(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what w adds to an orthonormal basis."""
    w = w / np.maximum(np.linalg.norm(w, axis=0), np.finfo(float).tiny)
    w = w - basis @ (basis.T @ w)
    u, sizes, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, sizes > 1e-7]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _block_sum(rows: DataFrame, dims: int, width: int, gathered: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of a matrix (dims, width) that `gathered` makes of a task's batches of x."""
    columns = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = gathered(_matrix(b.column(0), dims) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.shape[0], dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in out.T]], names=["i", *columns])

    partial = rows.select("x").mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in columns]]))
    found = partial.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # one row a dimension
    total = np.zeros((max([dims, *[r["i"] + 1 for r in found]]), width))
    for r in found:
        total[r["i"]] = r[1:]
    return total


@dataclass
class Whitening:
    """Components as columns, their eigenvalues, what they explain, and how far whitened vectors are from unit covariance."""

    n: int
    sums: list[int]
    offset: int
    components: np.ndarray
    eigenvalues: np.ndarray
    residuals: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        """Of x less the offset, each correctly rounded."""
        return np.array([(s - self.n * self.offset) / self.n for s in self.sums])

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def _deviations(a: np.ndarray, n: int, s: np.ndarray, most: int) -> list[int | None]:
    """Sums of (n a - s)^2, exact; None beyond 63 bits."""
    if a.shape[1] * (n * int(np.abs(a).max(initial=0)) + most) ** 2 < 1 << 63:
        return ((a * n - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((a.astype(object) * n - s) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, dims: int, *, k: int = 16, offset: int = 1_000_000, guard: int = 8, tol: float = 1e-12) -> Whitening | None:
    """rows (x array<long>) of one length; None if they have no variance."""
    listed = written(rows.select("x").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, dtype=np.int64), 0
        for b in batches:
            x = _matrix(b.column(0), dims)
            total, n = total + (x - offset).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total), pa.array(np.full(dims, n))], names=["i", "s", "n"])

    found = listed.mapInArrow(run, "i int, s long, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n = found[0]["n"] if found else 0
    if n < 2:
        return None
    model = Whitening(n, [int(r["s"]) + n * offset for r in found], offset, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    mean = model.mean

    def product(block: np.ndarray) -> np.ndarray:
        def gathered(batches: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(block.shape)
            for x in batches:
                y = (x - offset) - mean
                out += y.T @ (y @ block)
            return out

        return _block_sum(listed, dims, block.shape[1], gathered) / n

    trace = _trace(listed, dims, offset, mean) / n
    values, vectors, residuals = lobpcg(product, dims, k, guard=guard, tol=tol)
    keep = values > 1e-12 * values[0]
    if not keep.any() or values[0] <= 0:
        return None
    model.components, model.eigenvalues, model.residuals = vectors[:, keep], values[keep], residuals[keep]
    model.explained = model.eigenvalues / trace
    weights, width = model.weights, int(keep.sum())

    def spread(batches: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((width + 1, width))
        for x in batches:
            z = ((x - offset) - mean) @ weights
            out[:width] += z.T @ z
            out[width] += z.sum(axis=0)
        return out

    total = _block_sum(listed, dims, width, spread)[: width + 1] / n
    model.identity_error = float(np.abs(total[:width] - np.outer(total[width], total[width]) - np.eye(width)).max())
    return model


def _trace(listed: DataFrame, dims: int, offset: int, mean: np.ndarray) -> float:
    def gathered(batches: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((dims, 1))
        for x in batches:
            out[:, 0] += (((x - offset) - mean) ** 2).sum(axis=0)
        return out

    return float(_block_sum(listed, dims, 1, gathered).sum())


def whiten(vectors: DataFrame, *, k: int = 16, scale: int = 64, offset: int = 1_000_000, guard: int = 8, tol: float = 1e-12, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(vec_id, deviation, whitened array<double>) for each row that's kept, and the model."""
    whole = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")) + F.lit(offset).cast("long"))
    given = finite_vectors(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")), "x")
    table = written(given.withColumn("x", whole))
    dims = usual_length(table, "x")
    schema = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, deviation long, whitened array<double>"
    table = table.filter(F.size("x") == (dims or 0))
    model = fit(table, dims, k=k, offset=offset, guard=guard, tol=tol) if dims else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    mean, weights, n = model.mean, model.weights, model.n
    sums = np.array([s - n * offset for s in model.sums], dtype=object)
    most = int(max(abs(s) for s in sums.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = _matrix(b.column(1), dims) - offset
            z = (a - mean) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(a, n, sums, most), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return table.select("vec_id", "x").mapInArrow(run, schema), model
