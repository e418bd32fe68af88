"""Embedding whitening by spectral divide and conquer with QDWH polar decompositions.

The covariance of the distinct vectors is summed up in the tasks, so only d x d numbers reach the driver.  There the
polar factor of the covariance, shifted by the mean of its diagonal, is the matrix sign function; it gives
the projector on the eigenvectors above the shift, and the two invariant subspaces are split the same way until
each is a single direction.  The d x k whitening matrix then goes to the tasks with the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

EPS = np.finfo(float).eps
STEPS = 40  # QDWH needs about six; only a shift on an eigenvalue takes more


def polar_sign(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations.

    A step is a QR factorisation while the weight is large and a Cholesky factorisation afterwards.
    """
    n = len(a)
    x = a / np.linalg.norm(a, 2)
    low, eye = EPS, np.eye(n)  # a lower bound of the singular values; too small a bound costs steps only
    for _ in range(STEPS):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            chol = np.linalg.cholesky(eye + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(chol.T, np.linalg.solve(chol, x.T)).T
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * EPS and moved < np.sqrt(n) * EPS ** (1 / 3):
            break
    return x


def _range(projector: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Orthonormal basis of a projector's range of dimension k."""
    q = np.random.default_rng(seed).standard_normal((len(projector), k))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A block whose deviation from a multiple of the identity is rounding has equal eigenvalues and any basis.
    """
    scale = np.linalg.norm(a)

    def split(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(block)
        shift = np.trace(block) / n
        rest = block - shift * np.eye(n)
        if n == 1 or np.linalg.norm(rest) <= 4 * EPS * scale:
            return np.diag(block).copy(), np.eye(n)
        spread = np.linalg.norm(rest, 2)
        # the mean eigenvalue always has some on both sides; a shift that meets one is moved on
        for move in (0.0, 1e-3, -1e-3, 7e-3, -7e-3, 3e-2, -3e-2):
            sign = polar_sign(rest - move * spread * np.eye(n))
            k = int(round((np.trace(sign) + n) / 2))
            if 0 < k < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-8 * n:
                break
        else:  # eigenvalues that no shift parts: equal but for rounding
            return np.diag(block).copy(), np.eye(n)
        up, down = _range((np.eye(n) + sign) / 2, k, n), _range((np.eye(n) - sign) / 2, n - k, n + 1)
        down, _ = np.linalg.qr(down - up @ (up.T @ down))
        values, vectors = [], []
        for basis in (up, down):
            part = basis.T @ block @ basis
            e, v = split((part + part.T) / 2)
            values.append(e)
            vectors.append(basis @ v)
        return np.concatenate(values), np.hstack(vectors)

    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = split((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    at = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.sign(vectors[at, np.arange(len(a))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def integers(vector: Column) -> Column:
    """floor(256 c) of every entry; null for a vector that is null, empty or holds null or non-finite entries."""
    c = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad & (F.size(c) > 0), F.transform(c, lambda v: F.floor(v * 256).cast("long")))


@dataclass
class Whitening:
    n: int
    sums: list[int]  # per dimension over the fit list
    values: np.ndarray  # of the kept components, falling
    vectors: np.ndarray  # d x k
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance gives 0."""
        e = np.where(self.values > 0, self.values, np.inf)
        return (x - self.mean) @ (self.vectors / np.sqrt(e))


def _summed(fit: DataFrame, width: int, of) -> np.ndarray:
    """Sum over the fit list of ``of(x)``, a small matrix: one per task, added up by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = of(_matrix(b.column(0), width).astype(float))
                total = got if total is None else total + got
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d x d at most
    out = np.zeros((max((r["i"] for r in cells), default=-1) + 1, max((r["j"] for r in cells), default=-1) + 1))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening | None:
    """Whitening of a table of distinct vectors ``x`` (array of long, ``width`` entries); None without rows."""
    exact = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).first()
    n = exact["n"]
    if not n:
        return None
    sums = [int(exact[f"s{i}"]) for i in range(width)]
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return x.T @ x

    cov = _summed(fit, width, products) / n
    values, vectors = eigen(cov)
    k = min(components, width)
    w = Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(cov)))

    def whitened(x: np.ndarray) -> np.ndarray:
        z = np.column_stack((w.apply(x), np.ones(len(x))))
        return z.T @ z

    z = _summed(fit, width, whitened) / n
    centre = z[:k, k]
    w.identity_error = float(np.abs(z[:k, :k] - np.outer(centre, centre) - np.eye(k)).max())
    return w


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty or hold null or non-finite entries have no rows, nor have vectors of another length
    than the most common one (of equally common lengths the greater).  Rows that repeat are all returned and are
    one vector of the fit.  ``deviation`` is null where it exceeds a long, ``explained`` where nothing varies; a
    component without variance has ``whitened`` 0.  No vectors give no rows; other columns are not read.
    """
    x = vectors.select(F.col(id_col), integers(F.col(vector_col)).alias("x")).filter("x is not null")
    numbers = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    schema = vectors.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in numbers.items()]).schema
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    width = lengths[0]["d"]
    x = x.filter(F.size("x") == width)
    fit = x.select("x").distinct().persist()  # equal vectors meet in the tasks before the shuffle
    try:
        w = fit_whitening(fit, width, components)
    finally:
        fit.unpersist()
    k = len(w.values)
    explained = w.values / w.trace if w.trace > 0 else None
    sums = np.array(w.sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = _matrix(b.column(1), width)
            most = w.n * int(np.abs(rows).max()) + max(abs(s) for s in w.sums)
            if width * most**2 < 1 << 63:
                deviation = ((w.n * rows - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = ((w.n * rows.astype(object) - sums) ** 2).sum(axis=1).tolist()
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n)),
                pa.array([d if d < 1 << 63 else None for d in deviation for _ in range(k)], pa.int64()),
                pa.array(w.apply(rows.astype(float)).ravel()),
                pa.array([None] * (m * k), pa.float64()) if explained is None else pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, w.identity_error)),
            ], names=schema.names)

    return x.mapInArrow(run, schema)
