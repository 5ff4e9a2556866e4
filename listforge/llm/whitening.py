"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The centred scatter of the distinct integer vectors is summed in blocks, one small matrix a
task.  Pivoted Cholesky writes it as L L', with the rows of L in pivot order; rotating the
columns of L until they are orthogonal (one-sided Jacobi, no matrix is formed) leaves columns
whose squared norms are the eigenvalues and whose directions are the components.  Only the
d x d scatter and the components ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import matrix_of, summed
from listforge.session import materialize, ship_package

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
_FITS = 1 << 62


def pivoted_cholesky(a: np.ndarray, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L' and falling pivots; L has a's rank in columns."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    order, lower = np.arange(d), np.zeros((d, d))
    rest = a.diagonal().copy()
    least = tol * max(float(rest.max(initial=0.0)), 0.0) * d
    for j in range(d):
        p = j + int(rest[order[j:]].argmax())
        if rest[order[p]] <= least:
            return lower[:, :j], order
        order[[j, p]] = order[[p, j]]
        lower[[j, p], :j] = lower[[p, j], :j]
        at, below = order[j], order[j + 1:]
        lower[j, j] = np.sqrt(rest[at])
        lower[j + 1:, j] = (a[below, at] - lower[j + 1:, :j] @ lower[j, :j]) / lower[j, j]
        rest[below] -= lower[j + 1:, j] ** 2
    return lower, order


def orthogonal_columns(factor: np.ndarray, tol: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until every pair is orthogonal to ``tol`` of their norms."""
    u = np.array(factor, dtype=np.float64)
    n = u.shape[1]
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x, y = u[:, p], u[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= tol * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2.0 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1.0 / np.hypot(1.0, t)
                u[:, p], u[:, q] = c * (x - t * y), c * (y + t * x)
        if not turned:
            break
    return u


def eigen_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit components as rows) of a positive semidefinite matrix.

    As many as its numerical rank.  The entry of largest size in a component is positive.
    """
    lower, order = pivoted_cholesky(scatter)
    u = np.zeros_like(lower)
    u[order] = orthogonal_columns(lower)
    values = (u * u).sum(axis=0)
    at = np.argsort(-values, kind="stable")
    parts = (u[:, at] / np.sqrt(values[at])).T
    for row in parts:
        row *= np.sign(row[np.abs(row).argmax()])
    return values[at], parts


@dataclass
class Whitening:
    """``n`` distinct vectors, their exact sums, the eigenvalues kept, components as rows,
    the trace of the covariance and the error of the whitened covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """((id, x array<long>), dimensions): floor(64 c) + 1000000 of every usable row.

    Null vectors and those with null or non-finite entries are left out, and so are empty ones
    and vectors of another length than the commonest (ties: the longest), which have no place
    in one covariance.
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = top["n"] if top else 0
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT))
    return rows.where(F.size("v") == dims).select("id", x.alias("x")), dims


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of column ``x`` (array<long> of ``dims`` entries).

    Repeated vectors count once.  As many components as the covariance has rank, ``components``
    at most; no vectors, or equal ones only, have none.  Entries so large that n times an entry
    leaves 62 bits are refused with ValueError, since no exact deviation exists for them.
    """
    ship_package(vectors.sparkSession)
    distinct = materialize(vectors.select("x").distinct(), "whitening-fit")
    span = distinct.select(F.count(F.lit(1)).alias("n"), F.max(F.array_max("x")).alias("hi"),
                           F.min(F.array_min("x")).alias("lo")).first()
    n = span["n"]
    if not n:
        return Whitening(0, [0] * dims, np.zeros(0), np.zeros((0, dims)), 0.0, 0.0)
    if n * max(abs(span["hi"]), abs(span["lo"])) >= _FITS:
        raise ValueError("embedding entries are too large for exact sums")
    sums = [s for s, _ in summed(distinct, lambda b: matrix_of(b.column(0), dims).sum(axis=0), dims)]

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (matrix_of(batch.column(0), dims) * n - np.array(sums)) / n

    def gram(z: np.ndarray) -> np.ndarray:
        return (z.T @ z).ravel()

    scatter = np.array([r for _, r in summed(distinct, lambda b: gram(centred(b)), dims * dims)]).reshape(dims, dims)
    scatter = (scatter + scatter.T) / 2
    values, parts = eigen_of(scatter)
    values, parts = values[:components] / n, parts[:components]
    k, error = len(values), 0.0
    if k:
        to_white = parts.T / np.sqrt(values)
        cov = np.array([r for _, r in summed(distinct, lambda b: gram(centred(b) @ to_white), k * k)]) / n
        error = float(np.abs(cov.reshape(k, k) - np.eye(k)).max())
    return Whitening(n, sums, values, parts, float(np.trace(scatter)) / n, error)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per input row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error, deviation_exact.

    ``deviation_exact`` is a decimal and always exact; ``deviation`` is the same as a long, null
    where it does not fit (from about 50 million distinct vectors of unit length on).
    """
    ship_package(vectors.sparkSession)
    dims, k, n, sums = len(model.sums), len(model.values), model.n, np.array(model.sums, dtype=np.int64)
    to_white = model.components.T / np.sqrt(model.values)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.string()), ("white", pa.list_(pa.float64()))])

    def task(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            z = matrix_of(batch.column(1), dims) * n - sums
            small = int(np.abs(z).max(initial=0)) ** 2 * dims < _FITS
            total = ((z if small else z.astype(object)) ** 2).sum(axis=1)
            white = (z / n) @ to_white
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([str(t) for t in total.tolist()]),
                 pa.ListArray.from_arrays(np.arange(0, len(z) * k + 1, k, dtype=np.int32) if k else
                                          np.zeros(len(z) + 1, dtype=np.int32), white.ravel())], schema=schema)

    rows = vectors.select("id", "x").mapInArrow(task, "vec_id long, deviation string, white array<double>")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if k else F.array().cast("array<double>")
    exact = F.col("deviation").cast("decimal(38,0)")
    fits: Column = F.when(exact <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), exact.cast("long"))
    return rows.select("vec_id", exact.alias("deviation_exact"), fits.alias("deviation"), F.posexplode("white")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("col").alias("whitened"), F.element_at(share, F.col("pos") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"), "deviation_exact")


def whitened_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                        components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct usable vectors, whiten every usable row (repeated rows each)."""
    vectors, dims = integer_vectors(df, id_col, vec_col)
    return whiten(vectors, fit(vectors, dims, components))
