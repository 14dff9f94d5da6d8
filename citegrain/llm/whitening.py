"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers; the fit list holds each distinct one once, and its sums are exact. The
centred rows are made orthonormal by passes: a pass adds up the Gram matrix of the rows, each first
solved through the triangular factors found so far, and factors it by Cholesky. A small shift keeps
the first factor of a badly scaled or rank-deficient matrix positive definite; the passes after it
repair what the shift and rounding cost. Every row is solved anew from its whole numbers, so no
orthonormal table is written. The product of the factors is R; the singular values and right vectors
of R are those of the centred rows, hence the eigenvalues and eigenvectors of their covariance. A
last pass measures how far the whitened covariance is from the identity.

Gram matrices are added up within tasks and then cell by cell, so that no task adds up more than its
share; the driver holds a few matrices of dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import Scratch, arrow_pass, bounded_batches, parts_of

SCALE = 256
COMPONENTS = 4
PASSES = 3
# Eigenvalues below this part of the greatest are rounding: such components have no whitened values.
LEAST_PART = 1e-12


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries, as floor(scale * entry)."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.where(c.isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, d)


def summed(fit: DataFrame, d: int, cells: int, of: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
    """Sum of `of(x)` over all rows: within tasks, then by cell. Exact where whole."""
    kind, number = ("long", "decimal(38,0)") if whole else ("double", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64 if whole else float)
        for batch in batches:
            for part in parts_of(batch):
                total += of(_matrix(part.column("x"), d)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "total"])

    bounded_batches(fit.sparkSession)
    parts = fit.select("x").mapInArrow(run, f"cell long, total {kind}")
    found = np.zeros(cells, object if whole else float)
    for r in parts.groupBy("cell").agg(F.sum(F.col("total").cast(number)).alias("total")).collect():
        found[r.cell] = int(r.total) if whole else r.total
    return found


class Centring:
    """Whole vectors less their exact mean sums / n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        # the whole part is taken off in whole numbers, so large means cost no digits
        self.base = np.array([s // n for s in sums], np.int64)
        self.left = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.left

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - sums)^2 of every row; null where it leaves a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = (x.astype(object) * self.n - np.array(self.sums, object)) ** 2
        return [v if v < 1 << 63 else None for v in exact.sum(1)]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows times the inverse of each upper triangular factor, by substitution."""
    for r in factors:
        found = np.empty_like(rows)
        for j in range(rows.shape[1]):
            found[:, j] = (rows[:, j] - found[:, :j] @ r[:j, j]) / r[j, j]
        rows = found
    return rows


def shifted_cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of the Gram matrix with the shift (a part of its norm) on the diagonal.

    Where rounding leaves it indefinite all the same, the shift grows until it is not.
    """
    d, norm = len(gram), float(np.linalg.norm(gram, 2)) or 1.0
    while True:
        try:
            return np.linalg.cholesky(gram + np.eye(d) * (shift * norm)).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, 4 * d * np.finfo(float).eps)


def triangular_factors(fit: DataFrame, centring: Centring, d: int, passes: int) -> list[np.ndarray]:
    """The factors of all passes; their product, last first, is R of the centred rows."""
    factors: list[np.ndarray] = []
    for _ in range(passes):
        shared = fit.sparkSession.sparkContext.broadcast((centring, [*factors]))

        def gram(x: np.ndarray) -> np.ndarray:
            centred, before = shared.value
            q = solved(centred(x), before)
            return q.T @ q

        found = summed(fit, d, d * d, gram).reshape(d, d)
        # the bound on the rounding errors of the first Gram matrix; sums go by batches and cells
        shift = 0.0 if factors else 11 * (min(centring.n, 1 << 20) * d + d * (d + 1)) * np.finfo(float).eps / 2
        factors.append(shifted_cholesky((found + found.T) / 2, shift))
    return factors


def whiten(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, passes: int = PASSES,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector.

    Rows whose vector is null or holds null or non-finite entries are left out; so are vectors of
    another length than most (the longer one on ties). Repeated vectors count once in the fit and
    come out as often as they occur. There is a row for each component up to `components`, or the
    length of the vectors if that is less. Where a component's eigenvalue is zero (vectors all alike,
    or too few), whitened is null and explained 0, null if nothing varies at all; identity_error
    covers the other components. A deviation beyond a long is null. No vectors give no rows. Other
    columns are ignored.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, vec_id, vector, scale)
    schema = (
        f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or sizes.d == 0:
        return spark.createDataFrame([], schema)
    d = sizes.d
    vectors = vectors.where(F.size("x") == d)
    with Scratch(spark) as tables:
        fit = tables.keep(vectors.select("x").distinct())
        totals = summed(fit, d, d + 1, lambda x: np.append(x.sum(0), len(x)), whole=True)
        n, sums = totals[-1], totals[:-1].tolist()
        centring = Centring(n, sums)
        r = np.eye(d)
        for factor in triangular_factors(fit, centring, d, passes):
            r = factor @ r
        _, spread, axes = np.linalg.svd(r)
        values, k = spread**2 / n, min(components, d)
        live = (values > LEAST_PART * values[0]) & (n > 1)
        values[~live] = 0
        onto = np.zeros((d, k))
        onto[:, live[:k]] = axes[:k][live[:k]].T / np.sqrt(values[:k][live[:k]])
        shared = spark.sparkContext.broadcast((centring, onto))

        def moments(x: np.ndarray) -> np.ndarray:
            centred, onto = shared.value
            w = centred(x) @ onto
            return np.append(w.T @ w, w.sum(0))

        found = summed(fit, d, k * k + k, moments)
    mean = found[k * k :] / n
    off = found[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.diag(live[:k].astype(float))
    error = float(np.abs(off).max())
    explained = (values[:k] / values.sum()).tolist() if values.sum() > 0 else [None] * k

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        centred, onto = shared.value
        x = _matrix(batch.column("x"), d)
        m = len(x)
        whitened = (centred(x) @ onto).reshape(-1)
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
             pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
             pa.array(np.repeat(np.array(centred.deviations(x), object), k), pa.int64()),
             pa.array(whitened, mask=np.tile(~live[:k], m)), pa.array(explained * m, pa.float64()),
             pa.array(np.full(m * k, error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return arrow_pass(vectors, step, schema)
