"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

Components are read as whole numbers x = floor(64 c) + 1,000,000. Counts, sums and scatter are exact: every
task centres its rows at the whole number below the mean before it multiplies, adds up whole numbers, and sends one
triangle (d * (d + 1) / 2 numbers, whatever the number of rows); the remainder of the centring is taken off in whole numbers as well. The
covariance V is thus the correctly rounded one. V = L L' with diagonal pivots; plane rotations make the columns of L orthogonal without ever forming
another product, so small eigenvalues keep their relative accuracy: column norms squared are the eigenvalues, normalised columns the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import small_batches

SCALE, OFFSET = 64, 1_000_000
#: Scaled components have to stay below this, so that a sum over 2**34 rows fits 38 digits.
LARGEST = 2.0**46


@dataclass(frozen=True)
class Whitening:
    """The fit: number of vectors, exact sums, components (columns of ``axes``) by falling eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def floor_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def remainder(self) -> list[int]:
        """Sums of the rows as centred at :attr:`floor_mean`, each from 0 to n - 1."""
        return [s % self.n for s in self.sums]


def usable(vector: str) -> Column:
    """Whether a vector is there, is not empty and has only finite entries."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return F.coalesce((F.size(entries) > 0) & ~bad, F.lit(False))


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers x."""
    c = np.floor(SCALE * batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    if c.size and np.abs(c).max() >= LARGEST:
        raise ValueError("a vector component is too large for exact sums")
    return c.astype(np.int64) + OFFSET


def _per_task(vectors: DataFrame, dim: int, width: int, add, number: str) -> list[tuple[int, object]]:
    """Sum over all rows of ``add(x)``, ``width`` numbers: one row a task and number, summed by Spark."""
    small_batches(vectors.sparkSession)
    exact = number != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = add(whole(batch, dim))
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total, pa.float64())
            yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), values], ["i", "v"])

    rows = vectors.mapInArrow(run, f"i int, v {number}").groupBy("i").agg(F.sum("v").cast(number).alias("v")).collect()
    return sorted((r.i, r.v) for r in rows)


def exact_product(y: np.ndarray) -> np.ndarray:
    """Upper triangle of y'y in whole numbers (Python's, which have no bound)."""
    largest = int(np.abs(y).max())
    i, j = np.triu_indices(y.shape[1])
    if largest * largest * len(y) < 2**53:  # every partial sum is a whole double
        f = y.astype(np.float64)
        return (f.T @ f)[i, j].astype(np.int64).astype(object)
    o = y.astype(object)
    return (o.T @ o)[i, j]


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with V = L L', rows in the order of V, columns by falling pivot; as many columns as the numerical rank."""
    d = len(v)
    left, factor, open_ = v.copy(), np.zeros((d, d)), np.ones(d, bool)
    diagonal = np.diag(v).copy()
    least = d * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(np.where(open_, diagonal, -1.0)))
        if diagonal[p] <= least:
            return factor[:, :k]
        column = np.where(open_, left[:, p], 0.0) / math.sqrt(diagonal[p])
        column[p] = math.sqrt(diagonal[p])
        factor[:, k] = column
        open_[p] = False
        left -= np.outer(column, column)
        diagonal = np.diag(left).copy()
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared column norms (falling) and unit columns of ``factor`` once rotations made its columns orthogonal.

    A round rotates disjoint pairs of columns at once; a sweep's rounds meet every pair (round-robin).
    """
    a = np.array(factor, dtype=float)
    r = a.shape[1]
    places = list(range(r + r % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(places) - 1):
            pairs = [(p, q) for p, q in zip(places[:len(places) // 2], reversed(places[len(places) // 2:])) if max(p, q) < r]
            places = [places[0], places[-1], *places[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(off.max()))
            turn = off > 1e-16
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1.0), 0.0)
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
        if worst < 1e-15 * max(1, math.isqrt(r)):
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    axes = a[:, order] / norms[order]
    lead = axes[np.abs(axes).argmax(0), np.arange(r)] if r else np.ones(0)
    return norms[order] ** 2, axes * np.where(lead < 0, -1.0, 1.0)


def fit(vectors: DataFrame, dim: int) -> Whitening | None:
    """Fit on all rows of ``vectors`` (column ``_v`` of ``dim`` doubles); None without rows."""
    first = _per_task(vectors, dim, dim + 1, lambda x: np.append(x.astype(object).sum(0), len(x)), "decimal(38,0)")
    if not first:
        return None
    *sums, n = (int(v) for _, v in first)
    floors = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    products = _per_task(vectors, dim, dim * (dim + 1) // 2, lambda x: exact_product(x - floors), "decimal(38,0)")
    v = np.zeros((dim, dim))
    for (i, j), (_, m) in zip(zip(*np.triu_indices(dim)), products):
        v[i, j] = v[j, i] = (n * int(m) - rest[i] * rest[j]) / (n * n)
    eigenvalues, axes = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, sums, axes, eigenvalues, float(np.trace(v)))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """Every vector's whitened coordinates, one row per vector and component, of the ``most`` first components.

    Columns: the id, component (from 1), n, deviation (exact; NULL where it passes a long), whitened, explained, identity_error.
    Vectors that are NULL, empty or hold a NULL or non-finite entry are dropped, and so are those of another length than the
    commonest (the longest of several), since a covariance needs one. A NULL or repeated id is kept as it is; other columns are ignored. Directions
    without variance have no component, so equal vectors, a single one, or none give no rows. A component of 2**40 or more is an error.
    """
    spark = rows.sparkSession
    small_batches(spark)
    good = rows.where(usable(vector)).select(F.col(id_column).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    length = good.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = rows.schema[id_column].dataType
    schema = f"_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = spark.range(0).selectExpr(*(f"CAST(NULL AS {t}) AS {c}" for c, t in (p.split(" ", 1) for p in schema.split(", "))))
    named = lambda df: df.withColumnRenamed("_id", id_column)
    if length is None:
        return named(nothing)
    dim = length.d
    vectors = good.where(F.size("_v") == dim)
    model = fit(vectors, dim)
    k = min(most, len(model.eigenvalues))
    if k == 0:
        return named(nothing)
    n, floors, rest = model.n, model.floor_mean, model.remainder
    mean_rest = np.array([t / n for t in rest])
    axes = model.axes[:, :k] / np.sqrt(model.eigenvalues[:k])

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - floors) - mean_rest) @ axes

    i, j = np.triu_indices(k)
    moments = _per_task(vectors, dim, k + len(i), lambda x: np.concatenate([(w := coordinates(x)).sum(0), (w.T @ w)[i, j]]), "double")
    mean = np.array([v for _, v in moments[:k]]) / n
    cov = np.array([v for _, v in moments[k:]]) / n - mean[i] * mean[j]
    error = float(np.abs(cov - (i == j)).max())
    explained = model.eigenvalues[:k] / model.trace
    names = [c.split(" ", 1)[0] for c in schema.split(", ")]

    def deviations(y: np.ndarray) -> list[int | None]:
        bound = n * max(1, int(np.abs(y).max()) + 1)
        if bound * bound * dim < 2**63:
            gaps = n * y - np.array(rest, np.int64)
            return (gaps * gaps).sum(1).tolist()
        gaps = n * y.astype(object) - np.array(rest, object)
        return [v if v < 2**63 else None for v in (gaps * gaps).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(batch, dim)
                rows_of = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch([
                    batch.column("_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows_of), n)),
                    pa.array(deviations(x - floors), pa.int64()).take(pa.array(rows_of)), pa.array(coordinates(x).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows_of), error))], names)

    return named(vectors.mapInArrow(run, schema))
