"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries c become the numbers x = floor(SCALE * c) + SHIFT.  Steps, over all vectors:

1. Counts and exact sums: each batch adds its numbers up in two halves that can't overflow; the sums meet as integers.
2. The centred scatter: each task centres its rows and multiplies them; its matrix goes out row by row, and rows of equal number
   meet in one task, which adds them up one after the other.
3. The driver factors that one matrix (dimensions squared, whatever the number of vectors): Cholesky with pivoting stops at
   the rank; right rotations (Jacobi, disjoint pairs at once) make the factor's columns orthogonal.  Their squared lengths are the
   eigenvalues, the columns at length one the components.
4. Each vector is projected and stored; the covariance of all projections is measured against the identity.

Defined results: vectors that are null or hold null or non-finite entries are dropped, as are those whose length isn't the
most frequent one (ties: the larger), empty ones, and those with a number of ``LARGEST`` or more.  Components without
variance (beyond the rank) are left out, so a table of one vector, of equal vectors or of none gives no row.  Rows that
repeat count and come again; null ids stay; a deviation that isn't a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Numbers have to be exact as doubles.
LARGEST = 1 << 53
_HALF = 26


class Whitening(NamedTuple):
    """What is learned from all vectors: bounded by the dimension, not by their number."""

    n: int
    sums: list[int]
    mean: np.ndarray
    #: One unit column for each component, and eigenvalues of the covariance, falling.
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def finite_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, vec (doubles) of the rows whose vector has finite entries only."""
    vec = F.col(embedding).cast("array<double>")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST / SCALE / 2)))
    return vectors.select(F.col(vec_id).alias("vec_id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)


def numbers(column: pa.Array) -> np.ndarray:
    """The rows of vectors of one length as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def measured(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = numbers(batch.column("vec"))
                n, high, low = n + len(x), high + (x >> _HALF).sum(axis=0), low + (x & ((1 << _HALF) - 1)).sum(axis=0)
        if n:
            at = pa.array(np.arange(len(high), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([at, pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["at", "n", "high", "low"])

    parts = rows.select("vec").mapInArrow(add, "at int, n bigint, high bigint, low bigint")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    return (found[0]["n"] if found else 0), [(r["high"] << _HALF) + r["low"] for r in found]


def scatter(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum over all vectors of the centred vector times itself."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                centred = numbers(batch.column("vec")) - mean
                total += centred.T @ centred
        at = pa.array(np.arange(len(mean), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array([r.tobytes() for r in total], pa.binary())], names=["at", "line"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for at, line in zip(batch.column("at").to_pylist(), batch.column("line")):
                if at != now:
                    if now is not None:
                        yield one(now, total)
                    now, total = at, np.zeros(len(mean))
                total += np.frombuffer(line.as_buffer())
        if now is not None:
            yield one(now, total)

    def one(at: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "line"])

    parts = rows.select("vec").mapInArrow(multiply, "at int, line binary")
    lines = parts.repartition("at").sortWithinPartitions("at").mapInArrow(add, "at int, line binary").collect()
    return np.array([np.frombuffer(bytes(r["line"])) for r in sorted(lines, key=lambda r: r["at"])])


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A factor with as many columns as the matrix has rank: factor @ factor.T is the matrix; lower triangular but for the order of rows."""
    left, pivots = np.diag(matrix).copy(), np.arange(len(matrix))
    least = len(matrix) * np.finfo(float).eps * left.max(initial=0.0)
    columns = np.zeros((len(matrix), len(matrix)))
    for k in range(len(matrix)):
        best = k + int(np.argmax(left[pivots[k:]]))
        pivots[[k, best]] = pivots[[best, k]]
        at, rest = pivots[k], pivots[k + 1:]
        if left[at] <= least:
            return columns[:, :k]
        columns[at, k] = np.sqrt(left[at])
        columns[rest, k] = (matrix[rest, at] - columns[rest, :k] @ columns[at, :k]) / columns[at, k]
        left[rest] -= columns[rest, k] ** 2
        left[at] = 0.0
    return columns


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of disjoint pairs (a tournament)."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        a, b = seats[: len(seats) // 2], seats[len(seats) // 2:][::-1]
        real = (a < n) & (b < n)
        yield a[real], b[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Unit columns and falling eigenvalues of factor @ factor.T, by rotating pairs of the factor's columns until all are orthogonal."""
    g = factor.copy()
    for _ in range(sweeps):
        worst = 0.0
        for a, b in _rounds(g.shape[1]):
            x, y = g[:, a], g[:, b]
            p, q, r = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            off = np.abs(r) > 4 * np.finfo(float).eps * np.sqrt(p * q)
            worst = max(worst, float((np.abs(r) / np.sqrt(p * q)).max(initial=0.0)))
            if off.any():
                a, b, x, y, p, q, r = a[off], b[off], x[:, off], y[:, off], p[off], q[off], r[off]
                z = (q - p) / (2 * r)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                g[:, a], g[:, b] = c * (x - t * y), c * (t * x + y)
        if worst <= 4 * np.finfo(float).eps * len(g):
            break
    lengths = (g * g).sum(axis=0)
    order = np.argsort(-lengths, kind="stable")
    return g[:, order] / np.sqrt(lengths[order]), lengths[order]


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (vec: vectors of one length); None without variance."""
    n, sums = measured(rows)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    total = scatter(rows, mean)
    total = (total + total.T) / 2
    vectors, values = one_sided_jacobi(pivoted_cholesky(total))
    if not len(values):
        return None
    return Whitening(n, sums, mean, vectors[:, :components], values[:components] / n, float(np.trace(total)) / n)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, exact; None if it isn't a long."""
    about = ((x - np.array([s / n for s in sums])) ** 2).sum(axis=1) * float(n) ** 2
    if about.max(initial=0.0) < 2.0**61 and n * float(np.abs(x).max(initial=1)) < 2.0**62 and max(map(abs, sums)) < 1 << 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def projected(rows: DataFrame, fit: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an array of one number for each component)."""
    turn = fit.components / np.sqrt(fit.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = numbers(batch.column("vec"))
                white = (x - fit.mean) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(deviations(x, fit.n, fit.sums), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy().reshape(-1, components)
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    parts = white.select("whitened").mapInArrow(multiply, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((components + 1, components + 1))
    for r in found:
        total[r["i"], r["j"]] = r["v"]
    mean = total[-1, :-1] / n
    return float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(components)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component."""
    rows = finite_vectors(vectors, vec_id, embedding)
    usual = rows.groupBy(F.size("vec").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("most")).first()["most"]
    rows = rows.filter(F.size("vec") == (usual["size"] if usual else 0))
    fit = fitted(rows, components)
    if fit is None:
        rows = rows.limit(0)
        fit = Whitening(0, [0], np.zeros(1), np.zeros((1, 1)), np.ones(1), 1.0)
        error, white = 0.0, projected(rows, fit)
    else:
        white = stored(projected(rows, fit), "whitened")
        error = identity_error(white, fit.n, len(fit.eigenvalues))
    shares = F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues])
    entries = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return entries.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": query}
ORACLES: dict[str, str] = {}
