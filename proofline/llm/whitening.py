"""Operator 11: whitening of embeddings by a one-sided Jacobi SVD.

Method. Components become integers; the fit list is each distinct integer vector once, grouped in Spark and written. Its
integer sums give the exact mean. Every task reduces its centred rows block by block to one triangle R (TSQR); triangles
are stacked and reduced again, a few in each task, until a fixed number is left for the driver. There plane rotations make
R's columns orthogonal (one-sided Jacobi): their lengths are the singular values, the accumulated rotations the
components. A further pass over the fit list measures the covariance of what is whitened against the identity.

The driver holds one square of the vector's length for each length of vectors, whatever the number of rows.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped; each length of
vectors is whitened by itself; a null vec_id stays null; rows that repeat a vector (or all of it) each give their rows, the
fit list has it once; components without variance cannot be scaled and are left out, so a table with a single distinct
vector, or an empty one, gives no rows; a deviation beyond 64 bits is null; integers of 2^40 or more raise ValueError.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm._common import lean, materialise
from proofline.llm.vectors import matrices, packed, unpacked

SCALE, LARGEST = 256, 1 << 40
FAN = 16  # so many triangles meet in a task, and in the end on the driver
BLOCK = 4096  # rows that are reduced at once
NOTHING = 1e-13  # of the largest singular value: below it a direction has no variance


@dataclass
class Whitening:
    """What the vectors of one length are whitened with."""

    n: int
    sums: list[int]
    axes: np.ndarray  # a component a column
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])  # quotients of whole numbers, rounded once
        return (x - mean) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum)^2, in whole numbers of any size."""
        most, d = int(np.abs(x).max(initial=0)), x.shape[1]
        sums = np.array(self.sums, object)
        kind = np.int64 if d * most * max(most, *map(abs, self.sums)) < 2**63 else object
        squares, mixed = (x.astype(kind) ** 2).sum(1).tolist(), (x.astype(kind) * sums.astype(kind)).sum(1).tolist()
        rest = sum(s * s for s in self.sums)
        out = (self.n * self.n * q - 2 * self.n * m + rest for q, m in zip(squares, mixed, strict=True))
        return [v if v < 2**63 else None for v in out]


def fit_list(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(dim, x): each distinct integer vector of `vectors(embedding)` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for _, x in matrices(batch.column(0), scale, LARGEST):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), packed(x)], names=["dim", "x"])

    return vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "dim int, x binary").distinct()


def totals(fitted: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the fit list, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for d, x in unpacked(batch.column("x"), batch.column("dim").to_numpy()):
                n, sums = held.get(d, (0, [0] * d))
                held[d] = n + len(x), [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["dim", "place", "n", "s"])

    rows = fitted.mapInArrow(run, "dim int, place int, n long, s decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # the length squared at most, summed over lengths
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.dim, r.place)):
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return out


def reduced(rows: np.ndarray, d: int) -> np.ndarray:
    """The square triangle of a QR decomposition; zero rows where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _emit(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId()
    for d, r in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([at], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["dim", "place", "r"])


def triangles(fitted: DataFrame, sums: dict[int, tuple[int, list[int]]], fan: int = FAN) -> dict[int, np.ndarray]:
    """R of the centred fit list, by length: a triangle a task, then `fan` triangles a task until there are few."""
    means = {d: np.array([s / n for s in t]) for d, (n, t) in sums.items()}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in unpacked(batch.column("x"), batch.column("dim").to_numpy()):
                for at in range(0, len(x), BLOCK):
                    centred = x[at : at + BLOCK] - means[d]
                    held[d] = reduced(np.vstack([held[d], centred]) if d in held else centred, d)
        yield from _emit(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, r in zip(batch.column("dim").to_pylist(), batch.column("r").to_pylist(), strict=True):
                one = np.frombuffer(r, "<f8").reshape(d, d)
                held[d] = reduced(np.vstack([held[d], one]), d) if d in held else one
        yield from _emit(held)

    shape = "dim int, place long, r binary"
    left = materialise(fitted.mapInArrow(first, shape), "triangles")
    while (tasks := left.select("place").distinct().count()) > fan:
        parts = -(-tasks // fan)
        left = materialise(left.repartition(parts, F.col("place") % parts).mapInArrow(again, shape), "triangles")
    out: dict[int, np.ndarray] = {}
    for row in left.orderBy("place").collect():  # at most `fan` triangles a length
        one = np.frombuffer(row.r, "<f8").reshape(row.dim, row.dim)
        out[row.dim] = reduced(np.vstack([out[row.dim], one]), row.dim) if row.dim in out else one
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values of r, and its right singular vectors as columns: one-sided Jacobi.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are rotated together (a round robin). It ends
    when all pairs are orthogonal to the rounding of doubles.
    """
    d = r.shape[1]
    u, v = np.array(r, np.float64), np.eye(d)
    ring = list(range(d + d % 2))  # with an odd number one column rests each round
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            a, b, g = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0), (u[:, p] * u[:, q]).sum(0)
            on = np.abs(g) > 1e-15 * np.sqrt(a * b)
            if not on.any():
                continue
            turned, (p, q), (a, b, g) = True, (p[on], q[on]), (a[on], b[on], g[on])
            zeta = (b - a) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    sizes = np.sqrt((u * u).sum(0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


def fit(vectors: DataFrame, components: int = 4, scale: int = SCALE, fan: int = FAN) -> dict[int, Whitening]:
    """The whitening of each length of vectors in `vectors(embedding)`."""
    fitted = materialise(fit_list(vectors, scale), "whitening-fit")
    sums = totals(fitted)
    out = {}
    for d, r in triangles(fitted, sums, fan).items():
        sizes, axes = jacobi(r)
        n = sums[d][0]
        kept = min(components, int((sizes > NOTHING * sizes[0]).sum()) if sizes[0] > 0 else 0)
        axes = axes[:, :kept] / np.sqrt((axes[:, :kept] ** 2).sum(0))
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
        out[d] = Whitening(n, sums[d][1], axes, sizes[:kept] ** 2 / n, float((sizes**2).sum() / n))
    for d, error in identity_errors(fitted, out).items():
        out[d].identity_error = error
    return out


def identity_errors(fitted: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in unpacked(batch.column("x"), batch.column("dim").to_numpy()):
                y = models[d].whiten(x)
                held[d] = held.get(d, 0) + y.T @ y
        for d, g in held.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array([d] * g.size, pa.int32()), *(pa.array(m.ravel().astype(np.int32)) for m in (i, j)), pa.array(g.ravel())], names=["dim", "i", "j", "g"])

    out: dict[int, float] = {}
    for d, i, j, g in fitted.mapInArrow(run, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g")).collect():  # components squared
        out[d] = max(out.get(d, 0.0), abs(g / models[d].n - (i == j)))
    return out


def whiten(vectors: DataFrame, components: int = 4, scale: int = SCALE) -> DataFrame:
    """A row for each kept row of `vectors(vec_id, embedding)` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    models = fit(vectors, components, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for rows, x in matrices(batch.column(1), scale, LARGEST):
                m = models[x.shape[1]]
                k = len(m.values)
                if not k:
                    continue
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                ids = batch.column(0).take(pa.array(rows)).take(each)
                deviation = pa.array(m.deviations(x), pa.int64()).take(each)
                columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(each), m.n, np.int64), deviation, m.whiten(x).ravel(), np.tile(m.values / m.trace, len(rows)), np.full(len(each), m.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
