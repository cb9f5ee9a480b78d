"""Embedding whitening: exact sums and a centred scatter from tasks, cyclic Jacobi rotations, projection on components.

Entries become whole numbers. In one pass, each task keeps its count, exact sums, mean and scatter about that mean; tasks
are merged row by row of the matrix, with the shift between their means. The driver holds one matrix a vector length and
turns it by Jacobi rotations until nothing is left off the diagonal, which gives small eigenvalues as accurately as large
ones. The whitening matrix is broadcast; its size follows from the vector length, not from the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.pieces import trimmed
from folimetry.llm.scratch import by_place, written

#: Fixed values of the query's contract.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Entries beyond this, times SCALE, aren't exact whole numbers as doubles.
LARGEST = float(1 << 52)
BLOCK_ROWS = 4096
SWEEPS = 60


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) + OFFSET; entries too large for an exact result are an error."""
    scaled = np.floor(entries.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST / SCALE:g} in size")
    return scaled.astype(np.int64) + OFFSET


def usable(vector: Column) -> Column:
    """Not null, no entry null or not finite."""
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of one vector length each, and their matrix, some rows at a time."""
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(sizes).tolist():
            of = batch if (sizes == width).all() else batch.take(pa.array(np.flatnonzero(sizes == width)))
            for a in range(0, of.num_rows, BLOCK_ROWS):
                b = of.slice(a, BLOCK_ROWS)
                yield width, b, b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


@dataclass
class Moments:
    """Count, mean, scatter about the mean, and exact sums of rows; of some rows of the matrix only, where `at` is given."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray
    at: int | slice = slice(None)

    def add(self, n: int, mean: np.ndarray, scatter: np.ndarray, sums: np.ndarray) -> None:
        """Merge with other rows: both scatters, and that of the two means."""
        if not n:
            return
        shift, total = mean - self.mean, self.n + n
        self.scatter = self.scatter + scatter + np.multiply.outer(shift[self.at], shift) * (self.n / total * n)
        self.mean = self.mean + shift * (n / total)
        self.n, self.sums = total, self.sums + sums


MOMENTS = "width int, i int, part int, n long, mean array<double>, scatter array<double>, sums decimal(38,0)"


def _rows_of(width: int, part: int, m: Moments, at: list[int]) -> pa.RecordBatch:
    rows = len(at)
    mean = pa.array([m.mean] * rows, pa.list_(pa.float64()))
    columns = [pa.array([width] * rows, pa.int32()), pa.array(at, pa.int32()), pa.array([part] * rows, pa.int32()), pa.array([m.n] * rows, pa.int64()), mean]
    scatter = pa.array(list(m.scatter.reshape(rows, -1)), pa.list_(pa.float64()))
    sums = pa.array([int(s) for s in np.atleast_1d(m.sums)], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([*columns, scatter, sums], ["width", "i", "part", "n", "mean", "scatter", "sums"])


def _moments(values: Callable[[int, np.ndarray], np.ndarray]):
    """Task: moments of the values of its rows, a row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for width, _, matrix in _by_width(batches):
            x = values(width, matrix)
            d, exact = x.shape[1], x.dtype == np.int64
            if not d:
                continue
            sums = (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object) if exact else np.zeros(d, object)
            mean = x.mean(axis=0, dtype=np.float64)
            centred = x - mean
            again = centred.mean(axis=0)  # what rounding left in the mean
            mean, centred = mean + again, centred - again
            m = held.setdefault(width, Moments(0, np.zeros(d), np.zeros((d, d)), np.zeros(d, object)))
            m.add(len(x), mean, centred.T @ centred, sums)
        for width, m in held.items():
            yield _rows_of(width, TaskContext.get().partitionId(), m, list(range(len(m.mean))))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: one row for each row of the matrix, in the order of the tasks that it came from."""
    name, held = None, None
    for batch in batches:
        for r in batch.to_pylist():  # d rows a task of the scan
            if (r["width"], r["i"]) != name:
                if held is not None:
                    yield _rows_of(name[0], 0, held, [name[1]])
                name, d = (r["width"], r["i"]), len(r["mean"])
                held = Moments(0, np.zeros(d), np.zeros(d), 0, r["i"])
            held.add(r["n"], np.array(r["mean"]), np.array(r["scatter"]), int(r["sums"]))
    if held is not None:
        yield _rows_of(name[0], 0, held, [name[1]])


def moments(vectors: DataFrame, values: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, Moments]:
    """Moments of values(width, matrix) over all rows of vectors(vector), by vector length."""
    parts = vectors.select("vector").mapInArrow(trimmed(_moments(values)), MOMENTS)
    whole = parts.repartition("width", "i").sortWithinPartitions("width", "i", "part").mapInArrow(trimmed(_merged), MOMENTS)
    out: dict[int, Moments] = {}
    for r in sorted(written(whole).collect(), key=lambda r: (r.width, r.i)):  # a row for each dimension
        m = out.setdefault(r.width, Moments(r.n, np.array(r.mean), np.zeros((len(r.mean),) * 2), np.zeros(len(r.mean), object)))
        m.scatter[r.i], m.sums[r.i] = r.scatter, int(r.sums)
    for m in out.values():
        m.scatter = (m.scatter + m.scatter.T) / 2
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    A sweep visits every pair of rows once; pairs that share no row are turned together. It ends when no entry is larger
    than rounding against the diagonal entries that it lies between. An eigenvector's largest entry is positive.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    v = np.eye(d)
    circle = list(range(d + d % 2))  # one seat stays empty where d is odd
    floor = np.finfo(float).tiny / np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(circle) - 1):
            pairs = [sorted(x) for x in zip(circle[: len(circle) // 2], reversed(circle[len(circle) // 2 :]), strict=True)]
            p, q = np.array([x for x in pairs if x[1] < d] or np.empty((0, 2), int), int).T
            circle = [circle[0], circle[-1], *circle[1:-1]]
            off, low, high = a[p, q], a[p, p], a[q, q]
            todo = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(low * high)) + floor
            if not todo.any():
                continue
            turned, p, q, off, low, high = True, p[todo], q[todo], off[todo], low[todo], high[todo]
            with np.errstate(over="ignore"):
                theta = (high - low) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            cos = 1 / np.hypot(t, 1)
            sin = t * cos
            for x in (a, v):
                left, right = x[:, p], x[:, q]
                x[:, p], x[:, q] = left * cos - right * sin, left * sin + right * cos
            upper, lower = a[p], a[q]
            a[p], a[q] = cos[:, None] * upper - sin[:, None] * lower, sin[:, None] * upper + cos[:, None] * lower
            a[p, p], a[q, q], a[p, q], a[q, p] = low - t * off, high + t * off, 0, 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0) if d else v
    largest = np.argmax(np.abs(v), axis=0) if d else np.empty(0, int)
    return np.diag(a)[order], v * np.where(v[largest, np.arange(d)] < 0, -1, 1)


@dataclass
class Whitening:
    """Fitted to the vectors of one length. `values` and `matrix` (a column each) are of the components asked for; a
    component without variance has a column of nulls (nan)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; x is split so that x - S/n is exact to double precision."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """sum over dimensions of (n * x - S)**2, exact, as Python integers."""
        whole = [s // self.n for s in self.sums]
        near = x - np.array(whole, np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        if self.n * (float(np.abs(near).max(initial=0)) + 1) < 2**54 and x.shape[1] < 512:
            y = np.abs(self.n * near - rest.astype(np.int64))
            high, low = y >> 27, y & ((1 << 27) - 1)  # sums of products of halves fit
            big, mid, small = ((u * w).sum(axis=1).astype(object) for u, w in ((high, high), (high, low), (low, low)))
            return big * (1 << 54) + mid * (1 << 28) + small
        y = near.astype(object) * self.n - rest
        return (y * y).sum(axis=1) if x.shape[1] else np.zeros(len(x), object)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """For each length of vectors(vector), all usable: eigenvectors of the covariance (divisor n) over its root."""
    out = {}
    for width, m in moments(vectors, lambda width, x: whole_numbers(x)).items():
        values, axes = jacobi(m.scatter / m.n)
        total = float(np.trace(m.scatter)) / m.n
        kept = min(components, width)
        some = values[:kept] > max(total, 0) * width * np.finfo(float).eps  # the rest is rounding
        scale = np.where(some, np.sqrt(np.where(some, values[:kept], 1)), np.nan)
        explained = np.where(some, values[:kept], 0) / total if total > 0 else np.zeros(kept)
        out[width] = Whitening(m.n, m.sums, values[:kept], axes[:, :kept] / scale, explained)
    return out


def identity_error(vectors: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float | None]:
    """Largest absolute entry, for each vector length, of the covariance of the whitened vectors minus the identity, over
    components that have variance; None where there are none."""
    models = vectors.sparkSession.sparkContext.broadcast(fitted)

    def whitened(width: int, matrix: np.ndarray) -> np.ndarray:
        model = models.value.get(width)
        out = model.project(whole_numbers(matrix)) if model else np.empty((len(matrix), 0))
        return out[:, ~np.isnan(out).any(axis=0)]

    found = moments(vectors, whitened)
    return {w: float(np.abs(found[w].scatter / found[w].n - np.eye(len(found[w].mean))).max()) if w in found else None for w in fitted}


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns of the table by place (c0, c1, ...) of each row whose vector is usable, then n (vectors fitted on),
    deviation (decimal, exact: sum over dimensions of (n*x-S)**2), whitened (array), explained (array) and identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out. Vectors of different lengths are lists of
    their own, each with its own fit; a driver holds a square matrix of each length. Components beyond the length don't
    exist; those without variance (one row, constant or dependent dimensions) are null in whitened and 0 in explained,
    and don't enter identity_error, which is null where all are such. A vector without entries has no components and null n. Equal vectors have equal results. Zero vectors count
    like others. An entry beyond 2**52/1024 in size is an error, for its whole number isn't exact. An empty table gives an
    empty result; other columns may have any names.
    """
    rows = by_place(table.filter(usable(F.col(vector))), F.col(vector).alias("vector"))
    fitted = fit_whitening(rows.select("vector"), components)
    errors = identity_error(rows.select("vector"), fitted)
    model, places = table.sparkSession.sparkContext.broadcast((fitted, errors)), rows.columns[:-1]

    def lists(values: np.ndarray) -> pa.Array:
        flat = pa.array(values.reshape(-1), pa.float64(), mask=np.isnan(values.reshape(-1)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, off = model.value
        for width, b, matrix in _by_width(batches):
            x = whole_numbers(matrix)
            m = models.get(width) or Whitening(0, np.zeros(0, object), np.zeros(0), np.zeros((0, 0)), np.zeros(0))  # no entries
            made = {
                "n": pa.array([m.n or None] * len(x), pa.int64()), "deviation": pa.array(m.deviations(x).tolist(), pa.decimal128(38, 0)), "whitened": lists(m.project(x)),
                "explained": lists(np.broadcast_to(m.explained, (len(x), len(m.explained)))), "identity_error": pa.array([off.get(width)] * len(x), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in places), *made.values()], [*places, *made])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(trimmed(run), f"{head}n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit a long; deviation_exact has it in full."""
    made = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = made.select(F.col("c0").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error", F.col("deviation").alias("deviation_exact"),
    )
