"""Whitening of vectors by matrix-free block subspace iteration.

Each entry c becomes the whole number x = floor(1024 * c) + 100000.  The covariance V of the x-vectors is never formed: a
pass over the rows computes X'(XQ) for a block Q, on rows centred exactly (n * x - S is a whole number).  The driver
holds the blocks so far (at most ``KEPT`` blocks of columns), orthonormalises the next one against them by QR and solves
the small Rayleigh-Ritz problem over all of them, until the residual ``|V q - e q|`` of every wanted component is at
most ``TOLERANCE`` times the largest eigenvalue.  Earlier blocks are kept because embeddings have flat spectra: the last
block alone gains a factor of 0.95 a pass where eigenvalues 8 and 17 are that close, the kept blocks need a few passes.

Every pass reads the table again (one column), so there is no state that a lost executor could take along.  Tasks hand
on one array of dims x block sums; these are added in a few tasks before the driver receives them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.lineage import shuffle_partitions

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000  # fixed values: x = floor(SCALE * c) + SHIFT
EXTRA = 8  # columns of a block beyond the components
KEPT = 64  # blocks that are held before the subspace is cut back to the best Ritz vectors
PASSES = 300
TOLERANCE = 1e-13
ZERO = 1e-13  # an eigenvalue of less than this share of the largest is no variance but rounding
ADDERS = 32  # tasks that add what the tasks of a pass found
SAFE = 1 << 62
ROWS = 4096  # vectors that are centred at a time


@dataclass
class Fit:
    """What all tasks know: the number of fitted rows and exact sums per dimension; then components (dims x k) and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` as whole numbers: 64 bits where they hold it, else Python's."""
        widest = max(map(abs, self.sums)) + self.n * int(np.abs(x).max(initial=0))
        if widest < SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.from_mean(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of ``n * x - S``; None where it is no long."""
        far = self.from_mean(x)
        if far.dtype == object or int(np.abs(far).max(initial=0)) ** 2 * self.dims >= SAFE:
            far = far.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


def whole_numbers(vectors: pa.Array, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the usable vectors of each length, or of ``dims`` alone: none is null or holds a null or non-finite entry.

    Entries whose x is no long count as non-finite.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), -1)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    begin = vectors.offsets.to_numpy()[:-1]
    for width in [dims] if dims is not None else np.unique(size[size > 0]):
        at = np.flatnonzero(size == width)
        for first in range(0, len(at), ROWS):
            part = at[first : first + ROWS]
            c = SCALE * flat[begin[part][:, None] + np.arange(width)]
            good = (np.abs(c) < SAFE).all(axis=1)  # false for NaN
            yield part[good], np.floor(c[good]).astype(np.int64) + SHIFT


def fit_rows(vectors: DataFrame, vector_col: str) -> Fit | None:
    """Count and sums per dimension of the usable vectors of the commonest length (of two as common, the greater)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        many: dict[int, int] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                if len(x):
                    width, wide = x.shape[1], int(np.abs(x).max()) >= SAFE // ROWS
                    total = (x.astype(object) if wide else x).sum(axis=0).astype(object)
                    sums[width] = sums.get(width, 0) + total
                    many[width] = many.get(width, 0) + len(x)
        for width, s in sums.items():
            cols = [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([many[width]] * width, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))]
            yield pa.record_batch(cols, ["width", "dim", "n", "s"])

    found = vectors.select(vector_col).mapInArrow(add, "width int, dim int, n long, s decimal(38,0)").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = found.groupBy("width").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return None
    rows = found.where(F.col("width") == best["width"]).select("dim", "s").collect()
    return Fit(best["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["dim"])])


def summed(vectors: DataFrame, vector_col: str, fit: Fit, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part(centred rows)`` over all usable rows: one array a task, added in few tasks, then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), fit.dims):
                if len(x):
                    total, seen = total + part(fit.centred(x)), True
        if seen:
            yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                v = row.values.to_numpy()
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    few = min(ADDERS, shuffle_partitions(vectors.sparkSession))
    rows = vectors.select(vector_col).mapInArrow(run, "sums array<double>").repartition(few).mapInArrow(add, "sums array<double>").toPandas()
    return np.sum([np.asarray(r) for r in rows["sums"]], axis=0).reshape(shape) if len(rows) else np.zeros(shape)


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to the orthonormal ``basis``; projected twice against cancellation."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q, _ = np.linalg.qr(q - basis @ (basis.T @ q)) if q.shape[1] else (q, None)
    return q[:, : max(0, basis.shape[0] - basis.shape[1])]


def principal_components(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, extra: int = EXTRA, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the k largest of a symmetric matrix known by ``times(Q)`` alone.

    Fewer than k where the others are zero.  Raises if ``PASSES`` products certify no k residuals.
    """
    width = min(dims, k + extra)
    block, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((dims, width)))
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    for _ in range(PASSES):
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, turned = basis @ turn[:, :width], image @ turn[:, :width]
        rest = turned - ritz * values[:width]
        short = np.linalg.norm(rest, axis=0) <= TOLERANCE * max(values[0], 0.0)
        block = np.zeros((dims, 0)) if basis.shape[1] == dims else _new_directions(rest[:, ~short], basis)
        if short[:k].all() or not block.shape[1]:  # a subspace that cannot grow is invariant
            real = values[:k] > ZERO * max(values[0], 0.0)
            return values[:k][real], ritz[:, :k][:, real]
        if basis.shape[1] + block.shape[1] > kept * width:
            basis, image = ritz, turned
            block = _new_directions(block, basis)
    raise RuntimeError(f"{k} components are not certain after {PASSES} passes")


def fitted(vectors: DataFrame, k: int, vector_col: str) -> Fit | None:
    """Count, sums, components, eigenvalues and trace of the covariance of all usable rows; None if there is none."""
    fit = fit_rows(vectors, vector_col)
    if fit is None:
        return None

    def times(q: np.ndarray) -> np.ndarray:
        return summed(vectors, vector_col, fit, lambda x: x.T @ (x @ q), q.shape) / fit.n

    # One more pass gives the trace; a wide matrix never has its diagonal beside its products in one task's array.
    fit.trace = float(summed(vectors, vector_col, fit, lambda x: (x * x).sum(axis=0), (fit.dims,)).sum() / fit.n)
    fit.values, fit.components = principal_components(times, fit.dims, min(k, fit.dims))
    return fit


def whitened(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component, from 1.

    Dropped are null and empty vectors, those with a null or non-finite entry (or one whose whole number is no long),
    and those of another length than the commonest.  Components without variance (all rows equal, fewer rows than
    dimensions) cannot be whitened and have no rows; an empty table gives an empty result.  Equal vectors, repeated
    and null ids are rows of their own; other columns are ignored.  A ``deviation`` beyond 64 bits is null.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = fitted(vectors, k, vector_col)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema)
    project = fit.components / np.sqrt(fit.values)
    many = len(fit.values)
    # Rows are centred exactly, so the mean of what is whitened is the mean of rounding: it is taken off all the same.
    moments = summed(vectors, vector_col, fit, lambda x: np.vstack([(w := x @ project).T @ w, w.sum(axis=0)[None]]), (many + 1, many)) / fit.n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(many)).max())
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(1), fit.dims):
                w = fit.centred(x) @ project
                rows = len(at)
                ids = batch.column(0).take(pa.array(np.repeat(at, many)))
                far = pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), many)))
                cols = [ids, pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, fit.n)), far,
                        pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * many, error))]
                yield pa.record_batch(cols, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_col, vector_col).mapInArrow(run, schema)
