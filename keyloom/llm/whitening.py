"""Embedding whitening by a bidiagonal qd solver.

1. Vectors become integers x = floor(256 c). Those that are equal count once: they travel
   as bytes of the smallest width that holds them, and are made distinct with map-side
   partials, so a very common vector is no hot group.
2. Sums of all dimensions are exact (Python integers of two halves of 32 bits).
3. Blockwise QR: every task folds its centred rows into one triangular R; the Rs are
   folded again in groups of ``FOLD`` until one is left. R'R is the scatter of the rows,
   which are never multiplied by themselves. R has dims x dims numbers at any table size;
   only it and the sums reach the driver.
4. ``bidiagonal`` gives eigenvalues and directions of the covariance R'R / n.
5. One pass projects every row; another sums the covariance of the projected fit rows.

Defined results: rows whose vector is null, holds a null or a non-finite entry, or one
outside the range of long after scaling have no row in the result, nor do vectors of
another length than the table's commonest one (the shortest of equally common ones).
Repeated rows and null vec_ids are kept. Components stop at the rank: directions of no
variance cannot be whitened, so one vector, equal vectors or an empty table give no rows.
A deviation that exceeds a long is null. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_vectors
from .tables import cut

SCALE = 256
COMPONENTS = 4
FOLD = 32
ROWS = 4096
WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, flat x) of the vectors that count in a batch, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    valid = np.ones(rows, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()  # leaves out the entries of null lists
    length = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become nan
    x = np.floor(entries * float(SCALE)) + 0.0
    fine = np.isfinite(x) & (x >= -(2.0 ** 63)) & (x < 2.0 ** 63)
    row = np.repeat(np.arange(rows), length)
    good = valid & (np.bincount(row, ~fine, rows) == 0)
    return np.flatnonzero(good), length[good], np.where(fine, x, 0.0)[good[row]].astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """A vector's bytes, in the smallest width that holds it: equal vectors have equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w in WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)
    return bytes([np.dtype(width).itemsize]) + x.astype(width).tobytes()


def _unpacked(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(packed), dims), np.int64)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, f"<i{b[0]}", offset=1)
    return out


def quantised(embeddings: DataFrame) -> DataFrame:
    """(dims, x) of every vector that counts, x packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, flat = _vectors(batch.column(0))
            ends = np.cumsum(length)
            packed = [_packed(v) for v in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([pa.array(length.astype(np.int32)), pa.array(packed, pa.binary())], names=["dims", "x"])

    return embeddings.select("embedding").mapInArrow(task, "dims int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), ROWS):
            yield _unpacked(column.slice(at, ROWS).to_pylist(), dims)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of fit vectors and the exact sum of each dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in _blocks(batches, dims):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * dims, pa.int64()), pa.array(range(dims), pa.int32()), pa.array(high), pa.array(low)], names=["n", "dim", "high", "low"])

    parts = fit.select("x").mapInArrow(task, "n long, dim int, high long, low long")
    exact = "decimal(38,0)"
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(exact)).alias("high"), F.sum(F.col("low").cast(exact)).alias("low")).collect()
    by_dim = {r.dim: (int(r.high) << 32) + int(r.low) for r in rows}
    return (rows[0].n if rows else 0), [by_dim.get(d, 0) for d in range(dims)]


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(float) - mean


def _folded(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """The R of all rows, a block at a time."""
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def triangle(fit: DataFrame, dims: int, mean: np.ndarray, fold: int = FOLD) -> np.ndarray:
    """R of the centred fit rows (dims x dims), folded in a tree."""

    def emit(r: np.ndarray, group: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _folded((_centred(x, mean) for x in _blocks(batches, dims)), dims)
        if len(r):
            yield emit(r, TaskContext.get().partitionId())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rs = (np.frombuffer(b.as_py()).reshape(-1, dims) for batch in batches for b in batch.column(1))
        r = _folded(rs, dims)
        if len(r):
            yield emit(r, TaskContext.get().partitionId())

    parts = cut(fit.select("x").mapInArrow(first, "part long, r binary"))
    while (count := parts.count()) > fold:
        parts = cut(parts.repartition(-(-count // fold), "part").mapInArrow(again, "part long, r binary"))
    left = [np.frombuffer(row.r).reshape(-1, dims) for row in parts.orderBy("part").collect()]  # fold matrices at most
    r = _folded(iter(left), dims)
    return np.vstack([r, np.zeros((dims - len(r), dims))])


class Whitening:
    """What the fit found: n, sums, eigenvalues, directions (one column each), shares of the trace and the identity error."""

    def __init__(self, dims: int, n: int, total: list[int], values: np.ndarray, directions: np.ndarray, trace: float):
        self.dims, self.n, self.total, self.values, self.directions, self.trace = dims, n, total, values, directions, trace
        self.mean = np.array([s / n for s in total]) if n else np.zeros(dims)
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.mean) @ self.directions / np.sqrt(self.values)


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Learn the whitening of the distinct vectors."""
    every = quantised(embeddings)
    distinct = cut(every.groupBy("dims", "x").agg(F.count("*").alias("rows")))
    widths = distinct.groupBy("dims").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), "dims").first()
    if widths is None:
        return Whitening(0, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    dims = widths.dims
    distinct = distinct.where(F.col("dims") == dims)
    n, total = sums(distinct, dims)
    mean = np.array([s / n for s in total])
    squares, directions = right_vectors(triangle(distinct, dims, mean), components)
    found = Whitening(dims, n, total, squares[:directions.shape[1]] / n, directions, float(squares.sum()) / n)
    if directions.shape[1]:
        found.identity_error = identity_error(distinct, found)
    return found


def identity_error(distinct: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the projected fit rows' covariance minus the identity."""
    dims, k = found.dims, found.directions.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, first = np.zeros((k, k)), np.zeros(k)
        for x in _blocks(batches, dims):
            w = found.project(x)
            products += w.T @ w
            first += w.sum(0)
        cells = [(i, j, products[i, j]) for i in range(k) for j in range(k)] + [(i, -1, first[i]) for i in range(k)]
        i, j, v = zip(*cells, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], names=["i", "j", "v"])

    cells = {(r.i, r.j): r.v / found.n for r in distinct.select("x").mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    # the rows are centred already; what rounding has left of their mean goes too
    return max(abs(cells[i, j] - cells[i, -1] * cells[j, -1] - (i == j)) for i in range(k) for j in range(k))


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; null beyond a long."""
    limit = 1 << 63
    rough = ((x.astype(float) * n - np.array([float(s) for s in total])) ** 2).sum(1)
    plain = rough < 2.0 ** 61
    bounded = max((abs(s) for s in total), default=0) < 1 << 62
    out: list[int | None] = [None] * len(x)
    if bounded:
        # below 2**61 every term, and so every n x - S, fits a long, and n x < 2**62 + 2**31
        own = n * x[plain] - np.array(total, np.int64)
        for i, v in zip(np.flatnonzero(plain).tolist(), (own * own).sum(1).tolist(), strict=True):
            out[i] = v
    for i in np.flatnonzero(~plain | (not bounded)).tolist():
        if rough[i] < 2.0 ** 64:
            exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), total, strict=True))
            out[i] = exact if exact < limit else None
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that counts and component."""
    found = fit(embeddings, components)
    dims, k = found.dims, found.directions.shape[1]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    shares = (found.values / found.trace) if k else found.values

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, length, flat = _vectors(batch.column(1))
            fits = length == dims
            if not k or not fits.any():
                continue
            row, x = row[fits], flat[np.repeat(fits, length)].reshape(-1, dims)
            whitened = found.project(x)
            deviation = pa.array(_deviations(x, found.n, found.total), pa.int64())
            ids = batch.column(0).take(pa.array(row))
            again = pa.array(np.repeat(np.arange(len(row)), k))
            count = len(row) * k
            yield pa.RecordBatch.from_arrays([
                ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(row))), pa.array(np.full(count, found.n)),
                deviation.take(again), pa.array(whitened.reshape(-1)), pa.array(np.tile(shares, len(row))), pa.array(np.full(count, found.identity_error)),
            ], names=names)

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(task, SCHEMA)
