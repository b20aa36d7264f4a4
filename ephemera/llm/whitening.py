"""Embedding whitening: exact sums, distributed centred covariance, leading components, broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ephemera.llm.common import free_name, ragged
from ephemera.llm.symmetric_eigen import leading_pairs

SCALE, SHIFT = 64.0, 1_000_000  # x = floor(SCALE * c) + SHIFT
CELLS = 1 << 21  # entries that a task turns into numbers at once
GROUPS = 32  # rows that the driver merges, whatever the number of tasks
FLAT = 1e-10  # components with less than this part of the trace have no whitening


class Moments(NamedTuple):
    """Number, mean and centred sum of products of rows; two of them merge without any product of uncentred values."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:  # type: ignore[override]
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.products + other.products + np.outer(step, step) * (self.n * other.n / n))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each vector (-1: null, empty, or with a null or non-finite entry), its first entry, and all entries."""
    column = column.cast(pa.list_(pa.float64()))
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    held = np.maximum(length, 0)
    start = np.cumsum(held) - held
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return np.where((held == 0) | (bad[start + held] > bad[start]), -1, length), start, flat


def _blocks(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most CELLS entries (one row at least)."""
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index(vector))
        most = max(1, pc.max(pc.list_value_length(column)).as_py() or 1)
        step = max(1, CELLS // most)
        while at < batch.num_rows:
            piece = batch.slice(at, step)
            yield piece, *_vectors(piece.column(batch.schema.get_field_index(vector)))
            at += step


def numbers(start: np.ndarray, flat: np.ndarray, dim: int) -> np.ndarray:
    """The x of vectors of ``dim`` entries, without SHIFT, as whole numbers."""
    x = np.floor(flat[ragged(start, np.full(len(start), dim))] * SCALE)
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry is too large for a whole number of 64 bits")
    return x.astype(np.int64).reshape(len(start), dim)


def _sums(vector: str):
    """Rows and exact sums of each length of vector, a row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, length, start, flat in _blocks(batches, vector):
            for dim in np.unique(length[length >= 0]).tolist():
                x = numbers(start[length == dim], flat, dim)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                before = total.setdefault(dim, [0, [0] * dim])
                before[0] += len(x)
                before[1] = [s + (h << 32) + w for s, h, w in zip(before[1], high, low, strict=True)]
        for dim, (n, sums) in total.items():
            sums = [s + n * SHIFT for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["dim", "place", "n", "s"])

    return run


class Fit(NamedTuple):
    """What the rows are measured by: sums as n * whole + rest, components as columns divided by the deviation."""

    dim: int
    n: int
    whole: list[int]
    rest: list[int]
    components: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off exactly."""
        return (x - np.array([w - SHIFT for w in self.whole], np.int64)) - np.array(self.rest, float) / max(1, self.n)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 over the places, exact: n^2 sum a^2 - 2 n sum a r + sum r^2 with x = whole + a."""
        a = x - np.array([w - SHIFT for w in self.whole], np.int64)
        most = int(np.abs(a).max(initial=0))
        if self.dim * max(most * most, most << 24) < 2**62 and max(self.rest, default=0) < 2**48:
            r = np.array(self.rest, np.int64)
            squares, high, low = ((a * b).sum(axis=1).tolist() for b in (a, r >> 24, r & 0xFFFFFF))
            own = sum(v * v for v in self.rest)
            return [self.n * (self.n * q - 2 * ((h << 24) + w)) + own for q, h, w in zip(squares, high, low, strict=True)]
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in a.tolist()]


def _moments(shared, vector: str):
    """Moments of the centred rows, or of their whitened values once there are components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit: Fit = shared.value
        total = None
        for _, length, start, flat in _blocks(batches, vector):
            own = length == fit.dim
            if own.any():
                rows = fit.centred(numbers(start[own], flat, fit.dim))
                part = Moments.of(rows if fit.components is None else rows @ fit.components)
                total = part if total is None else total + part
        if total is not None:
            yield _as_batch(total)

    return run


def _as_batch(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.n], pa.int64()), pa.array([m.mean.tobytes()], pa.binary()), pa.array([m.products.tobytes()], pa.binary())], names=["n", "mean", "products"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for n, mean, products in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            centre = np.frombuffer(mean)
            part = Moments(n, centre, np.frombuffer(products).reshape(len(centre), -1))
            total = part if total is None else total + part
    if total is not None:
        yield _as_batch(total)


def _moments_of(vectors: DataFrame, vector: str, shared) -> Moments:
    """Each task's moments, merged in GROUPS tasks and then on the driver: no task or driver holds one for each task."""
    schema = "n long, mean binary, products binary"
    parts = vectors.mapInArrow(_moments(shared, vector), schema).repartition(GROUPS).mapInArrow(_merge, schema)
    (out,) = _merge(iter(parts.toArrow().to_batches()))
    centre = np.frombuffer(out["mean"][0].as_py())
    return Moments(out["n"][0].as_py(), centre, np.frombuffer(out["products"][0].as_py()).reshape(len(centre), -1))


def _project(shared, vector: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit: Fit = shared.value
        k = fit.components.shape[1]
        for piece, length, start, flat in _blocks(batches, vector):
            own = length == fit.dim
            x = numbers(start[own], flat, fit.dim)
            white = np.ascontiguousarray(fit.centred(x) @ fit.components)
            kept = piece.filter(pa.array(own))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(fit.deviation(x), pa.decimal128(38, 0)), listed], names=names)

    return run


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """The rows with a whole vector, with deviation, whitened, n, explained and identity_error.

    Each entry c becomes x = floor(64 c) + 1,000,000.  With n rows, sums S and the covariance V of x (divisor n):
    deviation (decimal) is the sum of (n x - S)^2 over the places, exact; whitened is an array with, for each component
    (unit eigenvectors of V by falling eigenvalue e), the projection of x - S/n over sqrt(e); explained has e/trace(V);
    identity_error is the largest absolute entry of whitened's covariance minus the identity, measured over all rows.

    Sums are exact whole numbers added up by Spark.  The covariance comes from centred blocks, merged as moments, first
    in tasks, then at most ``GROUPS`` of them on the driver, which finds the components of a matrix of dim x dim: memory
    there follows the length of a vector, never the number of rows.  The components are broadcast.  ``vectors`` is
    read four times, and nothing but the merge of moments is shuffled.

    Rows are left out whose vector is null or empty, or has a null or non-finite entry, or is not of the commonest
    length (the longer of equally common ones).  An entry whose x does not fit a long is an error.  Components whose
    e is below 1e-10 of the trace have no whitening and end the arrays, so equal vectors, or a single one, give empty
    arrays and identity_error 0.  Repeated rows count again and are whitened alike; a table without whole vectors
    gives no rows; result columns whose names are taken get a trailing '_'.
    """
    spark = vectors.sparkSession
    names = {x: free_name(vectors, x) for x in ("deviation", "whitened", "n", "explained", "identity_error")}
    kinds = [T.StructField(names["deviation"], T.DecimalType(38, 0)), T.StructField(names["whitened"], T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*vectors.schema.fields, *kinds])
    alone = vectors.select(vector_col)
    sums = alone.mapInArrow(_sums(vector_col), "dim int, place int, n long, s decimal(38,0)")
    every = sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = every.where("place = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    values = np.zeros(0)
    trace, error = 0.0, 0.0
    if most is None:
        fit = Fit(0, 0, [], [], np.zeros((0, 0)))
    else:
        found = [int(r.s) for r in every.where(F.col("dim") == most.dim).orderBy("place").collect()]
        fit = Fit(most.dim, most.n, [s // most.n for s in found], [s % most.n for s in found])
        covariance = _moments_of(alone, vector_col, spark.sparkContext.broadcast(fit)).products / fit.n
        trace = float(np.trace(covariance))
        values, axes = leading_pairs(covariance, components)
        kept = values > FLAT * trace
        values, axes = values[kept], axes[:, kept]
        fit = fit._replace(components=axes / np.sqrt(values))
    shared = spark.sparkContext.broadcast(fit)
    if len(values):
        error = float(np.abs(_moments_of(alone, vector_col, shared).products / fit.n - np.eye(len(values))).max())
    out = vectors.mapInArrow(_project(shared, vector_col, schema.names), schema)
    explained = F.array(*(F.lit(float(e) / trace) for e in values)) if len(values) else F.array().cast("array<double>")
    return out.withColumns({names["n"]: F.lit(fit.n).cast("long"), names["explained"]: explained, names["identity_error"]: F.lit(error)})
