"""Embedding whitening with the leading eigenvectors of the covariance.

Components become whole numbers x = floor(64 c) + 1000000. Spark adds up the
vectors and, centred at the rounded means, their products; both sums are exact
integers, so the covariance is that of exact centring whatever the order of
tasks. The eigenpairs come from ``spectrum.leading``: a matrix of dimension x
dimension, which no number of rows makes larger, is all the driver holds.

Rows whose vector is null or has a null or non-finite entry are dropped. A
missing entry of a shorter vector counts as c = 0; entries beyond +-2^40 are
held there. A component without variance (fewer rows than dimensions, constant
entries) has ``whitened`` null and ``explained`` 0, and stays out of
``identity_error``; where no entry varies at all, ``explained`` and
``identity_error`` are null. ``deviation`` is null where it exceeds a long.
Null ids and repeated rows are kept, further columns are ignored, empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.lemp import matrix, usable
from talus.llm.spectrum import EPS, leading
from talus.session import literal_rows

SCALE = 64
OFFSET = 1_000_000
LIMIT = float(1 << 40)
COMPONENTS = 32
ROWS = 1 << 13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
CELL = "cell int, total decimal(38,0)"


def whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 c), exact in double precision."""
    return np.floor(np.clip(matrix(column, width) * SCALE, -LIMIT, LIMIT))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _exact_sums(x: np.ndarray) -> list[int]:
    if np.abs(x).max(initial=0) * len(x) < 1 << 53:
        return x.sum(axis=0).astype(np.int64).tolist()
    return [sum(map(int, column)) for column in x.T]


def _exact_products(z: np.ndarray) -> list[int]:
    """Upper triangle of Z'Z in whole numbers."""
    upper = np.triu_indices(z.shape[1])
    if np.abs(z).max(initial=0) ** 2 * len(z) < 1 << 53:
        return (z.T @ z)[upper].astype(np.int64).tolist()
    large = z.astype(np.int64).astype(object)
    return (large.T @ large)[upper].tolist()


def _added(batches, width: int, per_chunk) -> Iterator[pa.RecordBatch]:
    """One row a cell of the sums of ``per_chunk`` (lists of integers) over a task's rows."""
    total = None
    for batch in _chunks(batches):
        part = per_chunk(whole(batch.column("embedding"), width))
        total = part if total is None else [a + b for a, b in zip(total, part)]
    if total is not None:
        cells = pa.array(np.arange(len(total), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total, pa.decimal128(38, 0))], ["cell", "total"])


def _summed(rows: DataFrame, width: int, per_chunk) -> list[int]:
    """The sums over all rows; as many numbers as there are cells."""
    parts = rows.select("embedding").mapInArrow(lambda batches: _added(batches, width, per_chunk), CELL)
    table = parts.groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    totals = dict(zip(table.column("cell").to_pylist(), table.column("total").to_pylist()))
    return [int(totals[c]) for c in range(len(totals))]


@dataclass
class Whitening:
    """n vectors with sums of floor(64 c), and the leading eigenpairs of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __post_init__(self):
        self.middle = np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=float)
        self.left = np.array([float(Fraction(s, self.n) - int(m)) for s, m in zip(self.sums, self.middle)])
        self.varies = self.values > len(self.sums) * EPS * self.trace
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        self.factors = (self.vectors * scale[:, None]).T

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.left) @ self.factors

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2 per row, in whole numbers."""
        z = (x - self.middle).astype(np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        reach = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if reach * reach * max(1, len(rest)) < 1 << 63:
            d = self.n * z - np.array(rest, np.int64)
            return pa.array((d * d).sum(axis=1), pa.int64())
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in z]
        return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def fit(rows: DataFrame, width: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Eigenpairs of the covariance of ``n`` usable rows of ``width`` entries (divisor n)."""
    sums = _summed(rows, width, _exact_sums)
    middle = np.array([round(Fraction(s, n)) for s in sums], dtype=float)
    products = _summed(rows, width, lambda x: _exact_products(x - middle))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.zeros((width, width))
    for i, j, c in zip(*np.triu_indices(width), products):
        covariance[i, j] = covariance[j, i] = float(Fraction(n * c - rest[i] * rest[j], n * n))
    values, vectors = leading(covariance, components)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, over all rows.

    The mean of x - S/n is exactly zero, so products are those of centred values.
    """
    if not model.varies.any():
        return None
    width, k = len(model.sums), len(model.values)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in _chunks(batches):
            w = model.project(whole(batch.column("embedding"), width))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["cell", "total"])

    parts = rows.select("embedding").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    table = parts.toArrow()
    found = np.zeros(len(upper[0]))
    found[table.column("cell").to_numpy()] = table.column("total").to_numpy()
    both = model.varies[upper[0]] & model.varies[upper[1]]
    return float(np.abs(found / model.n - (upper[0] == upper[1]))[both].max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and leading component; see SCHEMA."""
    kept = rows.where(usable()).select(F.col("vec_id").cast("long"), "embedding")
    n, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n or not width:
        return literal_rows(rows.sparkSession, [], SCHEMA)
    model = fit(kept, width, n, components)
    k = len(model.values)
    error = identity_error(kept, model)
    explained = np.where(model.varies, model.values / model.trace, 0.0) if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            x = whole(batch.column("embedding"), width)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                model.deviations(x).take(each),
                pa.array(model.project(x).ravel(), mask=np.tile(~model.varies, m)),
                pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m)),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return kept.mapInArrow(run, SCHEMA)
