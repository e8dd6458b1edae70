"""Whitening of vectors by an exact integer scatter.

Components become integers on a grid. Each task subtracts a shift and adds up its distinct vectors
X with a column of ones, in integers of any length: the product of the stack with itself holds the
number of vectors, their sums S and all cross-products. Integer products run as float64 matrix
products of limbs so short that every sum is exact. Rows of these matrices are added by a shuffle,
one row a task and dimension. The driver gets one matrix for each length of vectors (bounded by
CELLS), forms n * XtX - S * St exactly, and only then converts to floating point and decomposes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import materialize

#: Cells of all scatter matrices together that the driver takes (vectors of 4,095 components).
CELLS = 1 << 24
#: Vectors multiplied at a time, and bits of a limb: ROWS * 2**(2 * BITS) is exact in float64.
ROWS, BITS = 1 << 12, 20
#: Values from here on do not fit a long integer on the grid.
WIDE = float(1 << 62)


def on_grid(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each component."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector has components, none of them null or non-finite or beyond long integers."""
    odd = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) >= WIDE))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices l of whole numbers with x = sum of l[k] << (k * BITS), all below 2**BITS."""
    parts, mask = [], (1 << BITS) - 1
    while True:
        high = x >> BITS
        # What is left of a negative number is -1 for ever: it stays a limb of its own.
        if not (high + (high < 0)).any():
            return [*parts, x.astype(np.float64)]
        parts.append((x & mask).astype(np.float64))
        x = high


def scatter(x: np.ndarray) -> np.ndarray:
    """Xt X of an integer matrix, as exact Python integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (BITS * (i + j)))
    return total


def _stacks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of each length of vectors in each batch."""
    for batch in batches:
        lists = batch.column(column)
        lengths = lists.value_lengths().to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d), batch


def _partial(shift: int):
    """Rows of a task's scatter matrices: one for each length of vectors and row of its matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, x, _ in _stacks(batches, "x"):
            own = scatter(np.concatenate([np.ones((len(x), 1), np.int64), x - shift], axis=1))
            d = x.shape[1]
            sums[d] = sums[d] + own if d in sums else own
        for d, total in sums.items():
            for k, row in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([k], pa.int32()), pa.array([pickle.dumps(row.tolist())], pa.binary())], ["dim", "k", "cells"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each (dim, k); they come in order of these."""
    key, total = None, None
    for batch in batches:
        for d, k, cells in zip(*(c.to_pylist() for c in batch.columns)):
            row = np.array(pickle.loads(cells), object)
            if (d, k) == key:
                total = total + row
                continue
            if key is not None:
                yield _cells(key, total)
            key, total = (d, k), row
    if key is not None:
        yield _cells(key, total)


def _cells(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pickle.dumps(total.tolist())], pa.binary())], ["dim", "k", "cells"])


@dataclass
class Space:
    """Whitening of the vectors of one length; sums are those of the shifted vectors."""

    n: int
    shift: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum over dimensions of (n * x - S)**2, exactly; components of unit variance)."""
        far = self._centred(x)
        square = (far * far).sum(axis=1)
        return square, (far / self.n).astype(np.float64) @ (self.axes / np.sqrt(self.values))

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in machine integers where neither it nor its squares can overflow."""
        top = int(np.abs(x - self.shift).max(initial=0)) * self.n + max(map(abs, self.sums))
        kind = np.int64 if top * top * len(self.sums) < 1 << 63 else object
        return (x - self.shift).astype(kind) * self.n - np.array(self.sums, kind)


def decompose(total: np.ndarray, shift: int, components: int) -> Space:
    """The space of an exact scatter matrix of shifted vectors with a first column of ones.

    Directions without variance (in double precision) can't be whitened and are left out.
    """
    n, sums = total[0, 0], total[0, 1:]
    exact = n * total[1:, 1:] - np.outer(sums, sums)
    # Division of Python integers rounds once.
    covariance = np.array([[c / (n * n) for c in row] for row in exact], np.float64)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    good = values > max(float(values[0]), 0.0) * len(sums) * np.finfo(np.float64).eps
    values, axes = values[good], axes[:, good]
    # Either sign would do: the largest entry of each axis is made positive.
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = sum(exact.diagonal().tolist()) / (n * n)
    return Space(n, shift, sums.tolist(), values, axes, values / trace if trace else values)


def fit(distinct: DataFrame, shift: int, components: int) -> dict[int, Space]:
    """The space of each length of vectors, from a table of distinct integer vectors x.

    Its error is measured: the whitened vectors of the table are added up as the vectors were.
    """
    parts = distinct.mapInArrow(_partial(shift), "dim int, k int, cells binary")
    added = parts.repartition("dim", "k").sortWithinPartitions("dim", "k").mapInArrow(_add, "dim int, k int, cells binary")
    lengths = distinct.select(F.size("x").alias("d")).distinct().agg(F.sum((F.col("d").cast("long") + 1) ** 2)).first()[0] or 0
    if lengths > CELLS:
        raise ValueError(f"scatter matrices of {lengths:.0f} cells are more than the driver takes ({CELLS})")
    rows: dict[int, list] = {}
    for r in sorted(added.collect(), key=lambda r: (r["dim"], r["k"])):
        rows.setdefault(r["dim"], []).append(pickle.loads(r["cells"]))
    spaces = {d: decompose(np.array(m, object), shift, components) for d, m in rows.items()}
    spaces = {d: s for d, s in spaces.items() if len(s.values)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, x, _ in _stacks(batches, "x"):
            if (d := x.shape[1]) in spaces:
                z = spaces[d].whiten(x)[1]
                z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
                sums[d] = sums.get(d, 0) + z.T @ z
        for d, total in sums.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["dim", "i", "j", "cell"])

    if spaces:
        # At most (components + 1) squared rows a length of vectors.
        met = distinct.mapInArrow(measure, "dim int, i int, j int, cell double").groupBy("dim", "i", "j").agg(F.sum("cell").alias("cell")).collect()
        for d, space in spaces.items():
            total = np.zeros((len(space.values) + 1,) * 2)
            for r in met:
                if r["dim"] == d:
                    total[r["i"], r["j"]] = r["cell"]
            mean = total[0, 1:] / space.n
            space.error = float(np.abs(total[1:, 1:] / space.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return spaces


WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries (or such as leave the long
    integers on the grid) are dropped. The others become x = floor(scale * c) + shift; each
    distinct x counts once in the fit: n of them, with sums S. Components are numbered from 1 by
    falling variance, those without variance left out; repeated rows and null ids each come out.
    deviation is the sum of (n * x - S)**2 (null beyond 38 digits). Vectors of different length
    are spaces of their own. Other columns are ignored.
    """
    vector = F.col(f"`{vector_col}`")
    good = vectors.where(usable(vector, scale)).select(F.col(f"`{id_col}`").alias("vec_id"), on_grid(vector, scale, shift).alias("x"))
    # The fit reads it three times, without the repeats; all rows are read from the source again.
    spaces = fit(materialize(good.select("x").distinct()), shift, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, x, batch in _stacks(batches, "x"):
            if (space := spaces.get(x.shape[1])) is None:
                continue
            k = len(space.values)
            step = max(1, 65_536 // k)
            ids = batch.column("vec_id")
            for first in range(0, len(at), step):
                square, z = space.whiten(x[first : first + step])
                m = len(z)
                if square.dtype == object:
                    exact = pa.array([Decimal(s) if s < 10**38 else None for s in square.tolist()], pa.decimal128(38, 0))
                else:
                    exact = pa.array(square).cast(pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [ids.take(pa.array(at[first : first + step])).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, space.n)), exact.take(row), pa.array(z.ravel()), pa.array(np.tile(space.explained, m)), pa.array(np.full(m * k, space.error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, f"vec_id {vectors.schema[id_col].dataType.simpleString()}, {WHITENED}")
