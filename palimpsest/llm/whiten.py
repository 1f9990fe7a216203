"""Whitening of embeddings: exact sums, a centred covariance, and its leading eigenpairs by spectrum slicing.

Four scans of the vectors, none with a shuffle of rows: exact sums per dimension; the covariance, centred before
multiplying; the covariance of the whitened values, which shows how far from the identity they are; the result. A task
hands on one small total (dim x dim numbers at most), totals are added in ``FOLDS`` streams, and the driver adds the
``FOLDS`` totals left. What reaches the driver depends on the dimension, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches
from palimpsest.llm.spectrum import leading

#: Streams in which the tasks' totals are added.
FOLDS = 64
#: Grid of the entries: floor(GRID * c) + LIFT. Entries beyond +-EDGE on the grid count as the edge.
GRID, LIFT, EDGE = 1024, 100_000, 1 << 52
_HALF = 26
_SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows whose vector is there and has finite entries only."""
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding")
    )


def grid(column: pa.Array, dim: int) -> np.ndarray:
    """The whole numbers of a column of vectors, one row each; a vector shorter than ``dim`` is filled up with 0.0."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), dim))
    if len(flat):
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.clip(np.floor(GRID * out), -EDGE, EDGE).astype(np.int64) + LIFT


def _total(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], dtype: str) -> np.ndarray | None:
    """The sum of what ``part`` returns for every task: equally long vectors, or None for a task without rows.
    Shorter vectors are filled up with zeros."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(batches)
        if found is not None:
            fold = TaskContext.get().partitionId() % FOLDS
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([found.astype(dtype).tobytes()])], ["fold", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _sum((raw for b in batches for raw in b.column("total").to_pylist()), dtype)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    totals = df.mapInArrow(one, "fold int, total binary").repartition(FOLDS, "fold").mapInArrow(add, "total binary")
    return _sum((bytes(r.total) for r in totals.collect()), dtype)


def _sum(parts: Iterator[bytes], dtype: str) -> np.ndarray | None:
    total = None
    for raw in parts:
        more = np.frombuffer(raw, dtype)
        if total is None:
            total = more.copy()
        else:
            if len(more) > len(total):
                total = np.concatenate([total, np.zeros(len(more) - len(total), dtype)])
            total[: len(more)] += more
    return total


class Centre:
    """n and the exact sums; ``whole`` and ``rest`` are the mean's whole part and the sum's remainder over n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.remainder = np.array([s % n for s in sums], np.int64)
        self.fraction = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole parts are subtracted exactly, so only the fraction is rounded."""
        return (x - self.whole) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exactly; None where it is no long."""
        low = x - self.whole
        about = ((low.astype(np.float64) * self.n - self.remainder) ** 2).sum(axis=1)
        if len(about) and about.max() < 2.0**62:
            part = low * self.n - self.remainder
            return (part * part).sum(axis=1).tolist()
        out: list[int | None] = []
        rest = self.remainder.tolist()
        for row, near in zip(low.tolist(), about.tolist(), strict=True):
            exact = sum((a * self.n - b) ** 2 for a, b in zip(row, rest, strict=True)) if near < 2.0**64 else 1 << 63
            out.append(exact if exact < 1 << 63 else None)
        return out


def sums(rows: DataFrame) -> Centre | None:
    """Pass 1: how many vectors, of which dimension (the longest one's), and their exact sums. None without rows.
    A sum is kept in two halves, so that no order of adding can overflow."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        n, high, low, short = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            dim = pa.compute.max(pa.compute.list_value_length(column)).as_py()
            x = grid(column, dim) - LIFT
            if dim > len(high):
                grown = np.zeros((2, dim), np.int64)
                grown[0, : len(high)], grown[1, : len(low)] = high, low
                high, low = grown
            high[:dim] += (x >> _HALF).sum(axis=0)
            low[:dim] += (x & ((1 << _HALF) - 1)).sum(axis=0)
            n, short = n + batch.num_rows, False
        return None if short is None else np.concatenate([[n], np.stack([high, low], axis=1).ravel()])

    found = _total(rows, part, "<i8")
    if found is None:
        return None
    n = int(found[0])
    return Centre(n, [(int(a) << _HALF) + int(b) + LIFT * n for a, b in zip(found[1::2], found[2::2], strict=True)])


def covariance(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], dim: int, n: int, width: int) -> np.ndarray:
    """The covariance, divisor n, of what ``values`` makes of the rows' whole numbers (``width`` centred columns).
    What is left of a mean after centring is taken off the product."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, mean = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = values(grid(batch.column("embedding"), dim))
            total += z.T @ z
            mean += z.sum(axis=0)
        return np.concatenate([total.ravel(), mean])

    found = _total(rows, part, "<f8")
    mean = found[width * width:] / n
    return found[: width * width].reshape(width, width) / n - np.outer(mean, mean)


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every usable row on each of the first
    ``k`` components of the covariance of all usable rows.

    Rows whose vector is null or holds null, NaN or infinite entries take no part; a null id is kept. A vector shorter
    than the longest is filled up with 0.0. Repeated rows count and are returned as often as they come. There are no
    more components than dimensions, and none for an eigenvalue that rounding can not tell from zero (equal vectors
    only, or one row): nothing can be scaled by it. Equal eigenvalues give any orthonormal vectors of their space, the
    same ones for all rows. ``deviation`` is null where the exact number is no long; entries beyond 2^52 on the grid
    count as 2^52. Other columns are not read. No usable rows, no result rows.
    """
    rows = usable(bounded_batches(vectors), id_col, vector_col)
    spark = vectors.sparkSession
    centre = sums(rows)
    dim = len(centre.sums) if centre else 0
    if not dim:
        return spark.createDataFrame([], _SCHEMA)
    v = covariance(rows, centre.centred, dim, centre.n, dim)
    found = leading(v, k)
    real = found.values > 512 * dim * np.finfo(float).eps * np.abs(v).sum(axis=1).max()
    width = int(real.sum())
    if not width:
        return spark.createDataFrame([], _SCHEMA)
    # a whitened value is linear in the centred entries
    onto = found.vectors[:, real] / np.sqrt(found.values[real])
    explained = found.values[real] / np.trace(v)
    check = covariance(rows, lambda x: centre.centred(x) @ onto, dim, centre.n, width)
    error = float(np.abs(check - np.eye(width)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = grid(batch.column("embedding"), dim)
            repeat = pa.array(np.repeat(np.arange(m), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(repeat), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * width, centre.n)), pa.array(centre.deviation(x), pa.int64()).take(repeat),
                    pa.array((centre.centred(x) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * width, error)),
                ],
                [c.split()[0] for c in _SCHEMA.split(", ")],
            )

    return rows.mapInArrow(run, _SCHEMA)
