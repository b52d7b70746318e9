"""Sums of products of many columns, in blocks of columns that are rows of their own.

A cell (i, j) holds what the columns of blocks i and j have in common; tasks add up as many cells as their memory allows
in one pass over the table, the cells of the other blocks in further passes, and cells are merged by their key. So neither
a task nor the driver holds more than its share of the n^2 numbers, whatever n is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block; numbers of cells that a task holds at most.
BLOCK, MOST_HELD = 256, 16_000_000
CELL = "i int, j int, v array<double>"


def _cell(i: int, j: int, v: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), values], ["i", "j", "v"])


def _added(cells: DataFrame, width: int) -> DataFrame:
    """Cells of one key added up; a task holds only the sums of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("v")
            for r, key in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())):
                v = vectors[r].values.to_numpy()
                held[key] = held[key] + v if key in held else v
        for (i, j), v in held.items():
            yield _cell(i, j, v)

    return cells.repartition(width, "i", "j").mapInArrow(run, CELL)


def _rows(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The features of a batch; what is null or not finite is NaN."""
    features = batch.column("features")
    if features.null_count:
        features = features.drop_null()
    x = features.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
    return np.where(np.isfinite(x), x, np.nan)


def centre(data: DataFrame, n: int) -> np.ndarray:
    """The mean of each feature over its finite values (0 without any), one pass; it only keeps later sums from cancelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n))
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, n)
                total += [np.nansum(x, axis=0), np.isfinite(x).sum(axis=0)]
        yield _cell(0, 0, total)

    few = max(1, int(data.sparkSession.sparkContext.defaultParallelism**0.5))
    parts = data.select("features").mapInArrow(run, CELL).withColumn("i", F.pmod(F.monotonically_increasing_id(), F.lit(few)).cast("int"))
    got = sum((np.array(r.v).reshape(2, n) for r in _added(parts, few).collect()), np.zeros((2, n)))  # a vector a column, of few tasks
    return got[0] / np.maximum(got[1], 1)


def cells(data: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(i, j, v): for blocks i <= j of columns, five matrices after each other: products, sums and squares of the row's column, sums and squares of the other.

    Each pair of columns counts the rows where both are finite; n is their number, the sixth matrix. data has features
    (arrays of n numbers); persist or write it first if it is costly, since it is read once a group of cells.
    """
    mean = centre(data, n)
    count = -(-n // block)
    keys = [(i, j) for i in range(count) for j in range(i, count)]
    at_once = max(1, MOST_HELD // (6 * block * block))
    parts = None
    for first in range(0, len(keys), at_once):
        mine = keys[first : first + at_once]

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _rows(batch, n) - mean
                here = np.isfinite(x)
                x = np.where(here, x, 0.0)
                m = here.astype(float)
                for i, j in mine:
                    a, b = slice(i * block, (i + 1) * block), slice(j * block, (j + 1) * block)
                    xa, xb, ma, mb = x[:, a], x[:, b], m[:, a], m[:, b]
                    v = np.stack([xa.T @ xb, xa.T @ mb, (xa * xa).T @ mb, ma.T @ xb, ma.T @ (xb * xb), ma.T @ mb])
                    held[i, j] = held[i, j] + v if (i, j) in held else v
            for (i, j), v in held.items():
                yield _cell(i, j, v)

        own = _added(data.select("features").mapInArrow(run, CELL), len(mine))
        parts = own if parts is None else parts.unionByName(own)
    return parts


def correlations(data: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(a, b, corr): Pearson coefficients of all pairs of features (from 0), both halves, over the rows where both are finite; null where one is constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())):
                p, q = min(block, n - i * block), min(block, n - j * block)
                xy, x, xx, y, yy, m = batch.column("v")[r].values.to_numpy().reshape(6, p, q)
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = (xy - x * y / m) / np.sqrt((xx - x * x / m) * (yy - y * y / m))
                corr = np.where(((xx - x * x / m) > 1e-12 * xx) & ((yy - y * y / m) > 1e-12 * yy) & (m > 1), np.clip(corr, -1.0, 1.0), np.nan)
                left, right = np.meshgrid(np.arange(p) + i * block, np.arange(q) + j * block, indexing="ij")
                for a, b in ((left, right), (right, left))[: 1 if i == j else 2]:
                    values = corr.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(values, mask=np.isnan(values))], ["a", "b", "corr"])

    return cells(data, n, block).mapInArrow(run, "a int, b int, corr double")


def by_label(data: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sums) for features and label (1, -1): the features' means, and for both labels the count, sum and sum of squares of what differs from them.

    Values that are null or not finite are left out by feature. Two passes; vectors of n numbers are all that is gathered.
    """
    mean = centre(data, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3, n))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("features")))
            if not batch.num_rows:
                continue
            x, y = _rows(batch, n) - mean, batch.column("label").to_numpy(zero_copy_only=False)
            for k, cls in enumerate((1, -1)):
                own = x[y == cls]
                total[k] += [np.isfinite(own).sum(axis=0), np.nansum(own, axis=0), np.nansum(own * own, axis=0)]
        yield _cell(0, 0, total)

    few = max(1, int(data.sparkSession.sparkContext.defaultParallelism**0.5))
    parts = data.select("features", "label").mapInArrow(run, CELL).withColumn("i", F.pmod(F.monotonically_increasing_id(), F.lit(few)).cast("int"))
    return mean, sum((np.array(r.v).reshape(2, 3, n) for r in _added(parts, few).collect()), np.zeros((2, 3, n)))
