"""Means and centred cross products of many columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into numbers at once.
SLICE_ROWS = 4096
#: Numbers of all partial matrices that the driver merges at the end, and the most matrices.
DRIVER_NUMBERS, DRIVER_PARTS = 4_000_000, 256

_PART = "n long, mean binary, product binary"


@dataclass
class Gram:
    """Complete rows, means and the sums of products of deviations of the named columns."""

    cols: list[str]
    n: int
    mean: np.ndarray
    product: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.product / (self.n - 1) if self.n > 1 else np.full_like(self.product, np.nan)

    @property
    def correlation(self) -> np.ndarray:
        """Correlations; those of a constant column are missing."""
        # A sum of squares that rounding alone can give is that of a constant column.
        scale = np.sqrt(np.where(np.diag(self.product) > 1e-26 * self.n * np.square(self.mean), np.diag(self.product), np.nan))
        out = np.clip(self.product / np.outer(scale, scale), -1, 1)
        np.fill_diagonal(out, np.where(np.isnan(scale), np.nan, 1.0))
        return out


def merged(a: tuple, b: tuple) -> tuple:
    """Two disjoint parts as one; only differences of means are multiplied, so large means lose no digits."""
    (n, x, p), (m, y, q) = a, b
    if not n or not m:
        return b if not n else a
    step = y - x
    return n + m, x + step * (m / (n + m)), p + q + np.outer(step, step) * (n * m / (n + m))


def _of(values: np.ndarray) -> tuple:
    mean = values.mean(axis=0)
    apart = values - mean
    return len(values), mean, apart.T @ apart


def _row(part: tuple) -> list:
    return [pa.array([part[0]], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in part[1:])]


def _read(n: int, mean: bytes, product: bytes) -> tuple:
    mean = np.frombuffer(mean, float)
    return n, mean, np.frombuffer(product, float).reshape(len(mean), len(mean))


def number_rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """A batch of double columns as matrices of at most SLICE_ROWS rows, without rows that miss a value."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
        yield values[~np.isnan(values).any(axis=1)]


def doubles(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(cols.values())))


def features(df: DataFrame, cols) -> dict[str, Column]:
    """Named columns, arrays of numbers as one column for each place, by the length of the first array."""
    out: dict[str, Column] = {}
    for c in cols:
        if df.schema[c].dataType.typeName() == "array":
            first = df.where(F.col(c).isNotNull()).select(F.size(c)).first()
            out |= {f"{c}[{i}]": F.get(c, F.lit(i)) for i in range(first[0] if first else 0)}
        else:
            out[c] = F.col(c)
    return out


def gram(df: DataFrame, cols) -> Gram:
    """The Gram matrix of ``cols`` (numbers or arrays of numbers) over rows that have them all.

    Each task folds its batches into one matrix and hands on that alone. Matrices of tasks are merged by Spark in
    groups, so that the driver merges at most DRIVER_PARTS, fewer where matrices are large.
    """
    named = features(df, cols)
    width = len(named)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (0, np.zeros(width), np.zeros((width, width)))
        for batch in batches:
            for values in number_rows(batch):
                if len(values):
                    part = merged(part, _of(values))
        if part[0]:
            yield pa.RecordBatch.from_arrays(_row(part), ["n", "mean", "product"])

    def together(parts):
        out = (0, np.zeros(width), np.zeros((width, width)))
        for row in zip(parts["n"], parts["mean"], parts["product"]):
            out = merged(out, _read(*row))
        return out

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("mean", "ascending")])
        return pa.Table.from_arrays(_row(together(table.select(["n", "mean", "product"]).to_pydict())), ["n", "mean", "product"])

    groups = int(max(1, min(DRIVER_PARTS, DRIVER_NUMBERS // max(1, width * width))))
    parts = doubles(df, named).mapInArrow(fold, _PART).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
    rows = parts.groupBy("part").applyInArrow(join, _PART).collect()
    rows = sorted((r["n"], bytes(r["mean"]), bytes(r["product"])) for r in rows)
    return Gram(list(named), *together(dict(zip(("n", "mean", "product"), zip(*rows)))) if rows else (0, np.full(width, np.nan), np.full((width, width), np.nan)))
