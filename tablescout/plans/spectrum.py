"""Discrete Fourier transform of series of any length.

Series up to a million values are transformed whole, each in one task. A longer transform, of length
``rows * columns``, is a transform of every column, a rotation, and a transform of every row: two groupings,
each group about the square root of the series. Lengths without a divisor near their root go through the chirp
identity, which turns them into transforms of a power of two.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import union_all

# Longest transform one task computes by itself.
GROUP_LIMIT = 1 << 20

_SCHEMA = "metric string, j long, re double, im double"


# Rows and columns may differ by this factor; further apart, one grouping would have tiny groups.
UNBALANCED = 8


def _divisor(n: int) -> int | None:
    """The divisor nearest below the square root, if it is not far from it."""
    root = math.isqrt(n)
    for d in range(root, 0, -1):
        if n // d > UNBALANCED * d:
            return None
        if n % d == 0:
            return d
    return None


def _squares(j: np.ndarray, modulus: int) -> np.ndarray:
    """j * j modulo a number below 2**41, in halves of 20 bits that never overflow."""
    high, low = j >> 20, j & 0xFFFFF
    return (((high * j) % modulus << 20) + low * j) % modulus


def _turn(numerator: np.ndarray, denominator: int, sign: int) -> np.ndarray:
    """Unit roots exp(sign * 2 pi i * numerator / denominator), reduced exactly before the float step."""
    return np.exp(sign * 2j * np.pi * (numerator % denominator) / denominator)


def _vector(index: pd.Series, frame: pd.DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=complex)
    out[index.to_numpy()] = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
    return out


def _dft(vector: np.ndarray, sign: int) -> np.ndarray:
    return np.fft.fft(vector) if sign < 0 else np.fft.ifft(vector) * len(vector)


def _by_columns(values: DataFrame, rows: int, columns: int, sign: int) -> DataFrame:
    """The first half of a transform: that of every column, turned."""

    def by_column(frame: pd.DataFrame) -> pd.DataFrame:
        column = int(frame["j"].iloc[0] % columns)
        at = np.arange(rows, dtype=np.int64)
        out = _dft(_vector(frame["j"] // columns, frame, rows), sign) * _turn(at * column, rows * columns, sign)
        return pd.DataFrame({"metric": frame["metric"].iloc[0], "j": at * columns + column, "re": out.real, "im": out.imag})

    return values.groupBy("metric", (F.col("j") % columns).alias("_column")).applyInPandas(by_column, _SCHEMA)


def _by_columns_real(values: DataFrame, rows: int, columns: int) -> DataFrame:
    """The first half of a transform of the real numbers ``metric, j, re``: the upper rows mirror the lower ones and are left out."""

    def by_column(frame: pd.DataFrame) -> pd.DataFrame:
        column = int(frame["j"].iloc[0] % columns)
        vector = np.zeros(rows)
        vector[(frame["j"] // columns).to_numpy()] = frame["re"].to_numpy()
        at = np.arange(rows // 2 + 1, dtype=np.int64)
        out = np.fft.rfft(vector) * _turn(at * column, rows * columns, -1)
        return pd.DataFrame({"metric": frame["metric"].iloc[0], "j": at * columns + column, "re": out.real, "im": out.imag})

    return values.groupBy("metric", (F.col("j") % columns).alias("_column")).applyInPandas(by_column, _SCHEMA)


def _transform(values: DataFrame, rows: int, columns: int, sign: int) -> DataFrame:
    """Transform ``metric, j, re, im`` of length ``rows * columns``; absent positions are zeros."""

    def by_row(frame: pd.DataFrame) -> pd.DataFrame:
        row = int(frame["j"].iloc[0] // columns)
        out = _dft(_vector(frame["j"] % columns, frame, columns), sign)
        at = np.arange(columns, dtype=np.int64)
        return pd.DataFrame({"metric": frame["metric"].iloc[0], "j": row + rows * at, "re": out.real, "im": out.imag})

    turned = _by_columns(values, rows, columns, sign)
    return turned.groupBy("metric", F.floor(F.col("j") / columns).alias("_row")).applyInPandas(by_row, _SCHEMA)


def _strongest(turned: DataFrame, rows: int, columns: int, sign: int, n: int, mirrored: bool) -> DataFrame:
    """``metric, k, size``: the largest number of each row of the second half, among frequencies 1 to n // 2; only one
    row leaves a group. If ``mirrored``, a frequency above the half stands for the one it mirrors."""

    def by_row(frame: pd.DataFrame) -> pd.DataFrame:
        row = int(frame["j"].iloc[0] // columns)
        size = np.abs(_dft(_vector(frame["j"] % columns, frame, columns), sign))
        k = row + rows * np.arange(columns, dtype=np.int64)
        k = np.minimum(k, n - k) if mirrored else k
        held = (k >= 1) & (k <= n // 2)
        if not held.any():
            return pd.DataFrame(columns=["metric", "k", "size"])
        size, k = size[held], k[held]
        top = size.max()
        return pd.DataFrame({"metric": frame["metric"].iloc[:1].to_numpy(), "k": [int(k[size == top].min())], "size": [float(top)]})

    return turned.groupBy("metric", F.floor(F.col("j") / columns).alias("_row")).applyInPandas(by_row, "metric string, k long, size double")


def _chirp(values: DataFrame, n: int) -> DataFrame:
    """Largest numbers of the transform of any length n, as a circular convolution of a power-of-two length."""
    bits = (2 * n - 1).bit_length()
    rows, columns = 1 << (bits // 2), 1 << (bits - bits // 2)
    length = rows * columns

    def phase(j: pd.Series, sign: int) -> np.ndarray:
        return _turn(_squares(j.to_numpy(dtype=np.int64), 2 * n), 2 * n, sign)

    def weigh(batches):
        for b in batches:
            w = b["re"].to_numpy() * phase(b["j"], -1)
            yield pd.DataFrame({"metric": b["metric"], "j": b["j"], "re": w.real, "im": w.imag})

    def kernel(batches):
        for b in batches:
            w = phase(b["id"], 1)
            at = b["id"].to_numpy()
            yield pd.DataFrame({"metric": "", "j": at, "re": w.real, "im": w.imag})
            back = at > 0
            yield pd.DataFrame({"metric": "", "j": length - at[back], "re": w.real[back], "im": w.imag[back]})

    series = _transform(values.mapInPandas(weigh, _SCHEMA), rows, columns, -1)
    filter_ = _transform(values.sparkSession.range(n).mapInPandas(kernel, _SCHEMA), rows, columns, -1)
    filter_ = filter_.select("j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = series.join(filter_, "j").select(
        "metric",
        "j",
        (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"),
        (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"),
    )
    back = _strongest(_by_columns(product, rows, columns, 1), rows, columns, 1, n, False)
    return back.withColumn("size", F.col("size") / length)


def dominant_frequency(values: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """``metric, n, dominant_k, magnitude`` of ``metric, idx, n, value`` rows; the constant term is ignored.

    Series lengths are looked up first: one number per metric.
    """
    lengths = {r["metric"]: r["n"] for r in values.groupBy("metric").agg(F.max("n").alias("n")).collect()}
    rows = values.select("metric", "n", F.col("idx").alias("j"), F.col("value").alias("re"))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        size = np.abs(np.fft.rfft(frame.sort_values("j")["re"].to_numpy()))[1:]
        k = int(np.argmax(size)) + 1
        return pd.DataFrame({"metric": frame["metric"].iloc[:1], "n": [len(frame)], "dominant_k": [k], "magnitude": [size[k - 1]]})

    schema = "metric string, n long, dominant_k long, magnitude double"
    parts = []
    # A branch without series would still put all values in order.
    if not lengths or min(lengths.values()) <= limit:
        parts.append(rows.where(F.col("n") <= limit).groupBy("metric").applyInPandas(whole, schema))
    for n in sorted({n for n in lengths.values() if n > limit}):
        alike = rows.where(F.col("n") == n).select("metric", "j", "re")
        factor = _divisor(n)
        if factor:
            tops = _strongest(_by_columns_real(alike, factor, n // factor), factor, n // factor, -1, n, True)
        else:
            tops = _chirp(alike, n)
        best = F.min_by(F.struct("k", "size"), F.struct((-F.col("size")).alias("m"), F.col("k")))
        parts.append(
            tops.groupBy("metric")
            .agg(best.alias("_top"))
            .select("metric", F.lit(n).cast("long").alias("n"), F.col("_top.k").alias("dominant_k"), F.col("_top.size").alias("magnitude"))
        )
    return union_all(parts)
