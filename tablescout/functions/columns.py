"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top, bottom) -> Column:
    """Division that gives null, not an error, for a zero divisor."""
    return F.try_divide(top, bottom)


def zscore(value, mean, std) -> Column:
    """Distance from the mean in deviations; a constant column scores zero."""
    return F.when(F.col(std) > 0, (F.col(value) - F.col(mean)) / F.col(std)).otherwise(
        F.when(F.col(value).isNotNull(), F.lit(0.0))
    )


def keep_complete(df: DataFrame, cols) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, paired as a balanced tree so that many frames do not nest deeply."""
    while len(frames) > 1:
        frames = [
            frames[i].unionByName(frames[i + 1], allowMissingColumns=True) if i + 1 < len(frames) else frames[i]
            for i in range(0, len(frames), 2)
        ]
    return frames[0]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column, for comparisons across engines."""
    doubles = {f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(doubles) if doubles else df


def adjusted_skewness(skew, n) -> Column:
    """Sample-size adjustment of the population skewness."""
    skew, n = F.col(skew), F.col(n)
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(kurt, n) -> Column:
    """Sample-size adjustment of the population excess kurtosis."""
    kurt, n = F.col(kurt), F.col(n)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
