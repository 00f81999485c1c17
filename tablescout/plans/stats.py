"""One-pass column and column-pair aggregates, returned as tidy rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import union_all

# Widest aggregate emitted as one operator; wider requests become several pruned scans.
COLUMNS_PER_PASS = 50


def column_moments(df: DataFrame, cols, by=()) -> DataFrame:
    """``by..., column, n_rows, n, mean, std, min, max, skew_pop, kurt_pop`` from a single wide aggregate."""
    by, cols = list(by), list(cols)
    if len(cols) > COLUMNS_PER_PASS:
        chunks = [cols[i : i + COLUMNS_PER_PASS] for i in range(0, len(cols), COLUMNS_PER_PASS)]
        return union_all([column_moments(df, chunk, by) for chunk in chunks])
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"_n{i}"),
            F.avg(x).alias(f"_mean{i}"),
            F.stddev_samp(x).alias(f"_std{i}"),
            F.min(x).alias(f"_min{i}"),
            F.max(x).alias(f"_max{i}"),
            F.skewness(x).alias(f"_skew{i}"),
            F.kurtosis(x).alias(f"_kurt{i}"),
        ]
    wide = df.groupBy(*by).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("n_rows"),
            F.col(f"_n{i}").alias("n"),
            F.col(f"_mean{i}").alias("mean"),
            F.col(f"_std{i}").alias("std"),
            F.col(f"_min{i}").alias("min"),
            F.col(f"_max{i}").alias("max"),
            F.col(f"_skew{i}").alias("skew_pop"),
            F.col(f"_kurt{i}").alias("kurt_pop"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def wide_moments(df: DataFrame, cols) -> DataFrame:
    """One row with ``<col>_mean`` and ``<col>_std`` per column, for joining back to every row."""
    aggregates = []
    for c in cols:
        x = F.col(c).cast("double")
        aggregates += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    return df.agg(F.count(F.lit(1)).alias("n_complete"), *aggregates)


def tally(df: DataFrame, cols, limits: DataFrame, conditions) -> DataFrame:
    """``limits`` with one more column per condition: how many values of each column meet it.

    ``limits`` has a row per column and becomes one broadcast row. ``conditions`` maps a name to a
    function of the value and of a look-up of that column's limits. One scan, nothing shuffled.
    """
    cols = list(cols)
    fields = [f for f in limits.columns if f != "column"]
    one_row = limits.groupBy().agg(
        *[F.max(F.when(F.col("column") == c, F.col(f))).alias(f"_{f}_{i}") for i, c in enumerate(cols) for f in fields]
    )
    wide = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]).crossJoin(F.broadcast(one_row))
    counts, rows = [], []
    for i, c in enumerate(cols):
        look = lambda f, i=i: F.col(f"_{f}_{i}")
        counts += [F.count_if(test(F.col(f"_x{i}"), look)).alias(f"_k{i}_{name}") for name, test in conditions.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"_k{i}_{name}").alias(name) for name in conditions]))
    counted = wide.agg(*counts).select(F.inline(F.array(*rows)))
    return limits.join(F.broadcast(counted), "column")


def pair_list(cols) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def pair_statistics(df: DataFrame, pairs, by=()) -> DataFrame:
    """``by..., col_a, col_b, n, r, slope, intercept`` of col_b on col_a over pairwise complete rows.

    All pairs share one pass. The moments are taken about the pair's own complete rows, and a
    constant side gives null instead of a division error.
    """
    by, pairs = list(by), list(pairs)
    if len(pairs) > COLUMNS_PER_PASS:
        chunks = [pairs[i : i + COLUMNS_PER_PASS] for i in range(0, len(pairs), COLUMNS_PER_PASS)]
        return union_all([pair_statistics(df, chunk, by) for chunk in chunks])
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        aggregates += [
            F.regr_count(y, x).alias(f"_n{i}"),
            F.regr_sxx(y, x).alias(f"_sxx{i}"),
            F.regr_syy(y, x).alias(f"_syy{i}"),
            F.regr_sxy(y, x).alias(f"_sxy{i}"),
            F.regr_avgx(y, x).alias(f"_mx{i}"),
            F.regr_avgy(y, x).alias(f"_my{i}"),
        ]
    wide = df.groupBy(*by).agg(*aggregates)
    rows = []
    for i, (a, b) in enumerate(pairs):
        sxx, syy, sxy = F.col(f"_sxx{i}"), F.col(f"_syy{i}"), F.col(f"_sxy{i}")
        slope = F.try_divide(sxy, sxx)
        rows.append(
            F.struct(
                F.lit(a).alias("col_a"),
                F.lit(b).alias("col_b"),
                F.lit(i).alias("pair_order"),
                F.col(f"_n{i}").alias("n"),
                F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)).alias("r"),
                slope.alias("slope"),
                (F.col(f"_my{i}") - slope * F.col(f"_mx{i}")).alias("intercept"),
            )
        )
    return wide.select(*by, F.inline(F.array(*rows)))
