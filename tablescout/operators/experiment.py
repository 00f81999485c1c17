"""Comparisons of two groups: shares, ranks, and intervals by resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio
from tablescout.functions.tails import chi2_upper
from tablescout.plans.ranks import ranked_values


def _sides(df: DataFrame, group: str, a, b) -> DataFrame:
    return df.where(F.col(group).isin(a, b)).withColumn("_a", F.col(group) == F.lit(a))


def share_test(df: DataFrame, group: str, success: str, a, b) -> DataFrame:
    """``n_a, n_b, share_a, share_b, difference, z, p_value`` of the share of rows with a true ``success``, pooled."""
    rows = _sides(df, group, a, b).where(F.col(success).isNotNull())
    hit = F.col(success).cast("boolean")
    counts = rows.agg(
        F.count_if("_a").alias("n_a"), F.count_if(~F.col("_a")).alias("n_b"), F.count_if(F.col("_a") & hit).alias("k_a"), F.count_if(~F.col("_a") & hit).alias("k_b")
    ).where("n_a > 0 AND n_b > 0")
    pooled = (F.col("k_a") + F.col("k_b")) / (F.col("n_a") + F.col("n_b"))
    out = counts.withColumns({"share_a": F.col("k_a") / F.col("n_a"), "share_b": F.col("k_b") / F.col("n_b"), "_p": pooled})
    out = out.withColumn("difference", F.col("share_a") - F.col("share_b"))
    spread = F.sqrt(F.col("_p") * (1 - F.col("_p")) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = out.withColumn("z", ratio(F.col("difference"), spread))
    return out.select("n_a", "n_b", "share_a", "share_b", "difference", "z", chi2_upper(F.col("z") * F.col("z"), F.lit(1.0)).alias("p_value"))


def rank_sum(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """``n_a, n_b, u, superiority, z, p_value``: rank-sum test of group ``a`` against ``b`` with ties corrected.

    ``u`` counts the pairs of rows in which that of ``a`` is larger, equal ones for a half; ``superiority`` is their share.
    Rows become distinct values with their counts in both groups before they are ranked, so a hot value is one row.
    """
    rows = _sides(df, group, a, b).where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"), "_a")
    both = rows.groupBy("value").agg(F.count_if("_a").alias("_k"), F.count(F.lit(1)).alias("cnt"))
    ranked = ranked_values(both.select(F.lit(value).alias("column"), "value", "cnt"))
    ranked = ranked.select("value", "cnt", (F.col("before") + (F.col("cnt") + 1) / 2).alias("_rank"))
    sums = ranked.join(both.select("value", "_k"), "value").agg(
        F.sum("_k").alias("n_a"),
        F.sum(F.col("cnt") - F.col("_k")).alias("n_b"),
        F.sum(F.col("_k") * F.col("_rank")).alias("_r"),
        F.sum(F.col("cnt").cast("double") * F.col("cnt") * F.col("cnt") - F.col("cnt")).alias("_ties"),
    )
    sums = sums.where("n_a > 0 AND n_b > 0")
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("_r") - n * (n + 1) / 2
    spread = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("_ties") / ((n + m) * (n + m - 1))))
    out = sums.select("n_a", "n_b", u.alias("u"), (u / (n * m)).alias("superiority"), ratio(u - n * m / 2, spread).alias("z"))
    return out.withColumn("p_value", chi2_upper(F.col("z") * F.col("z"), F.lit(1.0)))


#: By running totals: how often a row is drawn, for a uniform number below each.
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(18)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def resampled_difference(df: DataFrame, group: str, value: str, a, b, keys, draws: int = 400, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``n_a, n_b, difference, low, high``: difference of means with the interval of ``draws`` resamplings.

    Each row is drawn a Poisson number of times in each resampling, which needs no count of rows and one scan for all
    of them. The number follows from a hash of the row's ``keys`` (columns that tell rows apart) and the resampling, so
    the interval does not depend on how the rows are dealt to tasks. Tasks hand on one sum and count per group and draw.
    """
    rows = _sides(df, group, a, b).where(F.col(value).isNotNull())
    rows = rows.select(F.col("_a").cast("int").alias("side"), F.col(value).cast("double").alias("v"), F.xxhash64(*keys, F.lit(seed)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, draws + 1, 2))
        for batch in batches:
            side, v, h = (batch.column(i).to_numpy() for i in range(3))
            h = h.view(np.uint64)
            for draw in range(draws + 1):
                if draw == draws:  # the rows as they are
                    times = np.ones(len(v))
                else:
                    u = (_mixed(h + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)
                    times = np.searchsorted(_POISSON, u, side="right").astype(float)
                total[:, draw, 0] += np.bincount(side, times, 2)
                total[:, draw, 1] += np.bincount(side, times * v, 2)
        sides, at = np.divmod(np.arange(2 * (draws + 1)), draws + 1)
        columns = [pa.array(sides, pa.int32()), pa.array(at, pa.int32()), pa.array(total[:, :, 0].ravel()), pa.array(total[:, :, 1].ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["side", "draw", "n", "s"])

    sums = rows.mapInArrow(run, "side int, draw int, n double, s double").groupBy("draw").agg(
        *(F.sum(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}") for side in (0, 1) for c in ("n", "s"))
    )
    sums = sums.select("draw", "n0", "n1", (ratio(F.col("s1"), F.col("n1")) - ratio(F.col("s0"), F.col("n0"))).alias("d"))
    drawn, whole = F.when(F.col("draw") < draws, F.col("d")), F.col("draw") == draws
    edge = (1 - level) / 2
    return sums.agg(
        F.max(F.when(whole, F.col("n1"))).cast("long").alias("n_a"),
        F.max(F.when(whole, F.col("n0"))).cast("long").alias("n_b"),
        F.max(F.when(whole, F.col("d"))).alias("difference"),
        F.percentile(drawn, F.lit(edge)).alias("low"),
        F.percentile(drawn, F.lit(1 - edge)).alias("high"),
    ).where("n_a > 0 AND n_b > 0")
