"""Percentiles, composite scores, tiers and winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import keep_complete, ratio, zscore
from tablescout.plans.ranks import attach_ranks, average_ranks, quantiles, value_counts
from tablescout.plans.stats import tally, wide_moments


def percentile_ranking(df: DataFrame, cols) -> DataFrame:
    """``column, p90_threshold, p10_threshold, top_10pct_count, bottom_10pct_count``."""
    points = quantiles(df, cols, {"p90_threshold": 0.9, "p10_threshold": 0.1}).drop("n")
    return tally(
        df,
        cols,
        points,
        {
            "top_10pct_count": lambda v, at: v >= at("p90_threshold"),
            "bottom_10pct_count": lambda v, at: v <= at("p10_threshold"),
        },
    )


def with_percentile_rank(df: DataFrame, col: str, name: str = "pct_rank") -> DataFrame:
    """The input rows with the average-tie rank of ``col`` divided by its number of values."""
    return attach_ranks(df, col, average_ranks(value_counts(df, [col])), F.col("avg_rank") / F.col("n"), name)


def composite_scores(df: DataFrame, cols) -> DataFrame:
    """Complete rows with ``score``, the mean of their z-scores; needs four complete rows."""
    cols = list(cols)
    rows = keep_complete(df, cols)
    scored = rows.crossJoin(F.broadcast(wide_moments(rows, cols).where(F.col("n_complete") >= 4)))
    total = sum((zscore(c, f"{c}_mean", f"{c}_std") for c in cols[1:]), zscore(cols[0], f"{cols[0]}_mean", f"{cols[0]}_std"))
    drop = ["n_complete", *[f"{c}_mean" for c in cols], *[f"{c}_std" for c in cols]]
    return scored.withColumn("score", total / len(cols)).drop(*drop)


def composite_score(df: DataFrame, cols) -> DataFrame:
    """``n, p90_threshold, p10_threshold, top_10pct_count, min_score, max_score``."""
    scored = composite_scores(df, cols).select("score")
    points = quantiles(scored, ["score"], {"p90_threshold": 0.9, "p10_threshold": 0.1})
    limits = points.select("p90_threshold", "p10_threshold")
    return scored.crossJoin(F.broadcast(limits)).groupBy().agg(
        F.count(F.lit(1)).alias("n"),
        F.max("p90_threshold").alias("p90_threshold"),
        F.max("p10_threshold").alias("p10_threshold"),
        F.count_if(F.col("score") >= F.col("p90_threshold")).alias("top_10pct_count"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def top_bottom(df: DataFrame, by, others) -> DataFrame:
    """``by_col, other_col, top_mean, bottom_mean, ratio``: top against bottom decile of each ``by`` column."""
    by, others = list(by), list(others)
    points = quantiles(df, by, {"p90": 0.9, "p10": 0.1}).where(F.col("n") >= 10)
    limits = points.groupBy().agg(
        *[F.max(F.when(F.col("column") == c, F.col("p90"))).alias(f"_hi{i}") for i, c in enumerate(by)],
        *[F.max(F.when(F.col("column") == c, F.col("p10"))).alias(f"_lo{i}") for i, c in enumerate(by)],
    )
    means, rows = [], []
    for i, c in enumerate(by):
        for j, o in enumerate(others):
            if o == c:
                continue
            value = F.col(o).cast("double")
            means += [
                F.avg(F.when(F.col(c) >= F.col(f"_hi{i}"), value)).alias(f"_t{i}_{j}"),
                F.avg(F.when(F.col(c) <= F.col(f"_lo{i}"), value)).alias(f"_b{i}_{j}"),
            ]
            rows.append(
                F.struct(
                    F.lit(c).alias("by_col"),
                    F.lit(o).alias("other_col"),
                    F.col(f"_t{i}_{j}").alias("top_mean"),
                    F.col(f"_b{i}_{j}").alias("bottom_mean"),
                )
            )
    wide = df.select(*dict.fromkeys([*by, *others])).crossJoin(F.broadcast(limits)).agg(*means)
    return (
        wide.select(F.inline(F.array(*rows)))
        .where(F.col("top_mean").isNotNull() & (F.col("bottom_mean") != 0))
        .withColumn("ratio", ratio(F.col("top_mean"), F.col("bottom_mean")))
    )


def _tier():
    return (
        F.when(F.col("value") < F.col("low_threshold"), "low")
        .when(F.col("value") < F.col("high_threshold"), "mid")
        .when(F.col("value").isNotNull(), "high")
    )


def _tier_limits(df: DataFrame, cols) -> DataFrame:
    points = quantiles(df, cols, {"low_threshold": 0.33, "high_threshold": 0.67})
    return points.where(F.col("n") >= 6)


def tiers(df: DataFrame, cols) -> DataFrame:
    """``column, low_threshold, high_threshold`` with the count and share of each tier."""
    counted = tally(
        df,
        cols,
        _tier_limits(df, cols),
        {
            "low_count": lambda v, at: v < at("low_threshold"),
            "mid_count": lambda v, at: (v >= at("low_threshold")) & (v < at("high_threshold")),
            "high_count": lambda v, at: v >= at("high_threshold"),
        },
    )
    return counted.withColumns({f"{t}_pct": F.col(f"{t}_count") / F.col("n") for t in ("low", "mid", "high")}).drop("n")


def with_tier(df: DataFrame, col: str, name: str = "tier") -> DataFrame:
    """The input rows labelled low, mid or high by the column's 33rd and 67th percentile."""
    limits = _tier_limits(df, [col]).select("low_threshold", "high_threshold")
    return (
        df.withColumn("value", F.col(col).cast("double"))
        .crossJoin(F.broadcast(limits))
        .withColumn(name, _tier())
        .drop("value", "low_threshold", "high_threshold")
    )


def winners_losers(growth: DataFrame, subject="metric", top: int = 2) -> DataFrame:
    """``subject, total_pct_change, rank, verdict`` from a growth table, largest change first.

    With one row per metric the table is small; ranking entities takes ``entity_winners_losers``.
    """
    ordered = Window.orderBy(F.col("total_pct_change").desc(), subject)
    ranked = growth.select(subject, "total_pct_change", F.row_number().over(ordered).alias("rank"))
    worst = F.row_number().over(Window.orderBy(F.col("total_pct_change").asc(), F.col(subject).desc()))
    return (
        ranked.withColumn("_worst", worst)
        .withColumn(
            "verdict",
            F.when((F.col("rank") <= top) & (F.col("total_pct_change") > 0), "winner")
            .when((F.col("_worst") <= top) & (F.col("total_pct_change") < 0), "loser")
            .otherwise("neutral"),
        )
        .drop("_worst")
    )


def entity_winners_losers(growth: DataFrame, entity: str, top: int = 2) -> DataFrame:
    """The ``top`` growing and shrinking entities of a keyed growth table, by top-k selection without a full sort."""
    rising = growth.where(F.col("total_pct_change") > 0).orderBy(F.col("total_pct_change").desc(), entity).limit(top)
    falling = growth.where(F.col("total_pct_change") < 0).orderBy("total_pct_change", F.col(entity).desc()).limit(top)
    keep = [entity, "metric", "total_pct_change"]
    return (
        rising.select(*keep, F.lit("winner").alias("verdict")).unionByName(falling.select(*keep, F.lit("loser").alias("verdict")))
    )
