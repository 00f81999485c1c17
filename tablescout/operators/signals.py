"""Cheap screens that suggest where a full analysis would pay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import keep_complete, ratio
from tablescout.operators.business import gini
from tablescout.operators.timeseries import split_rows, time_positions
from tablescout.plans.counts import distinct_counts
from tablescout.plans.ranks import quantile, ranked_values
from tablescout.plans.stats import column_moments, pair_list, pair_statistics, tally, wide_moments
from tablescout.sources.tables import time_micros, with_time

DAY_MICROS = 86_400_000_000


def null_intent(df: DataFrame, numeric=()) -> DataFrame:
    """``column, null_rate, overlap_rate, pattern`` of columns with one percent nulls or more.

    A column is systematic when over 70 % of its nulls fall on rows where the first other numeric
    column is null as well.
    """
    numeric = list(numeric)
    cols = [r for r in df.columns]
    counts, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, c in enumerate(cols):
        other = next((n for n in numeric if n != c), None)
        counts.append(F.count_if(F.col(c).isNull()).alias(f"_n{i}"))
        both = F.count_if(F.col(c).isNull() & F.col(other).isNull()) if other else F.count_if(F.lit(False))
        counts.append(both.alias(f"_b{i}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("ordinal"),
                ratio(F.col(f"_n{i}"), F.col("_rows")).alias("null_rate"),
                ratio(F.col(f"_b{i}"), F.col(f"_n{i}")).alias("overlap_rate"),
            )
        )
    return (
        df.agg(*counts)
        .select(F.inline(F.array(*rows)))
        .where(F.col("null_rate") >= 0.01)
        .withColumn("pattern", F.when(F.col("overlap_rate") > 0.7, "systematic").otherwise("distributed"))
    )


def outlier_prevalence(df: DataFrame, cols) -> DataFrame:
    """``column, extreme_pct``: share of values beyond three deviations (ten values or more, not constant)."""
    limits = column_moments(df, cols).where((F.col("n") >= 10) & (F.col("std") > 0)).select("column", "n", "mean", "std")
    counted = tally(df, cols, limits, {"_far": lambda v, at: F.abs(ratio(v - at("mean"), at("std"))) > 3})
    return counted.select("column", (F.col("_far") / F.col("n")).alias("extreme_pct"))


def correlation_opportunity(df: DataFrame, cols, min_abs: float = 0.5, top: int | None = None) -> DataFrame:
    """``col_a, col_b, r`` of strong pairs over rows complete in all columns (five or more), names in order."""
    cols = sorted(cols)
    strong = (
        pair_statistics(keep_complete(df, cols), pair_list(cols))
        .where((F.col("n") >= 5) & (F.abs("r") > min_abs))
        .orderBy(F.abs(F.round("r", 3)).desc(), "pair_order")
    )
    return (strong.limit(top) if top else strong).select("col_a", "col_b", "r")


def segment_variables(df: DataFrame, metric: str, cols, min_spread: float = 0.2) -> DataFrame:
    """``segment_col, metric_col, n_groups, relative_spread`` of categories (2 to 20 values) whose means differ."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    value = F.col(metric).cast("double")
    groups = (
        df.select(value.alias("_x"), F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("_c", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("_c", "value")
        .agg(F.avg("_x").alias("_m"))
    )
    overall = df.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std")).where(F.coalesce("_std", F.lit(1.0)) != 0)
    divisor = F.when(F.coalesce("_mean", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_mean"))
    return (
        groups.groupBy("_c")
        .agg(F.count(F.lit(1)).alias("n_groups"), (F.max("_m") - F.min("_m")).alias("_spread"))
        .where((F.col("n_groups") >= 2) & (F.col("n_groups") <= 20))
        .crossJoin(F.broadcast(overall))
        .select(
            F.element_at(names, F.col("_c") + 1).alias("segment_col"),
            F.lit(metric).alias("metric_col"),
            "n_groups",
            (F.col("_spread") / divisor).alias("relative_spread"),
        )
        .where(F.col("relative_spread") > min_spread)
    )


def temporal_coverage(df: DataFrame, ts: str) -> DataFrame:
    """One row, ``date_min, date_max, span_days, granularity, gap_count``; needs two dated rows.

    Rows shrink to distinct times; repeated times add zero gaps to the median by their count.
    """
    dated = with_time(df, ts).select(time_micros(ts).alias("_us"))
    times = dated.groupBy("_us").agg(F.count(F.lit(1)).alias("cnt"))
    placed = time_positions(times)
    following = placed.select(F.col("before").alias("_at"), F.col("_us").alias("_next"))
    steps = (
        placed.join(following, F.col("before") + F.col("cnt") == F.col("_at"))
        .groupBy((F.col("_next") - F.col("_us")).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    zeros = times.agg(F.sum(F.col("cnt") - 1).alias("cnt")).where(F.col("cnt") > 0).select(F.lit(0.0).alias("value"), "cnt")
    gaps = steps.unionByName(zeros).withColumn("column", F.lit("gap"))
    median = ranked_values(gaps).agg(quantile(0.5).alias("_median"))
    wide = (
        gaps.crossJoin(F.broadcast(median))
        .groupBy()
        .agg(
            F.max("_median").alias("_median"),
            F.coalesce(F.sum(F.when(F.col("value") > 3 * F.col("_median"), F.col("cnt"))), F.lit(0)).alias("gap_count"),
        )
    )
    ends = times.agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"))
    day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / DAY_MICROS).cast("int"))
    days = F.floor(F.col("_median") / DAY_MICROS)
    return (
        wide.where(F.col("_median").isNotNull())
        .crossJoin(F.broadcast(ends))
        .select(
            F.lit(ts).alias("date_col"),
            day("_a").cast("string").alias("date_min"),
            day("_b").cast("string").alias("date_max"),
            F.datediff(day("_b"), day("_a")).cast("long").alias("span_days"),
            F.when(days <= 1, "daily").when(days <= 8, "weekly").when(days <= 32, "monthly").otherwise("irregular").alias("granularity"),
            "gap_count",
        )
    )


def concentration_screen(df: DataFrame, cols) -> DataFrame:
    """``column, gini`` of columns with ten values or more and none negative."""
    return gini(df, cols).where((F.col("n") >= 10) & (F.col("smallest") >= 0)).select("column", "gini")


def growth_signal(df: DataFrame, ts: str, cols, tie_breakers=()) -> DataFrame:
    """``column, early_mean, late_mean, pct_change`` between the first and last quarter of the rows by time."""
    cols = list(cols)
    quarter = F.floor(F.col("n_rows") / 4)
    placed = split_rows(df, ts, cols, tie_breakers, {"_early": quarter, "_before_late": F.col("n_rows") - quarter})
    counts = [F.count(F.lit(1)).alias("_rows")]
    rows = []
    for i, c in enumerate(cols):
        value = F.col(c).cast("double")
        counts += [
            F.avg(F.when(F.col("_early"), value)).alias(f"_e{i}"),
            F.avg(F.when(~F.col("_before_late"), value)).alias(f"_l{i}"),
        ]
        rows.append(
            F.struct(F.lit(c).alias("column"), F.col(f"_e{i}").alias("early_mean"), F.col(f"_l{i}").alias("late_mean"))
        )
    return (
        placed.agg(*counts)
        .where(F.col("_rows") >= 10)
        .select(F.inline(F.array(*rows)))
        .where((F.col("early_mean") != 0) & F.col("late_mean").isNotNull())
        .withColumn("pct_change", (F.col("late_mean") - F.col("early_mean")) / F.abs("early_mean"))
    )


def max_abs_z(df: DataFrame, cols) -> DataFrame:
    """Complete rows with ``max_abs_z``; needs twenty complete rows."""
    cols = list(cols)
    rows = keep_complete(df, cols)
    limits = wide_moments(rows, cols).where(F.col("n_complete") >= 20)
    z = [F.abs((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + F.lit(1e-9))) for c in cols]
    drop = ["n_complete", *[f"{c}_mean" for c in cols], *[f"{c}_std" for c in cols]]
    return rows.crossJoin(F.broadcast(limits)).withColumn("max_abs_z", F.greatest(*z)).drop(*drop)


def anomaly_prevalence(df: DataFrame, cols) -> DataFrame:
    """One row, ``anomaly_rate``: share of complete rows with some metric beyond three deviations."""
    return (
        max_abs_z(df, cols)
        .groupBy()
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("max_abs_z") > 3).alias("_k"))
        .where(F.col("_n") > 0)
        .select((F.col("_k") / F.col("_n")).alias("anomaly_rate"))
    )


def cardinality_screen(df: DataFrame, cols) -> DataFrame:
    """``column, unique_count, unique_ratio, label``."""
    share = ratio(F.col("unique_count"), F.col("n_rows"))
    return distinct_counts(df, cols).select(
        "column",
        "unique_count",
        share.alias("unique_ratio"),
        F.when(share > 0.8, "near-unique")
        .when(F.col("unique_count") == 1, "constant")
        .when(F.col("unique_count") <= 10, "low cardinality")
        .otherwise("medium cardinality")
        .alias("label"),
    )
