"""Concentration, cohorts, funnels and decompositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio, zscore
from tablescout.plans.counts import category_counts
from tablescout.plans.ranks import ranked_values, value_counts
from tablescout.plans.stats import column_moments, tally
from tablescout.sources.tables import with_time


def _amounts(df: DataFrame, cols, entity: str | None) -> DataFrame:
    """Rows, or one row per entity with its totals."""
    if entity is None:
        return df
    return df.groupBy(entity).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols])


def pareto(df: DataFrame, cols, entity: str | None = None) -> DataFrame:
    """``column, n, top_20pct_share, pct_rows_for_80pct, gini`` over positive values (four or more).

    Computed on distinct values with counts: a value's copies contribute one closed-form block.
    """
    counts = value_counts(_amounts(df, cols, entity), cols).where(F.col("value") > 0)
    ranked = ranked_values(counts, descending=True)
    v, c, before, n, total = (F.col(x) for x in ("value", "cnt", "before", "n", "total"))
    head = F.floor(n * F.lit(0.2))
    taken = F.least(F.greatest(head - before, F.lit(0)), c)
    room = F.floor((total * F.lit(0.8) - F.col("sum_before")) / v)
    fitting = F.least(F.greatest(room, F.lit(0)), c)
    # Ranks run downwards here: the rank sum of a block counts from the largest value.
    rank_sum = c * before + c * (c + 1) / 2
    return (
        ranked.groupBy("column")
        .agg(
            F.max(n).alias("n"),
            F.max(total).alias("_total"),
            F.sum(taken * v).alias("_head"),
            F.sum(fitting).alias("_fit"),
            F.sum(rank_sum * v).alias("_ranked"),
        )
        .where(n >= 4)
        .select(
            "column",
            "n",
            (F.col("_head") / F.col("_total")).alias("top_20pct_share"),
            (F.col("_fit") / n).alias("pct_rows_for_80pct"),
            (((n + 1) * F.col("_total") - 2 * F.col("_ranked")) / (n * F.col("_total"))).alias("gini"),
        )
    )


def gini(df: DataFrame, cols) -> DataFrame:
    """``column, n, smallest, gini`` with zeros kept; zero for an all-zero column."""
    ranked = ranked_values(value_counts(df, cols))
    v, c, n, total = F.col("value"), F.col("cnt"), F.col("n"), F.col("total")
    rank_sum = c * F.col("before") + c * (c + 1) / 2
    return (
        ranked.groupBy("column")
        .agg(F.max(n).alias("n"), F.max(total).alias("_total"), F.sum(rank_sum * v).alias("_ranked"), F.min(v).alias("smallest"))
        .select(
            "column",
            "n",
            "smallest",
            F.coalesce(ratio(2 * F.col("_ranked") - (n + 1) * F.col("_total"), n * F.col("_total")), F.lit(0.0)).alias("gini"),
        )
    )


def concentration(df: DataFrame, cols, entity: str | None = None) -> DataFrame:
    """``column, n, hhi, cr5, hhi_label`` over positive values (four or more)."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    amounts = F.array(*[F.col(c).cast("double") for c in cols])
    positive = _amounts(df, cols, entity).select(F.posexplode(amounts).alias("_c", "x")).where(F.col("x") > 0)
    sums = positive.groupBy("_c").agg(F.count("x").alias("n"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    # Spark keeps five rows of a column in each task before any of them move.
    largest = F.row_number().over(Window.partitionBy("_c").orderBy(F.col("x").desc()))
    top = positive.withColumn("_r", largest).where(F.col("_r") <= 5).groupBy("_c").agg(F.sum("x").alias("_top"))
    shares = sums.where(F.col("n") >= 4).join(F.broadcast(top), "_c").select(
        F.element_at(names, F.col("_c") + 1).alias("column"),
        "n",
        (F.col("_q") / (F.col("_s") * F.col("_s"))).alias("hhi"),
        (F.col("_top") / F.col("_s")).alias("cr5"),
    )
    hhi = F.col("hhi")
    label = F.when(hhi > 0.25, "highly concentrated").when(hhi > 0.1, "moderately concentrated").otherwise("competitive")
    return shares.withColumn("hhi_label", label)


def cohorts(df: DataFrame, ts: str, metric: str) -> DataFrame:
    """``cohort, cnt, avg_metric`` by the calendar month of each row; no rows below two months."""
    monthly = (
        with_time(df, ts)
        .groupBy(F.date_format(ts, "yyyy-MM").alias("cohort"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.avg(F.col(metric).cast("double")).alias("avg_metric"))
    )
    enough = monthly.agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 2)
    return monthly.crossJoin(F.broadcast(enough)).drop("_k")


def cohorts_by_entity(df: DataFrame, ts: str, entity: str) -> DataFrame:
    """``cohort, period, active, retention``: entities by first month, and how many return months later.

    Rows shrink to distinct entity-months first; an entity's first month is then a window over those.
    """
    months = (
        with_time(df, ts)
        .where(F.col(entity).isNotNull())
        .select(entity, (F.year(ts) * 12 + F.month(ts) - 1).alias("_m"))
        .distinct()
    )
    first = F.min("_m").over(Window.partitionBy(entity))
    counted = months.withColumn("_first", first).groupBy("_first", (F.col("_m") - F.col("_first")).alias("period")).agg(
        F.count(F.lit(1)).alias("active")
    )
    size = F.max(F.when(F.col("period") == 0, F.col("active"))).over(Window.partitionBy("_first"))
    year, month = F.floor(F.col("_first") / 12), F.pmod(F.col("_first"), F.lit(12)) + 1
    return counted.select(
        F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")).alias("cohort"),
        "period",
        "active",
        (F.col("active") / size).alias("retention"),
    )


def retention(cohort_table: DataFrame) -> DataFrame:
    """``cohort, retention_rate``: each cohort's size over the largest, for three cohorts or more."""
    facts = cohort_table.agg(F.max("cnt").alias("_max"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 3)
    return cohort_table.crossJoin(F.broadcast(facts)).select(
        "cohort", F.round(F.col("cnt") / F.col("_max"), 4).alias("retention_rate")
    )


def ltv(cohort_table: DataFrame, retention_table: DataFrame, periods: int = 12) -> DataFrame:
    """``ltv_estimate, avg_metric_per_period, periods_used`` from the first retention rates in cohort order."""
    means = cohort_table.select(F.round("avg_metric", 4).alias("m")).agg(F.avg(F.when(F.col("m") != 0, F.col("m"))).alias("_avg"))
    first = retention_table.orderBy("cohort").limit(periods)
    rates = first.agg(F.sum("retention_rate").alias("_r"), F.count(F.lit(1)).alias("periods_used"))
    return (
        rates.crossJoin(F.broadcast(means))
        .where((F.col("_avg") != 0) & (F.col("periods_used") > 0))
        .select((F.col("_avg") * F.col("_r")).alias("ltv_estimate"), F.col("_avg").alias("avg_metric_per_period"), "periods_used")
    )


def funnel(df: DataFrame, stage: str, order: list[str] | None = None) -> DataFrame:
    """``stage, cnt, pct_of_total, conversion_from_prev, drop_off``, largest stage first or in the given order."""
    counts = category_counts(df, [stage]).select(F.col("value").alias("stage"), "cnt")
    if order:
        place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
        counts = counts.where(place > 0).withColumn("_place", place)
        steps = Window.orderBy("_place")
    else:
        steps = Window.orderBy(F.col("cnt").desc(), "stage")
    total = counts.agg(F.sum("cnt").alias("_total"))
    previous = F.coalesce(F.lag("cnt").over(steps), F.col("_total"))
    conversion = F.round(F.col("cnt") / previous, 4)
    return counts.crossJoin(F.broadcast(total)).select(
        "stage",
        "cnt",
        (F.col("cnt") / F.col("_total")).alias("pct_of_total"),
        conversion.alias("conversion_from_prev"),
        F.round(1 - conversion, 4).alias("drop_off"),
    )


def entity_funnel(df: DataFrame, entity: str, stage: str, order: list[str]) -> DataFrame:
    """``stage, entities, conversion_from_prev``: distinct entities seen in each stage, in the given order."""
    reached = df.where(F.col(stage).isin(order)).select(entity, F.col(stage).alias("stage")).distinct()
    counts = reached.groupBy("stage").agg(F.count(entity).alias("entities"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    previous = F.lag("entities").over(Window.orderBy("_place"))
    return counts.withColumn("_place", place).select(
        "stage", "entities", F.coalesce(F.col("entities") / previous, F.lit(1.0)).alias("conversion_from_prev")
    )


def decompose(df: DataFrame, ts: str, metric: str, volume: str) -> DataFrame:
    """Change of a monthly total from first to last month, split into a volume and a rate effect."""
    monthly = (
        with_time(df, ts)
        .groupBy(F.date_format(ts, "yyyy-MM").alias("_month"))
        .agg(F.sum(F.col(metric).cast("double")).alias("_metric"), F.count(volume).alias("_volume"))
        .withColumn("_rate", ratio(F.col("_metric"), F.col("_volume")))
    )
    state = F.struct("_metric", "_volume", "_rate")
    ends = monthly.agg(
        F.min_by(state, "_month").alias("a"), F.max_by(state, "_month").alias("b"), F.count(F.lit(1)).alias("_k")
    ).where(F.col("_k") >= 2)
    effects = ends.select(
        (F.col("b._metric") - F.col("a._metric")).alias("delta_metric"),
        ((F.col("b._volume") - F.col("a._volume")) * F.col("a._rate")).alias("volume_effect"),
        ((F.col("b._rate") - F.col("a._rate")) * F.col("a._volume")).alias("rate_effect"),
    )
    whole = F.col("volume_effect") + F.col("rate_effect")
    share = lambda c: F.coalesce(ratio(F.col(c), whole) * 100, F.lit(0.0))
    return effects.withColumns({"vol_share": share("volume_effect"), "rate_share": share("rate_effect")}).withColumn(
        "dominant", F.when(F.abs("vol_share") > F.abs("rate_share"), "volume-driven").otherwise("rate-driven")
    )


def benchmark(df: DataFrame, cols, entity: str | None = None) -> DataFrame:
    """``column, mean, std, above_2std_count, below_2std_count`` for four values or more; nulls are no outliers."""
    rows = _amounts(df, cols, entity)
    limits = column_moments(rows, cols).where(F.col("n") >= 4).select("column", "mean", "std")
    z = lambda v, at: F.when(at("std") > 0, (v - at("mean")) / at("std"))
    return tally(
        rows, cols, limits, {"above_2std_count": lambda v, at: z(v, at) > 2, "below_2std_count": lambda v, at: z(v, at) < -2}
    )


def with_zscore(df: DataFrame, col: str, name: str = "zscore") -> DataFrame:
    """The input rows with the z-score of one column."""
    limits = column_moments(df, [col]).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return df.crossJoin(F.broadcast(limits)).withColumn(name, zscore(col, "_mean", "_std")).drop("_mean", "_std")
