"""Analyses of ordered series.

Except where noted each takes a series made by ``row_series`` or ``calendar_series`` and returns one
row per ``keys..., metric``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio, union_all
from tablescout.functions.tails import slope_p_value
from tablescout.plans.ranks import ranked_values
from tablescout.plans.sequence import (
    index_rows,
    ordered_rows,
    percent_change,
    rolling_sums,
    running_totals,
    with_neighbours,
)
from tablescout.plans.spectrum import dominant_frequency
from tablescout.session import materialize
from tablescout.sources.tables import time_micros, with_time


def _beside(rows: DataFrame, facts: DataFrame, group: list[str], keys) -> DataFrame:
    """Join per-series facts to rows; without keys there is one fact row per metric."""
    return rows.join(facts if keys else F.broadcast(facts), group)


def trend(series: DataFrame, keys=(), p_values: bool = True) -> DataFrame:
    """Least squares of value on position: slope, r_squared, p_value, direction, total_pct_change."""
    group = [*keys, "metric"]
    x, y = F.col("pos").cast("double"), F.col("value")
    fit = (
        series.where(F.col("n") >= 4)
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_sxx(y, x).alias("_sxx"),
            F.regr_syy(y, x).alias("_syy"),
            F.regr_sxy(y, x).alias("_sxy"),
            F.avg(y).alias("_mean"),
        )
    )
    fit = fit.withColumn("slope", ratio(F.col("_sxy"), F.col("_sxx"))).withColumn(
        "_r", F.coalesce(ratio(F.col("_sxy"), F.sqrt("_sxx") * F.sqrt("_syy")), F.lit(0.0))
    )
    out = fit.select(
        *group,
        "n",
        "slope",
        (F.col("_r") * F.col("_r")).alias("r_squared"),
        F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction"),
        F.coalesce(ratio(F.col("slope") * F.col("n"), F.abs("_mean")) * 100, F.lit(0.0)).alias("total_pct_change"),
        *([slope_p_value("_r", "n").alias("p_value")] if p_values else []),
    )
    return out


def growth_rate(series: DataFrame, keys=()) -> DataFrame:
    """First and last value, total change, compound and mean growth per step."""
    group = [*keys, "metric"]
    steps = with_neighbours(series.where(F.col("n") >= 2), group, "idx", {"_prev": ("value", -1)})
    first, last, n = F.col("first_value"), F.col("last_value"), F.col("periods")
    return (
        steps.groupBy(*group)
        .agg(
            F.min_by("value", "idx").alias("first_value"),
            F.max_by("value", "idx").alias("last_value"),
            (F.avg(ratio(F.col("value") - F.col("_prev"), F.col("_prev"))) * 100).alias("avg_period_growth_pct"),
            (F.count(F.lit(1)) - 1).alias("periods"),
        )
        .withColumn("total_pct_change", F.coalesce(percent_change("last_value", "first_value"), F.lit(0.0)))
        .withColumn("cagr_pct", F.when((first > 0) & (last > 0), (F.pow(last / first, 1 / n) - 1) * 100))
        .select(*group, "first_value", "last_value", "total_pct_change", "cagr_pct", "avg_period_growth_pct", "periods")
    )


def rolling_volatility(series: DataFrame, keys=(), window: int | None = None) -> DataFrame:
    """Rolling standard deviation over full windows: window, mean, maximum, and max-to-min ratio.

    The default window is a tenth of the dated rows, at least five; it grows with the data, so sums
    come from running totals of centred values, not from a sliding frame.
    """
    group = [*keys, "metric"]
    width = F.lit(window).cast("long") if window else F.greatest(F.lit(5), F.floor(F.col("n_rows") / 10)).cast("long")
    long_enough = series.withColumn("window", width).where(F.col("n") >= 2 * F.col("window"))
    means = long_enough.groupBy(*group).agg(F.avg("value").alias("_mean"))
    centred = _beside(long_enough, means, group, keys).withColumn("_y", F.col("value") - F.col("_mean"))
    sums = rolling_sums(
        centred.select(*group, "idx", "window", "_y"), group, "idx", F.col("window"), {"_s1": F.col("_y"), "_s2": F.col("_y") * F.col("_y")}
    )
    w = F.col("window")
    variance = (F.col("_s2") - F.col("_s1") * F.col("_s1") / w) / (w - 1)
    deviation = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return (
        sums.where(F.col("idx") >= w - 1)
        .withColumn("_d", deviation)
        .groupBy(*group)
        .agg(
            F.max("window").alias("window"),
            F.avg("_d").alias("mean_rolling_std"),
            F.max("_d").alias("max_rolling_std"),
            (F.max("_d") / F.greatest(F.min("_d"), F.lit(1e-9))).alias("vol_ratio"),
        )
    )


def peaks_valleys(series: DataFrame, keys=()) -> DataFrame:
    """Strict local extremes: counts, highest peak, lowest valley and their swing in percent of the mean."""
    group = [*keys, "metric"]
    near = with_neighbours(
        series.where(F.col("n") >= 5), group, "idx", {"_prev": ("value", -1), "_next": ("value", 1)}
    )
    v = F.col("value")
    peak = (v > F.col("_prev")) & (v > F.col("_next"))
    valley = (v < F.col("_prev")) & (v < F.col("_next"))
    found = near.groupBy(*group).agg(
        F.count_if(peak).alias("peak_count"),
        F.count_if(valley).alias("valley_count"),
        F.max(F.when(peak, v)).alias("max_peak"),
        F.min(F.when(valley, v)).alias("min_valley"),
        F.avg("value").alias("_mean"),
    )
    # A peak or valley of exactly zero, or no swing, reports no percentage.
    swing = F.when((F.col("max_peak") != 0) & (F.col("min_valley") != 0), F.col("max_peak") - F.col("min_valley"))
    pct = ratio(swing, F.abs("_mean")) * 100
    return (
        found.where((F.col("peak_count") > 0) | (F.col("valley_count") > 0))
        .withColumn("swing_pct", F.when(pct != 0, pct))
        .drop("_mean")
    )


def stationarity(series: DataFrame, keys=()) -> DataFrame:
    """Compare the two halves: mean_shift_ratio, std_shift_ratio, likely_stationary."""
    group = [*keys, "metric"]
    early = F.col("idx") < F.floor(F.col("n") / 2)
    v = F.col("value")
    halves = (
        series.where(F.col("n") >= 8)
        .groupBy(*group)
        .agg(
            F.abs(F.avg(F.when(early, v)) - F.avg(F.when(~early, v))).alias("_m"),
            F.abs(F.stddev_samp(F.when(early, v)) - F.stddev_samp(F.when(~early, v))).alias("_s"),
            F.avg(v).alias("_mean"),
            F.stddev_samp(v).alias("_std"),
        )
    )
    return halves.select(
        *group,
        F.coalesce(ratio(F.col("_m"), F.abs("_mean")), F.lit(0.0)).alias("mean_shift_ratio"),
        (F.col("_s") / F.greatest(F.col("_std"), F.lit(1e-9))).alias("std_shift_ratio"),
    ).withColumn("likely_stationary", (F.col("mean_shift_ratio") < 0.1) & (F.col("std_shift_ratio") < 0.3))


def monthly_means(df: DataFrame, ts: str, metrics, keys=()) -> DataFrame:
    """``keys..., metric, month, month_mean``; needs no order, so it takes the table itself."""
    dated = with_time(df, ts)
    wide = dated.groupBy(*keys, F.month(ts).alias("month")).agg(
        *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics]
    )
    return wide.unpivot([*keys, "month"], list(metrics), "metric", "month_mean").where(F.col("month_mean").isNotNull())


def seasonality(df: DataFrame, ts: str, metrics, keys=()) -> DataFrame:
    """Spread of the calendar-month means (four months or more): monthly_cv, peak_month, trough_month."""
    mean = F.col("month_mean")
    return (
        monthly_means(df, ts, metrics, keys)
        .groupBy(*keys, "metric")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.coalesce(ratio(F.stddev_samp(mean), F.abs(F.avg(mean))), F.lit(0.0)).alias("monthly_cv"),
            F.min(F.struct((-mean).alias("m"), F.col("month").alias("k")))["k"].alias("peak_month"),
            F.min(F.struct(mean.alias("m"), F.col("month").alias("k")))["k"].alias("trough_month"),
        )
        .where(F.col("months") >= 4)
    )


def changepoints(series: DataFrame, keys=(), top: int | None = None) -> DataFrame:
    """Mean shifts above 15 %, all or the ``top`` earliest: metric, cp_index, cp_date, before_mean, after_mean, pct_shift.

    Both side means come from running totals. A kept point hides candidates for a window after it, so
    the kept points follow from one minimum per round over the written candidates. A window is the floor of a fifth of
    the series or more and both ends are one, so there is room for four points at most.
    """
    group = [*keys, "metric"]
    usable = series.where(F.col("n") >= 10)
    totals = usable.groupBy(*group).agg(F.sum("value").alias("_total"))
    run = running_totals(usable.select(*group, "ts", "idx", "n", "value"), group, "idx", {"_upto": F.col("value")})
    i, n = F.col("idx"), F.col("n")
    width = F.greatest(F.lit(3), F.floor(n / 5)).cast("long")
    run = _beside(run, totals, group, keys).withColumn("_w", width).where((i >= F.col("_w")) & (i < n - F.col("_w")))
    left = (F.col("_upto") - F.col("value")) / i
    right = (F.col("_total") - F.col("_upto") + F.col("value")) / (n - i)
    moved = run.select(*group, "idx", "ts", "_w", left.alias("before_mean"), right.alias("after_mean"), (F.col("_total") / n).alias("_mean"))
    candidates = materialize(
        moved.where(ratio(F.abs(F.col("after_mean") - F.col("before_mean")), F.abs("_mean")) > 0.15).drop("_mean")
    )
    earliest = F.min_by(F.struct("idx", "ts", "before_mean", "after_mean", "_w"), "idx").alias("_hit")
    kept, rest = [], candidates
    for _ in range(4 if top is None else min(top, 4)):
        hit = rest.groupBy(*group).agg(earliest).select(*group, "_hit.*")
        kept.append(hit)
        after = hit.select(*group, (F.col("idx") + F.col("_w")).alias("_from"))
        rest = _beside(candidates, after, group, keys).where(F.col("idx") > F.col("_from")).drop("_from")
    return union_all(kept).select(
        *group,
        F.col("idx").alias("cp_index"),
        F.col("ts").alias("cp_date"),
        "before_mean",
        "after_mean",
        F.coalesce(percent_change("after_mean", "before_mean"), F.lit(0.0)).alias("pct_shift"),
    )


def lag_correlation(
    df: DataFrame, ts: str, metrics, tie_breakers=(), max_lag: int = 12, min_abs: float = 0.3, keys=(), grain: str | None = None
) -> DataFrame:
    """``keys..., col_a, col_b, leader, best_lag, r``: correlation of col_a with an earlier col_b, best lag per pair.

    The shifted column is the one that leads. Steps are rows in time order within the keys, or with ``grain`` the
    means of its calendar periods.
    """
    metrics, keys = list(metrics), list(keys)
    if grain:
        period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("ts")
        df = with_time(df, ts).groupBy(*keys, period).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
        ts, tie_breakers = "ts", ()
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    rows = ordered_rows(df, ts, metrics, tie_breakers, keys)
    shifted = {f"_{b}_{k}": (b, -k) for b in metrics[1:] for k in range(1, max_lag + 1)}
    wide = with_neighbours(rows, keys, "pos", shifted)
    # One row per lag, so that the aggregate has a few columns per pair and not per pair and lag.
    by_lag = F.array(
        *[
            F.struct(F.lit(k).alias("lag"), *[F.col(f"_{b}_{k}").alias(f"_earlier_{b}") for b in metrics[1:]])
            for k in range(1, max_lag + 1)
        ]
    )
    long = wide.select(*keys, "n_rows", *metrics[:-1], F.inline(by_lag))
    sums = []
    for j, (a, b) in enumerate(pairs):
        y, x = F.col(a), F.col(f"_earlier_{b}")
        sums += [F.regr_sxx(y, x).alias(f"_x{j}"), F.regr_syy(y, x).alias(f"_y{j}"), F.regr_sxy(y, x).alias(f"_c{j}")]
    per_lag = long.groupBy(*keys, "lag").agg(F.max("n_rows").alias("_rows"), *sums)
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_a"),
                F.lit(b).alias("col_b"),
                ratio(F.col(f"_c{j}"), F.sqrt(f"_x{j}") * F.sqrt(f"_y{j}")).alias("r"),
            )
            for j, (a, b) in enumerate(pairs)
        ]
    )
    strongest = F.min_by(F.struct("lag", "r"), F.struct(-F.abs("r"), F.col("lag")))
    return (
        per_lag.select(*keys, "_rows", "lag", F.inline(cells))
        .where((F.col("lag") <= F.floor(F.col("_rows") / 4)) & F.col("r").isNotNull())
        .groupBy(*keys, "col_a", "col_b")
        .agg(strongest.alias("_best"))
        .select(*keys, "col_a", "col_b", F.col("col_b").alias("leader"), F.col("_best.lag").alias("best_lag"), F.col("_best.r").alias("r"))
        .where(F.abs("r") > min_abs)
    )


def detrended(series: DataFrame, keys=()) -> DataFrame:
    """Each value minus its trailing mean over ``min(5, n // 2)`` values, fewer at the start."""
    group = [*keys, "metric"]
    back = with_neighbours(
        series.where(F.col("n") >= 8).select(*group, "idx", "n", "value"),
        group,
        "idx",
        {f"_p{k}": ("value", -k) for k in range(1, 5)},
    )
    # Eight or more values make the window at least four wide.
    inside = [F.when(F.floor(F.col("n") / 2) > k, F.col(f"_p{k}")) for k in range(1, 5)]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in inside), F.col("value"))
    count = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in inside), F.lit(1))
    return back.select(*group, "idx", "n", (F.col("value") - total / count).alias("value"))


def _cycle_columns(frame: DataFrame, group: list[str]) -> DataFrame:
    frequency = F.col("dominant_k") / F.col("n")
    # Half-way periods go to the even neighbour, as Python rounds.
    return frame.select(
        *group,
        "n",
        F.bround(1 / frequency).cast("long").alias("dominant_period"),
        frequency.alias("dominant_freq"),
        "magnitude",
    )


def cycles(series: DataFrame, keys=()) -> DataFrame:
    """Dominant Fourier frequency of the detrended values, for series that fit in one task each.

    Meant for calendar series, whose length the calendar bounds; ``long_cycles`` takes any length.
    """
    group = [*keys, "metric"]

    def transform(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("idx")
        size = np.abs(np.fft.rfft(ordered["value"].to_numpy()))[1:]
        k = int(np.argmax(size)) + 1
        head = {c: [ordered[c].iloc[0]] for c in group}
        return pd.DataFrame({**head, "n": [len(ordered)], "dominant_k": [k], "magnitude": [float(size[k - 1])]})

    values = detrended(series, keys).select(*group, "idx", "value")
    types = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in group)
    found = values.groupBy(*group).applyInPandas(transform, f"{types}, n long, dominant_k long, magnitude double")
    return _cycle_columns(found, group)


def long_cycles(series: DataFrame) -> DataFrame:
    """Dominant Fourier frequency of row sequences of any length, by a transform spread over tasks."""
    values = detrended(series).select("metric", "idx", "n", "value")
    return _cycle_columns(dominant_frequency(values), ["metric"])


def forecast_baseline(series: DataFrame, keys=(), alpha: float = 0.3) -> DataFrame:
    """Naive, moving-average and exponential-smoothing errors on the last fifth, and the next forecast."""
    group = [*keys, "metric"]
    usable = series.where(F.col("n") >= 6).withColumn("_m", F.floor(F.col("n") * F.lit(0.8)).cast("long"))
    i, m, v = F.col("idx"), F.col("_m"), F.col("value")
    train = i < m
    # Smoothing unrolled: each training value keeps a power of (1 - alpha), the first counts once more as the seed.
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), (m - 1 - i).cast("double"))
    seed = F.when(i == 0, F.pow(F.lit(1 - alpha), m.cast("double"))).otherwise(F.lit(0.0))
    fitted = usable.groupBy(*group).agg(
        F.max(F.when(i == m - 1, v)).alias("_naive"),
        F.avg(F.when(train & (i >= m - 5), v)).alias("_moving"),
        F.sum(F.when(train, (weight + seed) * v)).alias("_smooth"),
    )

    def miss(name: str) -> Column:
        error = F.avg(ratio(F.abs(v - F.col(name)), F.abs(v))) * 100
        return F.when(error != 0, error)

    errors = (
        _beside(usable.where(~train), fitted, group, keys)
        .groupBy(*group)
        .agg(
            miss("_naive").alias("naive_mape"),
            miss("_moving").alias("moving_avg_mape"),
            miss("_smooth").alias("exp_smoothing_mape"),
            F.max("_smooth").alias("next_period_forecast"),
            # An error of exactly zero is still the best one, though it is reported as null.
            *[(F.avg(ratio(F.abs(v - F.col(c)), F.abs(v)))).alias(f"{c}_e") for c in ("_naive", "_moving", "_smooth")],
        )
    )
    best = F.least("_naive_e", "_moving_e", "_smooth_e")
    return errors.withColumn(
        "best_method",
        F.when(F.col("_naive_e") == best, "naive")
        .when(F.col("_moving_e") == best, "moving average")
        .when(F.col("_smooth_e") == best, "exp smoothing"),
    ).drop("_naive_e", "_moving_e", "_smooth_e")


def category_drift(
    df: DataFrame, ts: str, cols, tie_breakers=(), min_delta: float = 0.05, top: int | None = None, keys=()
) -> DataFrame:
    """``keys..., column, category, early_share, late_share, delta`` between the first and second half of the rows by
    time, within the keys if there are any."""
    cols, keys = list(cols), list(keys)
    text = with_time(df, ts).withColumns({c: F.col(c).cast("string") for c in cols})
    if keys:
        ordered = ordered_rows(text, ts, [], tie_breakers, keys, extra=cols)
        placed = ordered.withColumn("_early", F.col("pos") < F.floor(F.col("n_rows") / 2))
    else:
        placed = split_rows(text, ts, cols, tie_breakers, {"_early": F.floor(F.col("n_rows") / 2)})
    names = F.array(*[F.lit(c) for c in cols])
    counted = (
        placed.select(*keys, "_early", F.posexplode(F.array(*cols)).alias("_c", "category"))
        .where(F.col("category").isNotNull())
        .groupBy(*keys, "_c", "category")
        .agg(F.count_if(F.col("_early")).alias("_e"), F.count_if(~F.col("_early")).alias("_l"))
        .withColumn("column", F.element_at(names, F.col("_c") + 1))
    )
    totals = counted.groupBy(*keys, "column").agg(F.sum("_e").alias("_te"), F.sum("_l").alias("_tl"))
    best = Window.partitionBy(*keys, "column").orderBy(F.abs(F.round("delta", 4)).desc(), "category")
    moved = (
        counted.join(totals if keys else F.broadcast(totals), [*keys, "column"])
        .select(
            *keys,
            "column",
            "category",
            F.coalesce(ratio(F.col("_e"), F.col("_te")), F.lit(0.0)).alias("early_share"),
            F.coalesce(ratio(F.col("_l"), F.col("_tl")), F.lit(0.0)).alias("late_share"),
        )
        .withColumn("delta", F.col("late_share") - F.col("early_share"))
        .where(F.abs("delta") > min_delta)
    )
    return moved.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top).drop("_r") if top else moved


def split_rows(df: DataFrame, ts: str, payload, tie_breakers, cuts: dict[str, Column]) -> DataFrame:
    """Dated rows with one flag per cut: is the row among the first ``cut`` rows by (ts, tie_breakers)?

    Only rows that share the time of a cut need an order among themselves; all others are placed by
    comparing times. So one pass counts rows per time, and the global sort runs on the tied rows alone.
    """
    payload = list(payload)
    ties = [c for c in dict.fromkeys(tie_breakers) if c not in {ts, *payload}]
    dated = with_time(df, ts).select(time_micros(ts).alias("_us"), *ties, *payload)
    times = dated.groupBy("_us").agg(F.count(F.lit(1)).alias("cnt"))
    total = times.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_rows")).select(
        *[e.cast("long").alias(name) for name, e in cuts.items()]
    )
    edges = (
        time_positions(times)
        .crossJoin(F.broadcast(total))
        .agg(
            *[
                F.max(
                    F.when(
                        (F.col("before") <= F.col(name)) & (F.col(name) < F.col("before") + F.col("cnt")),
                        F.struct("_us", (F.col(name) - F.col("before")).alias("inside")),
                    )
                ).alias(name)
                for name in cuts
            ]
        )
        .first()
    )
    # A cut with no edge lies at the end of the table: every row comes before it.
    limits = {name: edges[name] for name in cuts}
    at = F.col("_us")
    open_times = sorted({v["_us"] for v in limits.values() if v is not None and v["inside"] > 0})

    def flags(rows: DataFrame, place: Column | None) -> DataFrame:
        out = {}
        for name, limit in limits.items():
            if limit is None:
                out[name] = F.lit(True)
                continue
            out[name] = at < limit["_us"]
            if place is not None:
                out[name] = out[name] | ((at == limit["_us"]) & (place < limit["inside"]))
        return rows.withColumns(out).select(*payload, *cuts)

    if not open_times:
        return flags(dated, None)
    order = dict.fromkeys([*[c for c in tie_breakers if c != ts], *payload])
    tied = index_rows(dated.where(at.isin(open_times)), order, keys=["_us"])
    return flags(dated.where(~at.isin(open_times)), None).unionByName(flags(tied, F.col("pos")))


def time_positions(times: DataFrame) -> DataFrame:
    """``_us, cnt, before, n`` for a count per distinct time: how many rows lie before each time."""
    table = times.select(F.lit("ts").alias("column"), F.col("_us").cast("double").alias("value"), "cnt")
    return ranked_values(table).select(F.col("value").cast("long").alias("_us"), "cnt", "before", "n")
