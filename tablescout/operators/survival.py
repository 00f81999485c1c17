"""How long until something happens: gaps, product-limit curves and their comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio
from tablescout.functions.tails import chi2_tail
from tablescout.plans.sequence import index_rows, running_totals, with_neighbours
from tablescout.session import materialize


def time_to_next(df: DataFrame, entity: str, time: str, tie_breakers=(), extra=()) -> DataFrame:
    """``entity, time, extra..., duration, observed``: seconds from each row to the next of its entity.

    The last row of an entity has no next one: it is not ``observed``, and its duration is the time to the end of the
    table, which it lasted at least. Rows stand in the order of ``time`` and ``tie_breakers``; positions come from a range
    sort, so an entity with most of the rows is no task of its own.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(entity).alias("entity"), F.col(time).cast("timestamp").alias("time"), *dict.fromkeys([*tie_breakers, *extra]))
    ordered = index_rows(rows, ["time", *tie_breakers], ["entity"])
    seen = with_neighbours(ordered, ["entity"], "pos", {"_next": ("time", 1)})
    end = rows.agg(F.max("time").alias("_end"))
    until = F.coalesce("_next", "_end")
    seconds = (F.unix_micros(until) - F.unix_micros("time")) / 1_000_000
    return seen.crossJoin(F.broadcast(end)).select("entity", "time", *extra, seconds.alias("duration"), F.col("_next").isNotNull().alias("observed"))


def _risk_sets(df: DataFrame, duration: str, observed: str, by: list[str]) -> DataFrame:
    """``by..., duration, events, censored, at_risk, pos``: one row per distinct duration, written."""
    rows = df.where(F.col(duration).isNotNull() & F.col(observed).isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    counts = rows.groupBy(*by, F.col(duration).alias("duration")).agg(
        F.count_if(observed).alias("events"), F.count_if(~F.col(observed)).alias("censored")
    )
    placed = index_rows(counts, ["duration"], by)
    gone = F.col("events") + F.col("censored")
    totals = placed.groupBy(*by).agg(F.sum(gone).alias("_n"))
    seen = running_totals(placed, by, "pos", {"_seen": gone})
    seen = seen.join(totals, by) if by else seen.crossJoin(F.broadcast(totals))
    at_risk = F.col("_n") - F.col("_seen") + gone
    return materialize(seen.select(*by, "duration", "events", "censored", at_risk.alias("at_risk"), "pos"))


def product_limit(df: DataFrame, duration: str, observed: str, by=()) -> DataFrame:
    """``by..., duration, at_risk, events, censored, survival, std_error``: the share that lasts longer than each duration.

    Rows become distinct durations with their counts before anything is ordered. Those at risk, the logarithm of the
    survival and the variance are running totals over blocks of durations.
    """
    by = list(by)
    rows = _risk_sets(df, duration, observed, by)
    left = F.col("at_risk") - F.col("events")
    terms = {
        "_log": F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0),
        "_over": F.when(left == 0, 1).otherwise(0),
        "_var": F.when(left > 0, F.col("events") / (F.col("at_risk") * left.cast("double"))).otherwise(0.0),
    }
    out = running_totals(rows, by, "pos", terms)
    survival = F.when(F.col("_over") > 0, 0.0).otherwise(F.exp("_log"))
    return out.withColumn("survival", survival).select(
        *by, "duration", "at_risk", "events", "censored", "survival", (F.col("survival") * F.sqrt("_var")).alias("std_error")
    )


def median_survival(curve: DataFrame, by=()) -> DataFrame:
    """``by..., median``: the first duration that no more than half outlast; null if more than half last on."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("duration"))).alias("median"))


def log_rank(df: DataFrame, duration: str, observed: str, group: str) -> DataFrame:
    """``groups, observed_events, expected_events, chi2, dof, p_value``: do groups last alike; events by group in order.

    At every distinct duration each group is expected to have its share of the events, by those at risk. The risk sets
    of all groups stand side by side for each duration; sums by pairs of groups, few numbers, give the statistic.
    """
    names = [r[0] for r in df.where(F.col(group).isNotNull() & F.col(duration).isNotNull() & F.col(observed).isNotNull()).select(group).distinct().orderBy(group).collect()]
    kind = "groups int, observed_events array<double>, expected_events array<double>, chi2 double, dof int, p_value double"
    k = len(names)
    if k < 2:
        return df.sparkSession.createDataFrame([], kind)
    rows = df.where(F.col(group).isNotNull())
    at = lambda i: F.col(group) == F.lit(names[i])
    counts = rows.where(F.col(duration).isNotNull() & F.col(observed).isNotNull()).groupBy(F.col(duration).alias("duration")).agg(
        *(F.count_if(at(i) & F.col(observed)).alias(f"_d{i}") for i in range(k)), *(F.count_if(at(i)).alias(f"_n{i}") for i in range(k))
    )
    placed = index_rows(counts, ["duration"])
    total = placed.agg(*(F.sum(f"_n{i}").alias(f"_all{i}") for i in range(k)))
    seen = running_totals(placed, [], "pos", {f"_s{i}": F.col(f"_n{i}") for i in range(k)}).crossJoin(F.broadcast(total))
    risk = [(F.col(f"_all{i}") - F.col(f"_s{i}") + F.col(f"_n{i}")).cast("double") for i in range(k)]
    seen = seen.select(*(F.col(f"_d{i}").cast("double").alias(f"_d{i}") for i in range(k)), *(r.alias(f"_r{i}") for i, r in enumerate(risk)))
    events, at_risk = (sum((F.col(f"{c}{i}") for i in range(k)), F.lit(0.0)) for c in ("_d", "_r"))
    seen = seen.withColumns({"_d": events, "_r": at_risk}).where("_d > 0")
    spread = F.col("_d") * ratio(F.col("_r") - F.col("_d"), F.col("_r") - 1)
    share = lambda i: F.col(f"_r{i}") / F.col("_r")

    def cell(i: int, j: int) -> Column:
        return F.coalesce(F.sum(spread * share(i) * ((1.0 if i == j else 0.0) - share(j))), F.lit(0.0))

    row = seen.agg(
        *(F.sum(f"_d{i}") for i in range(k)), *(F.sum(F.col("_d") * share(i)) for i in range(k)), *(cell(i, j) for i in range(k) for j in range(k))
    ).first()
    if row[0] is None:
        return df.sparkSession.createDataFrame([], kind)
    seen_events, expected = np.array(row[:k]), np.array(row[k : 2 * k])
    variance = np.array(row[2 * k :]).reshape(k, k)[:-1, :-1]
    apart = (seen_events - expected)[:-1]
    chi2 = float(apart @ np.linalg.pinv(variance) @ apart)
    out = (k, seen_events.tolist(), expected.tolist(), chi2, k - 1, float(chi2_tail(chi2, k - 1)))
    return df.sparkSession.createDataFrame([out], kind)
