"""Smoothed levels and forecasts of long series, and of demand that is mostly zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.plans import sequence
from tablescout.plans.sequence import index_rows
from tablescout.session import materialize


def _smoothed(rows: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Add ``level`` by ``pos``: alpha times the value and the rest of the level before; the first value is the first level.

    A stretch of rows turns the level before it into factor * level + offset. Each block is folded to its two numbers,
    those of a series, one row a block, are walked in order, and then every block is walked from its own level: so
    blocks of one long series are smoothed side by side.
    """
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / F.lit(sequence.BLOCK_ROWS)).cast("long"))

    def walk(values: np.ndarray, level: float | None) -> np.ndarray:
        out = np.empty(len(values))
        for i, x in enumerate(values):
            level = x if level is None else level + alpha * (x - level)
            out[i] = level
        return out

    kinds = [f for f in blocked.schema if f.name in keys]
    folded_kind = T.StructType([*kinds, T.StructField("_block", T.LongType()), T.StructField("_factor", T.DoubleType()), T.StructField("_offset", T.DoubleType())])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        values = frame[value].to_numpy(float)
        first = frame["_block"].iloc[0] == 0
        factor, offset = (0.0, walk(values, None)[-1]) if first else ((1 - alpha) ** len(values), walk(values, 0.0)[-1])
        return pd.DataFrame([(*(frame[k].iloc[0] for k in keys), frame["_block"].iloc[0], factor, offset)], columns=[*keys, "_block", "_factor", "_offset"])

    needed = blocked.select(*keys, "_block", "pos", value)
    folds = materialize(needed.groupBy(*keys, "_block").applyInPandas(fold, folded_kind))
    # One row for each 65,536 of the series.
    line = folds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_factor", "_offset"))).alias("_line"))
    start = F.array().cast("array<double>")
    last = lambda done: F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0.0))
    levels = F.aggregate("_line", start, lambda done, b: F.array_append(done, b["_factor"] * last(done) + b["_offset"]))
    before = line.select(*keys, F.posexplode(levels).alias("_at", "_level")).withColumn("_block", F.col("_at").cast("long") + 1)
    joined = blocked.join(before.select(*keys, "_block", "_level"), [*keys, "_block"], "left")
    out_kind = T.StructType([*[f for f in joined.schema if f.name not in ("_block", "_level")], T.StructField("level", T.DoubleType())])

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        level = frame["_level"].iloc[0]
        frame["level"] = walk(frame[value].to_numpy(float), None if pd.isna(level) else float(level))
        return frame[[f.name for f in out_kind]]

    return joined.groupBy(*keys, "_block").applyInPandas(smooth, out_kind)


def exponential_level(df: DataFrame, value: str, order, keys=(), alpha: float = 0.3) -> DataFrame:
    """``keys..., order..., pos, value, level, forecast, error``: simple exponential smoothing of every row in ``order``.

    ``forecast`` is the level before the row and ``error`` what it misses; rows without value are left out.
    """
    keys, order = list(keys), list(order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(value).cast("double").alias("value"))
    placed = materialize(index_rows(rows, [*order, "value"], keys)).drop("n_rows")
    level = _smoothed(placed, keys, "value", alpha)
    # The level before follows from the one after it, as the first is the first value.
    before = F.when(F.col("pos") > 0, (F.col("level") - alpha * F.col("value")) / (1 - alpha))
    return level.withColumn("forecast", before).withColumn("error", F.col("value") - F.col("forecast"))


def intermittent_demand(df: DataFrame, value: str, order, keys=(), alpha: float = 0.1) -> DataFrame:
    """``keys..., periods, demands, mean_interval, size_level, interval_level, rate, variation``: demand that is mostly zero.

    Sizes of the demands above zero and the periods between them are smoothed apart; their ratio is the ``rate`` to
    expect in a period. ``variation`` is the squared deviation of the sizes over their mean.
    """
    keys, order = list(keys), list(order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("value"))
    placed = materialize(index_rows(rows, [*order, "value"], keys))
    held = placed.where("value > 0").select(*keys, F.col("pos").alias("at"), "value")
    numbered = materialize(index_rows(held, ["at"], keys)).select(*keys, "pos", "value", "at", "n_rows")
    spaced = sequence.with_neighbours(numbered, keys, "pos", {"_last": ("at", -1)})
    spaced = spaced.select(*keys, "pos", "value", (F.col("at") - F.coalesce("_last", F.lit(-1))).cast("double").alias("gap"), "n_rows")
    # Only the last levels are asked for: each row counts alpha times a power of 1 - alpha, the first one as the first level.
    power = F.pow(F.lit(1.0 - alpha), (F.col("n_rows") - 1 - F.col("pos")).cast("double"))
    weight = F.when(F.col("pos") > 0, alpha * power).otherwise(power)
    sums = spaced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("demands"),
        F.avg("gap").alias("mean_interval"),
        (F.var_samp("value") / (F.avg("value") * F.avg("value"))).alias("variation"),
        F.sum(weight * F.col("value")).alias("size_level"),
        F.sum(weight * F.col("gap")).alias("interval_level"),
    )
    periods = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"))
    join = (lambda a, b: a.join(b, keys)) if keys else (lambda a, b: a.crossJoin(F.broadcast(b)))
    out = join(periods.where("periods > 0"), sums.where("demands > 0"))
    return out.select(*keys, "periods", "demands", "mean_interval", "size_level", "interval_level", (F.col("size_level") / F.col("interval_level")).alias("rate"), "variation")


def seasonal_forecast(df: DataFrame, value: str, order, season: int, horizon: int, keys=(), alpha: float = 0.3) -> DataFrame:
    """``keys..., step, season_index, level, forecast``: the last level of the series without its season, times the season.

    A place in the season has the mean of its values over the mean of all; ``step`` counts from 1 behind the last row.
    """
    keys, order = list(keys), list(order)
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("value"))
    placed = materialize(index_rows(rows, [*order, "value"], keys)).withColumn("_place", F.col("pos") % season)
    whole = placed.groupBy(*keys).agg(F.avg("value").alias("_mean"))
    places = placed.groupBy(*keys, "_place").agg(F.avg("value").alias("_own"))
    places = places.join(whole, keys) if keys else places.crossJoin(F.broadcast(whole))
    places = places.select(*keys, "_place", F.when((F.col("_mean") != 0) & (F.col("_own") != 0), F.col("_own") / F.col("_mean")).otherwise(1.0).alias("season_index"))
    flat = placed.join(F.broadcast(places) if not keys else places, [*keys, "_place"])
    flat = flat.select(*keys, "pos", "n_rows", (F.col("value") / F.col("season_index")).alias("value"))
    level = _smoothed(flat, keys, "value", alpha).where(F.col("pos") == F.col("n_rows") - 1).select(*keys, "n_rows", "level")
    steps = level.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_place", (F.col("n_rows") - 1 + F.col("step")) % season)
    out = steps.join(places, [*keys, "_place"], "left").fillna({"season_index": 1.0})
    return out.select(*keys, "step", "season_index", "level", (F.col("level") * F.col("season_index")).alias("forecast"))
