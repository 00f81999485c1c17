"""Which channels lead to conversions: paths of entities, simple rules, and the removal effect in a Markov chain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio
from tablescout.plans.sequence import index_rows, running_totals, with_neighbours
from tablescout.session import materialize

#: States of the chain beside the channels.
START, CONVERSION, LOST = "(start)", "(conversion)", "(lost)"


def touches(df: DataFrame, entity: str, time: str, channel: str, converts: Column, tie_breakers=()) -> DataFrame:
    """``entity, path, pos, channel, converts, from_state, to_state, ends``, written: every row in the order of its entity.

    A path ends with a conversion, whose row belongs to it and is no touch; what follows is the entity's next path.
    Rows without entity or time are left out, and so are touches without channel. Places and paths come from a range
    sort and running totals over blocks, so an entity with most of the rows is spread over tasks.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    rows = rows.withColumn("converts", F.coalesce(converts, F.lit(False))).where(F.col("converts") | F.col(channel).isNotNull())
    rows = rows.select(F.col(entity).alias("entity"), F.col(time).alias("time"), *tie_breakers, F.col(channel).cast("string").alias("channel"), "converts")
    placed = index_rows(rows, ["time", *tie_breakers], ["entity"]).select("entity", "pos", "n_rows", "channel", "converts")
    counted = running_totals(placed, ["entity"], "pos", {"_done": F.col("converts").cast("long")})
    seen = with_neighbours(counted, ["entity"], "pos", {"_last": ("channel", -1), "_closed": ("converts", -1)})
    begins = (F.col("pos") == 0) | F.coalesce("_closed", F.lit(False))
    return materialize(
        seen.select(
            "entity",
            (F.col("_done") - F.col("converts").cast("long")).alias("path"),
            "pos",
            "channel",
            "converts",
            F.when(begins, START).otherwise(F.col("_last")).alias("from_state"),
            F.when(F.col("converts"), CONVERSION).otherwise(F.col("channel")).alias("to_state"),
            (~F.col("converts") & (F.col("pos") == F.col("n_rows") - 1)).alias("ends"),
        )
    )


def paths(steps: DataFrame) -> DataFrame:
    """``entity, path, touches, first_touch, last_touch, converted``: a few values for each path, however long."""
    touch = ~F.col("converts")
    place = F.when(touch, F.col("pos"))
    found = steps.groupBy("entity", "path").agg(
        F.count_if(touch).alias("touches"), F.min_by("channel", place).alias("first_touch"), F.max_by("channel", place).alias("last_touch"), F.bool_or("converts").alias("converted")
    )
    return found


def path_counts(steps: DataFrame) -> DataFrame:
    """``first_touch, last_touch, paths, conversions, mean_touches``."""
    return paths(steps).groupBy("first_touch", "last_touch").agg(
        F.count(F.lit(1)).alias("paths"), F.count_if("converted").alias("conversions"), F.avg("touches").alias("mean_touches")
    )


def transitions(steps: DataFrame) -> DataFrame:
    """``from_state, to_state, n, share``: steps between channels, from the start of a path to conversion or loss."""
    moves = steps.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    lost = steps.where("ends").groupBy(F.col("to_state").alias("from_state"), F.lit(LOST).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    moves = moves.union(lost)
    leaving = moves.groupBy("from_state").agg(F.sum("n").alias("_all"))
    return moves.join(leaving, "from_state").select("from_state", "to_state", "n", ratio(F.col("n"), F.col("_all")).alias("share"))


def _removal(counts: list[tuple[str, str, int]]) -> dict[str, float]:
    """Share of the conversions of all paths that each channel is due: what would be missing without it, over the sum of that."""
    states = sorted({s for a, b, _ in counts for s in (a, b)} - {START, CONVERSION, LOST})
    at = {s: i for i, s in enumerate([START, *states])}
    inside, out = np.zeros((len(at), len(at))), np.zeros(len(at))
    for a, b, n in counts:
        if b in at:
            inside[at[a], at[b]] += n
        elif b == CONVERSION:
            out[at[a]] += n
    leaving = np.zeros(len(at))
    for a, _, n in counts:
        leaving[at[a]] += n
    share = np.divide(1.0, leaving, out=np.zeros(len(at)), where=leaving > 0)
    inside, out = inside * share[:, None], out * share

    def converts(without: int | None = None) -> float:
        p, q = inside.copy(), out.copy()
        if without is not None:  # whoever would get there is lost
            p[:, without], p[without, :], q[without] = 0, 0, 0
        return float(np.linalg.lstsq(np.eye(len(at)) - p, q, rcond=None)[0][0])

    whole = converts()
    effect = {s: 1 - converts(at[s]) / whole if whole > 0 else 0.0 for s in states}
    total = sum(effect.values())
    return {s: e / total if total > 0 else 0.0 for s, e in effect.items()}


def attribution(steps: DataFrame) -> DataFrame:
    """``channel, first_touch, last_touch, linear, markov``: conversions that each rule gives to each channel.

    First and last touch of a path get its conversion whole; ``linear`` deals it out evenly over the touches; ``markov``
    deals all conversions out by removal effect, from the counts of steps between channels, few numbers, and one small
    system for each channel. A conversion without touches goes to nobody, but for ``markov``, which deals out them all.
    """
    per_path = paths(steps)
    won = per_path.where("converted AND touches > 0")
    per = steps.where(~F.col("converts")).groupBy("entity", "path", "channel").agg(F.count(F.lit(1)).alias("n"))
    linear = per.join(won, ["entity", "path"]).groupBy("channel").agg(F.sum(F.col("n") / F.col("touches")).alias("linear"))
    ends = [won.groupBy(F.col(c).alias("channel")).agg(F.count(F.lit(1)).cast("double").alias(c)) for c in ("first_touch", "last_touch")]
    counts = [(r["from_state"], r["to_state"], r["n"]) for r in transitions(steps).collect()]
    conversions = sum(n for _, b, n in counts if b == CONVERSION)
    rows = [(c, share * conversions) for c, share in _removal(counts).items()]
    out = steps.sparkSession.createDataFrame(rows, "channel string, markov double")
    for part in (*ends, linear):
        out = out.join(part, "channel", "left")
    return out.select("channel", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("first_touch", "last_touch", "linear")), "markov")
