"""Control charts of ordered measurements: limits from moving ranges and rules on runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio
from tablescout.plans.sequence import index_rows, running_totals, with_neighbours
from tablescout.session import materialize

#: Fixed value: the mean range of two draws from the normal law, in deviations.
RANGE_OF_TWO = 1.128


def _ordered(df: DataFrame, value: str, order, keys) -> DataFrame:
    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v"))
    return materialize(with_neighbours(index_rows(rows, order, keys), keys, "pos", {"_before": ("_v", -1)}))


def _limits(rows: DataFrame, keys) -> DataFrame:
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("centre"), (F.avg(F.abs(F.col("_v") - F.col("_before"))) / RANGE_OF_TWO).alias("sigma")
    )
    return found.where(F.col("n") >= 2).withColumns({"lower": F.col("centre") - 3 * F.col("sigma"), "upper": F.col("centre") + 3 * F.col("sigma")})


def _with_limits(rows: DataFrame, keys) -> DataFrame:
    limits = _limits(rows, keys)
    return rows.join(limits, list(keys)) if keys else rows.crossJoin(F.broadcast(limits))


def control_limits(df: DataFrame, value: str, order, keys=()) -> DataFrame:
    """``keys..., n, centre, sigma, lower, upper`` of single values in ``order``, sigma from the mean moving range."""
    keys, order = list(keys), list(order)
    return _limits(_ordered(df, value, order, keys), keys)


def _numbered(rows: DataFrame, keys, states) -> DataFrame:
    """Number the maximal stretches of equal values of each of ``states``: a column ``_run`` and its name for each.

    A row opens a stretch if the one before differs, and the number of stretches opened so far, a running total over
    blocks, names that of a row. So a stretch goes on over the edges of blocks. All states share one pass.
    """
    marked = with_neighbours(rows, keys, "pos", {f"_last{s}": (s, -1) for s in states})
    opens = {f"_run{s}": F.when(F.col(f"_last{s}").eqNullSafe(F.col(s)) & (F.col("pos") > 0), 0).otherwise(1) for s in states}
    return materialize(running_totals(marked, keys, "pos", opens).select(*keys, "pos", *states, *opens))


def _runs(numbered: DataFrame, keys, state: str) -> DataFrame:
    """The stretches of a numbered ``state`` (null is in none): ``keys..., state, start, stop, length``; one that holds most
    rows is counted in parts where they lie."""
    return numbered.where(F.col(state).isNotNull()).groupBy(*keys, F.col(f"_run{state}").alias("_run"), F.col(state).alias("state")).agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("length")
    ).drop("_run")


def run_rules(df: DataFrame, value: str, order, keys=(), side: int = 8, trend: int = 6) -> DataFrame:
    """``keys..., rule, start, stop, length``: where the series leaves what chance allows; positions count from 0.

    ``beyond``: stretches outside three sigma on one side. ``shift``: ``side`` values or more in a row above the centre,
    or below it. ``trend``: ``trend`` values or more in a row that rise, or fall. ``zigzag``: fourteen or more in a row that
    go up and down by turns.
    """
    keys, order = list(keys), list(order)
    rows = _with_limits(_ordered(df, value, order, keys), keys)
    step = F.signum(F.col("_v") - F.col("_before"))
    rows = rows.select(
        *keys,
        "pos",
        F.when(F.col("_v") > F.col("upper"), 1).when(F.col("_v") < F.col("lower"), -1).alias("_beyond"),
        F.when(F.col("_v") > F.col("centre"), 1).when(F.col("_v") < F.col("centre"), -1).alias("_side"),
        F.when(step != 0, step.cast("int")).alias("_step"),
        # Steps that go up and down by turns are of one sign if every other one is turned round.
        F.when(step != 0, (step * F.when(F.col("pos") % 2 == 0, 1).otherwise(-1)).cast("int")).alias("_turn"),
    )
    numbered = _numbered(rows, keys, ["_beyond", "_side", "_step", "_turn"])
    out = []
    for rule, state, least, more in (("beyond", "_beyond", 1, 0), ("shift", "_side", side, 0), ("trend", "_step", trend - 1, 1), ("zigzag", "_turn", 13, 1)):
        # A stretch of steps has one value more, the one before its first.
        found = _runs(numbered, keys, state).where(F.col("length") >= least)
        out.append(found.select(*keys, F.lit(rule).alias("rule"), (F.col("start") - more).alias("start"), "stop", (F.col("length") + more).alias("length")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def capability(df: DataFrame, value: str, order, lower: float, upper: float, keys=()) -> DataFrame:
    """``keys..., n, centre, sigma, cp, cpk``: how often the spread of the series fits between two limits, and from the nearer one."""
    found = control_limits(df, value, order, keys)
    near = F.least(F.lit(upper) - F.col("centre"), F.col("centre") - F.lit(lower))
    return found.select(*keys, "n", "centre", "sigma", ratio(F.lit(upper - lower), 6 * F.col("sigma")).alias("cp"), ratio(near, 3 * F.col("sigma")).alias("cpk"))
