"""Ordered series: global row positions, running totals and neighbours, with no single-task window.

A series is long: ``keys..., metric, ts, pos, idx, n, n_rows, value`` where ``pos`` counts all dated
rows and ``idx`` only those whose value is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio
from tablescout.session import materialize
from tablescout.sources.tables import with_time

# Rows per block of a long sequence and blocks per group of blocks: both windows stay small.
BLOCK_ROWS = 65_536
BLOCKS_PER_GROUP = 4_096
# Tasks that sort blocks for neighbours, for each shuffle partition.
TASKS_PER_PARTITION = 4

_LOCAL_BITS = 33


def index_rows(df: DataFrame, order, keys=()) -> DataFrame:
    """Add ``pos``, the 0-based position in ``order`` within ``keys``, and ``n_rows``.

    Spark's range partitioner splits the full sort key; the trailing row number splits equal rows too,
    which may stand in any order. The layout is written once, so positions cannot change on a retry.
    """
    keys, order = list(keys), list(order)
    key = [*keys, *order, "_copy"]
    laid = (
        df.withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .drop("_copy")
        .withColumn("_m", F.monotonically_increasing_id())
    )
    laid = (
        materialize(laid)
        .withColumn("_part", F.shiftright("_m", _LOCAL_BITS))
        .withColumn("_local", F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_m")
    )
    sizes = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_local").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n_rows"),
    )
    # Without keys the offsets are one row per range partition; with keys their number is the data's.
    offsets = offsets if keys else F.broadcast(offsets)
    return (
        laid.join(offsets, [*keys, "_part"])
        .withColumn("pos", F.col("_local") + F.col("_shift"))
        .drop("_part", "_local", "_shift")
    )


def ordered_rows(df: DataFrame, ts: str, metrics, tie_breakers=(), keys=(), extra=()) -> DataFrame:
    """Dated rows with positions: ``keys..., ts, metrics..., extra..., pos, n_rows``."""
    metrics, keys, extra = list(metrics), list(keys), list(extra)
    ties = [c for c in dict.fromkeys(tie_breakers) if c not in {ts, *metrics, *keys, *extra}]
    dated = with_time(df, ts).select(
        *keys,
        F.col(ts).alias("ts"),
        *ties,
        *[c for c in extra if c not in keys],
        *[F.col(c).cast("double").alias(c) for c in metrics],
    )
    order = ["ts", *[c for c in tie_breakers if c != ts], *metrics, *extra]
    return index_rows(dated, dict.fromkeys(order), keys).drop(*ties)


def row_series(df: DataFrame, ts: str, metrics, tie_breakers=(), keys=()) -> DataFrame:
    """Every dated row is one observation, in (ts, tie_breakers, values) order."""
    keys, metrics = list(keys), list(metrics)
    rows = ordered_rows(df, ts, metrics, tie_breakers, keys)
    ids = [*keys, "ts", "pos", "n_rows"]
    long = rows.select(*ids, *metrics).unpivot(ids, metrics, "metric", "value")
    has_nulls = rows.agg(F.bool_or(F.expr(" or ".join(f"`{m}` is null" for m in metrics))).alias("x")).first()["x"]
    if not has_nulls:
        return long.withColumns({"idx": F.col("pos"), "n": F.col("n_rows")})
    # Present values are counted along the rows, before each row becomes one for each metric.
    seen = [f"_seen{i}" for i in range(len(metrics))]
    counted = running_totals(rows, keys, "pos", {s: F.when(F.col(m).isNotNull(), 1).otherwise(0) for s, m in zip(seen, metrics)})
    sizes = rows.groupBy(*keys).agg(*[F.count(m).alias(f"_n{i}") for i, m in enumerate(metrics)])
    counted = counted.join(sizes, keys) if keys else counted.crossJoin(F.broadcast(sizes))
    of_metric = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(s) - 1).alias("idx"), F.col(f"_n{i}").alias("n"))
        for i, (s, m) in enumerate(zip(seen, metrics))
    ]
    return counted.select(*ids, F.inline(F.array(*of_metric))).where(F.col("value").isNotNull())


def calendar_series(df: DataFrame, ts: str, metrics, grain: str = "day", agg: str = "avg", keys=()) -> DataFrame:
    """One observation per calendar bucket and key; a series is never longer than its calendar."""
    keys, metrics = list(keys), list(metrics)
    reducers = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    bucket = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("ts")
    buckets = (
        with_time(df, ts)
        .groupBy(*keys, bucket)
        .agg(*[reducers[agg](F.col(m).cast("double")).cast("double").alias(m) for m in metrics])
    )
    long = buckets.unpivot([*keys, "ts"], metrics, "metric", "value")
    series = Window.partitionBy(*keys, "metric")
    ordered = series.orderBy("ts")
    return (
        long.withColumn("pos", F.row_number().over(ordered).cast("long") - 1)
        .withColumn("n_rows", F.count(F.lit(1)).over(series))
        .withColumn("idx", F.count("value").over(ordered) - 1)
        .withColumn("n", F.count("value").over(series))
        .where(F.col("value").isNotNull())
    )


def _block(position: Column) -> Column:
    return F.floor(position / F.lit(BLOCK_ROWS)).cast("long")


def running_totals(df: DataFrame, keys, position: str, terms: dict[str, Column]) -> DataFrame:
    """Add inclusive running totals of ``terms`` by ``position``; rows at one position are peers.

    Each block is summed on its own; offsets of blocks and of groups of blocks supply what came before.
    """
    keys = list(keys)
    names = list(terms)
    staged = df.withColumns({f"_t_{k}": e for k, e in terms.items()}).withColumn("_block", _block(F.col(position)))
    blocks = (
        staged.groupBy(*keys, "_block")
        .agg(*[F.sum(f"_t_{k}").alias(f"_b_{k}") for k in names])
        .withColumn("_group", F.floor(F.col("_block") / F.lit(BLOCKS_PER_GROUP)).cast("long"))
    )
    groups = blocks.groupBy(*keys, "_group").agg(*[F.sum(f"_b_{k}").alias(f"_g_{k}") for k in names])
    over_groups = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy(*keys, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before_group = groups.select(
        *keys, "_group", *[F.coalesce(F.sum(f"_g_{k}").over(over_groups), F.lit(0)).alias(f"_h_{k}") for k in names]
    )
    offsets = blocks.join(before_group, [*keys, "_group"]).select(
        *keys,
        "_block",
        *[
            (F.col(f"_h_{k}") + F.coalesce(F.sum(f"_b_{k}").over(over_blocks), F.lit(0))).alias(f"_o_{k}")
            for k in names
        ],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({k: F.sum(f"_t_{k}").over(inside) for k in names})
    joined = local.join(offsets, [*keys, "_block"])
    return joined.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in names}).drop(
        "_block", *[f"_t_{k}" for k in names], *[f"_o_{k}" for k in names]
    )


def with_neighbours(df: DataFrame, keys, position: str, offsets: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns read ``offset`` rows away (negative: earlier) along a dense ``position``.

    Rows near a block's edge are also sent to the blocks that read them, so one shuffle by block suffices.
    """
    keys = list(keys)
    back = max([-o for _, o in offsets.values() if o < 0], default=0)
    ahead = max([o for _, o in offsets.values() if o > 0], default=0)
    block, inside = _block(F.col(position)), F.pmod(F.col(position), F.lit(BLOCK_ROWS))
    copies = [block]
    copies += [F.when(inside >= k * BLOCK_ROWS - back, block + k) for k in range(1, -(-back // BLOCK_ROWS) + 1)]
    copies += [F.when(inside < ahead - (k - 1) * BLOCK_ROWS, block - k) for k in range(1, -(-ahead // BLOCK_ROWS) + 1)]
    spread = df.withColumn("_block", F.explode(F.array_compact(F.array(*copies))))
    # Each task sorts its blocks at once, so there are a few for each shuffle partition.
    tasks = TASKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(tasks, *keys, "_block")
    near = Window.partitionBy(*keys, "_block").orderBy(position)
    read = {
        name: F.lag(column, -offset).over(near) if offset < 0 else F.lead(column, offset).over(near)
        for name, (column, offset) in offsets.items()
    }
    return spread.withColumns(read).where(F.col("_block") == block).drop("_block")


def rolling_sums(df: DataFrame, keys, position: str, width: Column, terms: dict[str, Column]) -> DataFrame:
    """Add trailing sums of ``terms`` over the last ``width`` positions, for windows of any length.

    Each row enters at its position and leaves ``width`` later; the rolling sum is the running total
    of arrivals minus departures.
    """
    names = list(terms)
    events = df.withColumns({f"_e_{k}": e for k, e in terms.items()}).withColumn(
        "_move", F.explode(F.array(F.lit(1), F.lit(-1)))
    )
    events = events.withColumn("_at", F.when(F.col("_move") == 1, F.col(position)).otherwise(F.col(position) + width))
    totals = running_totals(events, keys, "_at", {k: F.col(f"_e_{k}") * F.col("_move") for k in names})
    return totals.where(F.col("_move") == 1).drop("_move", "_at", *[f"_e_{k}" for k in names])


def percent_change(new, old) -> Column:
    return ratio(F.col(new) - F.col(old), F.abs(F.col(old))) * 100
