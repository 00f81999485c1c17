"""Who was there lately: rolling numbers of distinct entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio


def _counted(visits: DataFrame, days: int) -> DataFrame:
    """``day, change``: entities that begin or end to count as active within the last ``days`` days."""
    until = F.least(F.coalesce("_next", F.date_add("day", days)), F.date_add("day", days))
    moves = F.array(F.struct(F.col("day"), F.lit(1).alias("move")), F.struct(until.alias("day"), F.lit(-1).alias("move")))
    return visits.select(F.inline(moves)).groupBy("day").agg(F.sum("move").alias("change"))


def rolling_distinct(df: DataFrame, entity: str, time: str, windows=(1, 7, 28)) -> DataFrame:
    """``day, active_<w>...``: distinct entities with a row in the last ``w`` days, for every day of the table; exact.

    A visit counts from its day until the window ends or the entity is there again, so an entity's visits become
    intervals that do not overlap, each of which adds one at its start and takes one at its end. Rows become one per
    entity and day before that; sums by day are no longer than the calendar.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    visits = rows.select(F.col(entity).alias("entity"), F.to_date(time).alias("day")).distinct()
    visits = visits.withColumn("_next", F.lead("day").over(W.partitionBy("entity").orderBy("day")))
    calendar = visits.agg(F.min("day").alias("_first"), F.max("day").alias("_last")).where("_first IS NOT NULL")
    calendar = calendar.select(F.explode(F.sequence("_first", "_last")).alias("day"))
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    changes = [_counted(visits, w).withColumnRenamed("change", f"_c{w}") for w in windows]
    joined = reduce(lambda a, b: a.join(b, "day", "left"), changes, calendar)
    return joined.select("day", *(F.coalesce(F.sum(f"_c{w}").over(upto), F.lit(0)).cast("long").alias(f"active_{w}") for w in windows))


def stickiness(rolling: DataFrame, short: int = 1, long: int = 28) -> DataFrame:
    """``day, stickiness``: active entities of the short window as a share of those of the long one."""
    return rolling.select("day", ratio(F.col(f"active_{short}"), F.col(f"active_{long}")).alias("stickiness"))


def feature_adoption(df: DataFrame, entity: str, feature: str, time: str) -> DataFrame:
    """``feature, entities, adoption_rate, first_used, events_per_entity``: of all entities, those that ever used each feature."""
    rows = df.where(F.col(entity).isNotNull())
    per = rows.groupBy(F.col(feature).alias("feature"), F.col(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("t"))
    total = rows.select(F.count_distinct(entity).alias("_all"))
    used = per.where(F.col("feature").isNotNull()).groupBy("feature")
    used = used.agg(F.count(F.lit(1)).alias("entities"), F.min("t").alias("first_used"), F.avg("n").alias("events_per_entity"))
    return used.crossJoin(F.broadcast(total)).select("feature", "entities", ratio(F.col("entities"), F.col("_all")).alias("adoption_rate"), "first_used", "events_per_entity")
