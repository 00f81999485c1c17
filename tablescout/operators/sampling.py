"""A few telling rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import union_all
from tablescout.plans.ranks import ranked_values, value_at, value_counts


def representative_rows(df: DataFrame, order_by: str, numeric=(), categorical=(), k: int = 8) -> DataFrame:
    """Up to ``k`` rows as text: extremes and middle of the numeric columns, first rows of frequent values.

    ``order_by`` is a unique numeric key that stands for the row position; the middle row of a column is
    the one half-way among its non-null rows. Only the keys of the chosen rows are gathered.
    """
    numeric, categorical = list(numeric), list(categorical)
    key = F.col(order_by)
    picks = []
    if numeric:
        chosen = []
        for i, c in enumerate(numeric):
            v = F.when(F.col(c).isNotNull(), F.struct(F.col(c), key))
            w = F.when(F.col(c).isNotNull(), F.struct(-F.col(c), key))
            chosen += [F.min_by(key, v).alias(f"_a{i}"), F.min_by(key, w).alias(f"_b{i}")]
        ends = df.agg(*chosen)
        picks.append(ends.select(F.explode(F.array(*ends.columns)).alias(order_by)))
        for c in numeric:
            places = ranked_values(value_counts(df.where(F.col(c).isNotNull()), [order_by]))
            middle = places.agg(value_at(F.floor(F.col("n") / 2)).alias(order_by))
            picks.append(middle.select(F.col(order_by).cast(df.schema[order_by].dataType).alias(order_by)))
    if categorical:
        best = Window.partitionBy("_c").orderBy(F.col("_k").desc(), "value")
        picks.append(
            df.select(key, F.posexplode(F.array(*[F.col(c).cast("string") for c in categorical])).alias("_c", "value"))
            .where(F.col("value").isNotNull())
            .groupBy("_c", "value")
            .agg(F.count(F.lit(1)).alias("_k"), F.min(order_by).alias(order_by))
            .withColumn("_r", F.row_number().over(best))
            .where(F.col("_r") <= 3)
            .select(order_by)
        )
    rows = df
    if picks:
        keys = union_all(picks).where(key.isNotNull()).distinct().orderBy(order_by).limit(k)
        rows = df.join(F.broadcast(keys), order_by, "left_semi")
    else:
        rows = df.orderBy(order_by).limit(3)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
