"""Value counts of categorical columns and their contingency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.columns import union_all
from tablescout.sources.tables import TIME_TYPES, read_time


def category_counts(df: DataFrame, cols) -> DataFrame:
    """``column, value, cnt`` of non-null values; one shuffle, combined before it."""
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    return (
        df.select(F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("_c", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("_c", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.element_at(names, F.col("_c") + 1).alias("column"), "value", "cnt")
    )


def _families(df: DataFrame, cols) -> dict[str, list[str]]:
    """Columns by the type their values are compared in."""
    out: dict[str, list[str]] = {}
    for c in cols:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.setdefault("bigint", []).append(c)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            out.setdefault("double", []).append(c)
        elif isinstance(kind, TIME_TYPES):
            out.setdefault("timestamp_ntz", []).append(c)
        else:
            out.setdefault("string", []).append(c)
    return out


def distinct_counts(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """``column, n_rows, n, unique_count, avg_len, dated`` for any mix of column types.

    Values are counted in their own type, one pruned scan per type. ``avg_len`` and ``dated``, the share
    of values that read as a date, are for text; they come from the distinct values. A text over 64
    characters travels as a 128-bit digest. ``exact=False`` uses sketches, which shuffle no values.
    """
    cols = list(cols)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    families = _families(df, cols)
    parts = []
    if not exact:
        texts = families.get("string", [])
        wide = df.agg(
            *[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)],
            *[F.approx_count_distinct(c, 0.01).alias(f"_u{i}") for i, c in enumerate(cols)],
            *[F.avg(F.length(F.col(c).cast("string"))).alias(f"_l{i}") for i, c in enumerate(cols) if c in texts],
            *[F.count(read_time(F.col(c).cast("string"))).alias(f"_d{i}") for i, c in enumerate(cols) if c in texts],
        )
        cells = [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_n{i}").alias("n"),
                F.col(f"_u{i}").alias("unique_count"),
                (F.col(f"_l{i}") if c in texts else F.lit(None)).cast("double").alias("avg_len"),
                (F.try_divide(F.col(f"_d{i}"), F.col(f"_n{i}")) if c in texts else F.lit(None)).cast("double").alias("dated"),
            )
            for i, c in enumerate(cols)
        ]
        parts.append(wide.select(F.inline(F.array(*cells))))
        families = {}
    for kind, members in families.items():
        names = F.array(*[F.lit(c) for c in members])
        long = df.select(F.posexplode(F.array(*[F.col(c).cast(kind) for c in members])).alias("_c", "value"))
        if kind == "string":
            long = long.select(
                "_c",
                # A digest starts with a sign that no text is taken to start with, so it meets no literal value.
                F.when(F.length("value") > 64, F.concat(F.lit("\u0001"), F.md5("value"))).otherwise(F.col("value")).alias("value"),
                F.length("value").cast("long").alias("_len"),
            )
            values = long.groupBy("_c", "value").agg(F.count("value").alias("cnt"), F.sum("_len").alias("_len"))
            # Digests hold no date, as no text of that length is one.
            values = values.withColumn("_dated", F.when(read_time(F.col("value")).isNotNull(), F.col("cnt")).otherwise(0))
            facts = [
                F.try_divide(F.sum("_len"), F.sum("cnt")).alias("avg_len"),
                F.try_divide(F.sum("_dated"), F.sum("cnt")).alias("dated"),
            ]
        else:
            values = long.groupBy("_c", "value").agg(F.count("value").alias("cnt"))
            facts = [F.lit(None).cast("double").alias("avg_len"), F.lit(None).cast("double").alias("dated")]
        per_column = values.groupBy("_c").agg(F.sum("cnt").alias("n"), F.count("value").alias("unique_count"), *facts)
        parts.append(
            per_column.select(
                F.element_at(names, F.col("_c") + 1).alias("column"), "n", "unique_count", "avg_len", "dated"
            )
        )
    return union_all(parts).crossJoin(F.broadcast(rows))


def pair_counts(df: DataFrame, cols, pairs=None) -> DataFrame:
    """``col_a, val_a, col_b, val_b, cnt`` for column pairs.

    The joint table of all columns is counted first, so the pair expansion runs on
    distinct combinations instead of rows.
    """
    cols = list(cols)
    pairs = pairs or [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    joint = (
        df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        .groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair_order"),
                F.lit(a).alias("col_a"),
                F.col(a).alias("val_a"),
                F.lit(b).alias("col_b"),
                F.col(b).alias("val_b"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return (
        joint.select("cnt", F.inline(cells))
        .where(F.col("val_a").isNotNull() & F.col("val_b").isNotNull())
        .groupBy("pair_order", "col_a", "val_a", "col_b", "val_b")
        .agg(F.sum("cnt").alias("cnt"))
    )


PAIR_KEY = ["pair_order", "col_a", "col_b"]


def with_margins(cells: DataFrame) -> DataFrame:
    """Add ``row_total`` and ``col_total`` to each counted cell."""
    rows = cells.groupBy(*PAIR_KEY, "val_a").agg(F.sum("cnt").alias("row_total"))
    columns = cells.groupBy(*PAIR_KEY, "val_b").agg(F.sum("cnt").alias("col_total"))
    return cells.join(rows, [*PAIR_KEY, "val_a"]).join(columns, [*PAIR_KEY, "val_b"])


def full_table(cells: DataFrame, max_values: int | None = None) -> DataFrame:
    """Cells with zero counts filled in; with ``max_values`` only for pairs whose columns have at most so many values."""
    rows = cells.groupBy(*PAIR_KEY, "val_a").agg(F.sum("cnt").alias("row_total"))
    columns = cells.groupBy(*PAIR_KEY, "val_b").agg(F.sum("cnt").alias("col_total"))
    if max_values is None:
        grid = rows.join(columns, PAIR_KEY)
        return grid.join(cells, [*PAIR_KEY, "val_a", "val_b"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    small = (
        cells.groupBy(*PAIR_KEY)
        .agg(F.countDistinct("val_a").alias("_r"), F.countDistinct("val_b").alias("_c"))
        .where((F.col("_r") <= max_values) & (F.col("_c") <= max_values))
        .select(*PAIR_KEY)
    )
    small = F.broadcast(small)
    grid = rows.join(small, PAIR_KEY).join(columns.join(small, PAIR_KEY), PAIR_KEY)
    return grid.join(cells, [*PAIR_KEY, "val_a", "val_b"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
