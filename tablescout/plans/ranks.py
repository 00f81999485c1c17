"""Exact order statistics without sorting a column in one task.

Rows shrink to distinct values with counts, values are cut into ranges by approximate bounds, and the
position of each value is its rank inside its range plus the size of the ranges before it. The bounds
only balance the work: any bounds give the same positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import union_all

MAX_RANGES = 16_384


def _range_count(df: DataFrame) -> int:
    """A power of two, a few ranges per shuffle partition."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8
    while ranges < wanted and ranges < MAX_RANGES:
        ranges *= 2
    return ranges


def _range_of(value: str, bounds: str, ranges: int) -> Column:
    """How many bounds lie below the value, by binary search in the sorted array."""
    steps, step = [], ranges // 2
    while step:
        steps.append(str(step))
        step //= 2
    # Never null, so the later join on it adds no second evaluation as a null check.
    return F.expr(
        f"coalesce(aggregate(array({', '.join(steps)}), 0,"
        f" (at, s) -> if(element_at({bounds}, at + s) < {value}, at + s, at)), 0)"
    )


def is_whole(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def value_counts(df: DataFrame, cols, by=()) -> DataFrame:
    """``by..., column, value, cnt`` over non-null numeric values; a hot value is combined before the shuffle.

    Whole numbers stay whole numbers if all columns are, as doubles would merge large ones.
    """
    by, cols = list(by), list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    kind = "bigint" if all(is_whole(df, c) for c in cols) else "double"
    long = df.select(*by, F.posexplode(F.array(*[F.col(c).cast(kind) for c in cols])).alias("_c", "value"))
    for c in ["value", *by]:
        long = long.where(F.col(c).isNotNull())
    return (
        long.groupBy(*by, "_c", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(*by, F.element_at(names, F.col("_c") + 1).alias("column"), "value", "cnt")
    )


def ranked_values(counts: DataFrame, by=(), descending: bool = False) -> DataFrame:
    """Add ``before`` (rows ahead), ``sum_before``, ``n`` and ``total`` to a value-count table, per ``by`` and column."""
    by = list(by)
    group = [*by, "column"]
    ranges = _range_count(counts)
    # Written as text: a large cluster has thousands of cuts, too many to build one expression each.
    cuts = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    ordered = counts.withColumn("_key", -F.col("value") if descending else F.col("value"))
    # The always-true filter keeps `cnt` in this branch, so Spark can reuse the counting shuffle.
    bounds = (
        ordered.where(F.col("cnt") > 0)
        .groupBy("column")
        .agg(F.expr(f"percentile_approx(_key, array({cuts}), {max(10_000, 20 * ranges)})").alias("_bounds"))
    )
    cut = (
        ordered.join(F.broadcast(bounds), "column")
        .withColumn("_range", _range_of("_key", "_bounds", ranges))
        .drop("_bounds")
    )
    totals = cut.groupBy(*group, "_range").agg(
        F.sum("cnt").alias("_c"), F.sum(F.col("cnt") * F.col("value").cast("double")).alias("_s")
    )
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    offsets = totals.select(
        *group,
        "_range",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        F.sum("_c").over(everything).alias("n"),
        F.sum("_s").over(everything).alias("total"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        *group,
        "_range",
        "value",
        "cnt",
        F.coalesce(F.sum("cnt").over(inside), F.lit(0)).alias("_c1"),
        F.coalesce(F.sum(F.col("cnt") * F.col("value").cast("double")).over(inside), F.lit(0.0)).alias("_s1"),
    )
    return local.join(offsets, [*group, "_range"]).select(
        *group,
        "value",
        "cnt",
        (F.col("_c0") + F.col("_c1")).alias("before"),
        (F.col("_s0") + F.col("_s1")).alias("sum_before"),
        "n",
        "total",
    )


def value_at(position: Column) -> Column:
    """Aggregate: the value covering a zero-based position of a ranked table."""
    covers = (F.col("before") <= position) & (position < F.col("before") + F.col("cnt"))
    return F.max(F.when(covers, F.col("value")))


def quantile(p: float) -> Column:
    """Aggregate over a ranked table: the linearly interpolated quantile."""
    at = (F.col("n") - 1) * F.lit(p)
    low, high = value_at(F.floor(at)), value_at(F.ceil(at))
    weight = F.max(at - F.floor(at))
    return low + (high - low) * weight


def ranked_quantiles(df: DataFrame, cols, probabilities: dict[str, float], by=()) -> DataFrame:
    """``by..., column, n, unique_count`` and one column per named probability; exact.

    Ranks all distinct values, which also counts them and serves any number of groups.
    """
    families = [[c for c in cols if is_whole(df, c)], [c for c in cols if not is_whole(df, c)]]
    return union_all(
        [
            ranked_values(value_counts(df, family, by), by)
            .groupBy(*by, "column")
            .agg(
                F.max("n").alias("n"),
                F.count(F.lit(1)).alias("unique_count"),
                *[quantile(p).cast("double").alias(name) for name, p in probabilities.items()],
            )
            for family in families
            if family
        ]
    )


# Rank error of a sketch is at most one part in SKETCH_ACCURACY; brackets reach four parts to each side.
SKETCH_ACCURACY = 10_000
_REACH = 4 / SKETCH_ACCURACY
# Below this many values four parts are only a few ranks, and the bracket is the whole column instead.
SMALL_COLUMN = 100_000


def quantiles(df: DataFrame, cols, probabilities: dict[str, float]) -> DataFrame:
    """``column, n`` and one column per named probability; exact, with little to shuffle.

    A sketch brackets each quantile, one scan counts the values below the bracket, another keeps those
    inside it, and only these are ranked. A quantile outside its bracket would raise an error.
    """
    cols, names, points = list(cols), list(probabilities), list(probabilities.values())
    values = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    edges = [e for p in points for e in (max(0.0, p - _REACH), min(1.0, p + _REACH))]
    sketch = values.agg(
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(cols))],
        *[F.min(f"_x{i}").alias(f"_min{i}") for i in range(len(cols))],
        *[F.max(f"_x{i}").alias(f"_max{i}") for i in range(len(cols))],
        *[F.percentile_approx(f"_x{i}", edges, SKETCH_ACCURACY).alias(f"_e{i}") for i in range(len(cols))],
    )
    small = lambda i: F.col(f"_n{i}") < SMALL_COLUMN
    cells = [(i, j) for i in range(len(cols)) for j in range(len(points))]
    bounds = sketch.select(
        *[f"_n{i}" for i in range(len(cols))],
        *[F.when(small(i), F.col(f"_min{i}")).otherwise(F.col(f"_e{i}")[2 * j]).alias(f"_lo{i}_{j}") for i, j in cells],
        *[F.when(small(i), F.col(f"_max{i}")).otherwise(F.col(f"_e{i}")[2 * j + 1]).alias(f"_hi{i}_{j}") for i, j in cells],
    )
    wide = values.crossJoin(F.broadcast(bounds))
    x, low, high = (lambda i: F.col(f"_x{i}")), (lambda i, j: F.col(f"_lo{i}_{j}")), (lambda i, j: F.col(f"_hi{i}_{j}"))
    below = wide.agg(
        *[F.max(f"_n{i}").alias(f"_n{i}") for i in range(len(cols))],
        *[F.count_if(x(i) < low(i, j)).alias(f"_b{i}_{j}") for i, j in cells],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{i}:{j}").alias("column"),
                        F.lit(cols[i]).alias("_name"),
                        F.lit(j).alias("_j"),
                        F.lit(float(points[j])).alias("_p"),
                        F.col(f"_n{i}").alias("_rows"),
                        F.col(f"_b{i}_{j}").alias("_below"),
                    )
                    for i, j in cells
                ]
            )
        )
    )
    inside = F.array_compact(
        F.array(
            *[
                F.when((x(i) >= low(i, j)) & (x(i) <= high(i, j)), F.struct(F.lit(f"{i}:{j}").alias("column"), x(i).alias("value")))
                for i, j in cells
            ]
        )
    )
    kept = wide.select(F.inline(inside)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    at = (F.col("_rows") - 1) * F.col("_p")
    ranked = ranked_values(kept).join(F.broadcast(below), "column").withColumn("before", F.col("before") + F.col("_below"))
    found = ranked.groupBy("_name", "_j").agg(
        F.max("_rows").alias("n"),
        value_at(F.floor(at)).alias("_v0"),
        value_at(F.ceil(at)).alias("_v1"),
        F.max(at - F.floor(at)).alias("_weight"),
    )
    missed = F.col("_v0").isNull() | F.col("_v1").isNull()
    value = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_weight")
    )
    return (
        found.select("_name", "_j", "n", value.cast("double").alias("_v"))
        .groupBy(F.col("_name").alias("column"))
        .agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_j") == j, F.col("_v"))).alias(name) for j, name in enumerate(names)])
    )


def average_ranks(counts: DataFrame, by=()) -> DataFrame:
    """``by..., column, value, avg_rank``: tied values share the mean of their 1-based ranks."""
    ranked = ranked_values(counts, by)
    return ranked.select(*by, "column", "value", "cnt", "n", (F.col("before") + (F.col("cnt") + 1) / 2).alias("avg_rank"))


# A value is hot when it holds over a thousandth of its column: at most this many values can.
HOT_VALUES = 1_000
_SALTS = 64


def attach_ranks(rows: DataFrame, column: str, ranks: DataFrame, rank: Column, name: str) -> DataFrame:
    """Add to each row the rank of its value; rows without a value get null.

    ``ranks`` comes from ``average_ranks``. The few hot values are broadcast, and their rows then spread
    over the join that serves all other values.
    """
    table = ranks.select(F.col("value").alias("_value"), rank.alias("_rank"), (F.col("cnt") * HOT_VALUES > F.col("n")).alias("_hot"))
    hot = F.broadcast(table.where("_hot").select("_value", F.col("_rank").alias("_hot_rank")))
    cold = table.where(~F.col("_hot")).select("_value", "_rank", F.lit(-1).cast("long").alias("_salt"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) + F.spark_partition_id(), F.lit(_SALTS))
    settled = F.col("_hot_rank").isNotNull() | F.col("_value").isNull()
    return (
        rows.withColumn("_spread", spread)
        .withColumn("_value", F.col(column).cast(ranks.schema["value"].dataType))
        .join(hot, "_value", "left")
        .withColumn("_salt", F.when(settled, F.col("_spread")).otherwise(F.lit(-1)))
        .join(cold, ["_value", "_salt"], "left")
        .withColumn(name, F.coalesce("_hot_rank", "_rank"))
        .drop("_value", "_salt", "_spread", "_hot_rank", "_rank")
    )


def cell_splits(df: DataFrame, cols) -> tuple[dict[str, np.ndarray], bool]:
    """Where the cells of each column begin, from one sketch of all columns, and whether no column has nulls; the last
    number of a column ends its last cell.

    Each cut is a cell of its own, so a value that holds more of the rows than a range shares its cell with no other.
    Any splits give the same ranks, they only balance the work.
    """
    cols, ranges = list(cols), _range_count(df)
    cuts = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    size = min(65_535, max(4_096, 16 * ranges))
    values = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    numbers = values.select("*", *[F.when(~F.isnan(f"_x{i}"), F.col(f"_x{i}")).alias(f"_v{i}") for i in range(len(cols))])
    found = numbers.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(cols))],
        # A column without numbers has a sketch that cannot be asked.
        *[
            F.expr(f"if(count(_v{i}) > 0, kll_sketch_get_quantile_double(kll_sketch_agg_double(_v{i}, {size}), array({cuts})), null)").alias(f"_q{i}")
            for i in range(len(cols))
        ],
    ).first()
    out = {}
    for i, c in enumerate(cols):
        # Adding zero makes a negative zero a plain one.
        cut = np.array(found[f"_q{i}"] or [0.0]) + 0.0
        after = np.nextafter(cut, np.inf)
        inner = np.unique(np.concatenate([cut, after])[np.tile(np.isfinite(cut) & np.isfinite(after), 2)])
        out[c] = np.concatenate([[-np.inf], inner if len(inner) else [0.0], [np.inf]])
    return out, all(found[f"_n{i}"] == found["n"] for i in range(len(cols)))


@dataclass
class Cells:
    """Cells of a column in the order of its values: their splits, which hold one value only, and the rows in each."""

    splits: np.ndarray
    point: np.ndarray
    rows: np.ndarray

    @property
    def before(self) -> np.ndarray:
        return np.cumsum(self.rows) - self.rows

    @property
    def total(self) -> int:
        return int(self.rows.sum())


def _with_cells(rows: DataFrame, splits: dict[str, np.ndarray], names: dict[str, str]) -> DataFrame:
    """Add to each row the number of the cell of its value, for each column; values must be there."""
    cast = rows.withColumns({f"_x_{name}": F.col(c).cast("double") + 0.0 for c, name in names.items()})
    found = Bucketizer(
        splitsArray=[splits[c].tolist() for c in names],
        inputCols=[f"_x_{name}" for name in names.values()],
        outputCols=[f"_y_{name}" for name in names.values()],
        handleInvalid="keep",
    ).transform(cast)
    placed = found.withColumns({name: F.col(f"_y_{name}").cast("int") for name in names.values()})
    return placed.drop(*[f"_{kind}_{name}" for kind in "xy" for name in names.values()])


def count_cells(df: DataFrame, splits: dict[str, np.ndarray]) -> dict[str, Cells]:
    """The rows in each cell of every column of ``splits``, in one pass over rows that have them all; only counts of cells
    leave the tasks."""
    cols = list(splits)
    names = {c: f"_cell{i}" for i, c in enumerate(cols)}
    placed = _with_cells(df.select(*cols), splits, names)
    cells = placed.select(F.posexplode(F.array(*names.values())).alias("column", "cell"))
    counted = cells.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("cnt")).toArrow()
    column, cell, cnt = (counted[name].to_numpy() for name in ("column", "cell", "cnt"))
    out = {}
    for i, c in enumerate(cols):
        # One more cell takes NaN, which comes after all numbers.
        rows = np.zeros(len(splits[c]), np.int64)
        rows[cell[column == i]] = cnt[column == i]
        point = np.append(np.nextafter(splits[c][:-1], np.inf) == splits[c][1:], False)
        if is_whole(df, c):
            # Beyond this several whole numbers are the same double.
            point &= np.abs(splits[c]) < 2**53
        out[c] = Cells(splits[c], point, rows)
    return out


def with_average_rank(rows: DataFrame, column: str, cells: Cells, weight: str, name: str) -> DataFrame:
    """Add to each row, which stands for ``weight`` rows of the counted table, the average rank of its value.

    A cell of one value gives its rank at once, and where all are of this kind nothing is shuffled. The rows of other
    cells meet and are ranked there; those of the former are spread beside them.
    """
    seen = np.flatnonzero(cells.rows)
    known = pa.array(cells.before[seen] + (cells.rows[seen] + 1) / 2, mask=~cells.point[seen])
    table = pa.table({"_cell": pa.array(seen, pa.int32()), "_before": cells.before[seen], "_known": known})
    looked_up = F.broadcast(rows.sparkSession.createDataFrame(table))
    placed = _with_cells(rows, {column: cells.splits}, {column: "_cell"}).join(looked_up, "_cell", "left")
    if cells.point[seen].all():
        return placed.withColumn(name, F.col("_known")).drop("_cell", "_before", "_known")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(_SALTS))
    placed = placed.withColumn("_salt", F.when(F.col("_known").isNotNull(), spread).otherwise(F.lit(-1)))
    # Up to and with the rows of equal values, and these alone.
    upto = F.sum(weight).over(Window.partitionBy("_cell", "_salt").orderBy(column))
    equal = F.sum(weight).over(Window.partitionBy("_cell", "_salt", column))
    return (
        placed.withColumns({"_upto": upto, "_equal": equal})
        .withColumn(name, F.coalesce("_known", F.col("_before") + F.col("_upto") - (F.col("_equal") - 1) / 2))
        .drop("_cell", "_before", "_known", "_salt", "_upto", "_equal")
    )
