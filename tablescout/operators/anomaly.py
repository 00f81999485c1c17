"""Unusual rows, duplicates and missing-value patterns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.columns import keep_complete, zscore
from tablescout.operators.foundation import plain_columns, row_digest
from tablescout.plans.ranks import quantile, ranked_values, value_counts
from tablescout.plans.stats import wide_moments
from tablescout.session import materialize


def zscore_rows(df: DataFrame, cols) -> DataFrame:
    """Complete rows with ``mean_abs_z`` and ``is_anomaly`` (above three); needs ten complete rows."""
    cols = list(cols)
    rows = keep_complete(df, cols)
    limits = wide_moments(rows, cols).where(F.col("n_complete") >= 10)
    total = sum((F.abs(zscore(c, f"{c}_mean", f"{c}_std")) for c in cols), F.lit(0.0))
    drop = ["n_complete", *[f"{c}_mean" for c in cols], *[f"{c}_std" for c in cols]]
    return (
        rows.crossJoin(F.broadcast(limits))
        .withColumn("mean_abs_z", total / len(cols))
        .withColumn("is_anomaly", F.col("mean_abs_z") > 3)
        .drop(*drop)
    )


def _rate(rows: DataFrame, method: str) -> DataFrame:
    return (
        rows.groupBy()
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomaly_count"))
        .where(F.col("n") > 0)
        .select("n", "anomaly_count", (F.col("anomaly_count") / F.col("n")).alias("anomaly_rate"), F.lit(method).alias("method"))
    )


def zscore_anomaly(df: DataFrame, cols) -> DataFrame:
    """``n, anomaly_count, anomaly_rate, method`` by mean absolute z-score."""
    return _rate(zscore_rows(df, cols), "zscore_average")


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points, the credit for an unsplit leaf."""
    out = np.zeros(len(n))
    big = n > 2
    out[n == 2] = 1.0
    m = n[big].astype(float)
    out[big] = 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m
    return out


def _grow(points: np.ndarray, depth_limit: int, random: np.random.Generator):
    """One isolation tree as flat arrays: feature (-1 in a leaf), cut, left, right, path length at a leaf."""
    feature, cut, left, right, length = [], [], [], [], []
    todo = [(points, 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        at = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = at
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_features = np.flatnonzero(high > low)
        left.append(-1)
        right.append(-1)
        if depth >= depth_limit or len(rows) <= 1 or not len(open_features):
            feature.append(-1)
            cut.append(0.0)
            length.append(depth + float(_path_length(np.array([len(rows)]))[0]))
            continue
        f = int(random.choice(open_features))
        c = float(random.uniform(low[f], high[f]))
        feature.append(f)
        cut.append(c)
        length.append(0.0)
        below = rows[:, f] <= c
        todo += [(rows[below], depth + 1, at, False), (rows[~below], depth + 1, at, True)]
    return feature, cut, left, right, length


def _closed(tree) -> tuple:
    """Arrays of one tree with every leaf pointing to itself, so that all rows walk the same number of steps."""
    feature, cut = np.array(tree["feature"]), np.array(tree["cut"], dtype=float)
    left, right = np.array(tree["left"]), np.array(tree["right"])
    leaf, own = feature < 0, np.arange(len(feature))
    cut = np.where(leaf, np.inf, cut)
    return np.maximum(feature, 0), cut, np.where(leaf, own, left), np.where(leaf, own, right), np.array(tree["length"])


def _deepest(tree) -> int:
    depth = [0] * len(tree["feature"])
    for at, (left, right) in enumerate(zip(tree["left"], tree["right"])):
        for child in (left, right):
            if child >= 0:
                depth[child] = depth[at] + 1
    return max(depth, default=0)


# Deepest trees that are laid out level by level, with 2**depth leaves.
_LEVELS = 12


def _level_by_level(tree: tuple, depth: int) -> tuple[list, np.ndarray]:
    """Feature and cut of each place of a level, and the lengths at the last one; a leaf goes on to itself."""
    feature, cut, left, right, length = tree
    at, levels = np.zeros(1, np.int64), []
    for _ in range(depth):
        levels.append((feature[at], cut[at]))
        at = np.stack([left[at], right[at]], axis=1).ravel()
    return levels, length[at]


_TREE = "feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>, size int"


def train_forest(df: DataFrame, cols, trees: int = 50, sample: int = 256, seed: int = 42) -> list:
    """Isolation trees, each grown in its own task from its own random rows.

    Equal rows are one row with their number of copies before any draw, and each copy is drawn for each tree by itself,
    with random numbers that follow from the row, so the forest is the same however the rows are partitioned and copies
    have their weight in every tree. About 1.5 times ``sample`` copies are drawn for a tree, and ``sample`` of those are
    kept. The trees that come back are bounded by ``trees`` and ``sample``, whatever the table's size.
    """
    cols = list(cols)
    rows = keep_complete(df, cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    # The margin makes a tree short of rows very unlikely; a short tree is still a valid one.
    chance = min(1.0, 1.5 * sample / max(1, rows.count()))
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_h", F.xxhash64(*cols, F.lit(seed)))
    # Copies and trees of a row stand in a line; the steps from one draw to the next are geometric.
    number = (F.shiftrightunsigned("_h", 11) + 0.5) / float(1 << 53)
    skipped = F.floor(F.log(number) / math.log1p(-chance)) if chance < 1 else F.lit(0).cast("long")
    line = F.col("_n") * trees
    held = counted.withColumn("_at", skipped).where(F.col("_at") < line)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *values, n, h, at in frame.itertuples(index=False, name=None):
                random, times = np.random.default_rng([seed, h & (1 << 64) - 1]), np.zeros(trees, int)
                while at < n * trees:
                    times[at % trees] += 1
                    at += int(random.geometric(chance))
                out += [(int(t), *values, int(times[t])) for t in times.nonzero()[0]]
            yield pd.DataFrame(out, columns=["tree", *cols, "_copies"])

    fields = [T.StructField(c, T.DoubleType()) for c in cols]
    kind = T.StructType([T.StructField("tree", T.IntegerType()), *fields, T.StructField("_copies", T.LongType())])
    drawn = held.select(*cols, "_n", "_h", "_at").mapInPandas(draw, kind)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        random = np.random.default_rng([seed, int(frame["tree"].iloc[0])])
        first = frame.sort_values(cols)
        points = np.repeat(first[cols].to_numpy(), first["_copies"].to_numpy(), axis=0)
        points = points[random.permutation(len(points))[:sample]]
        limit = max(1, math.ceil(math.log2(max(len(points), 2))))
        return pd.DataFrame([(*_grow(points, limit, random), len(points))], columns=["feature", "cut", "left", "right", "length", "size"])

    return drawn.groupBy("tree").applyInPandas(build, _TREE).collect()


def forest_score(forest: list, cols) -> Column:
    """An expression that scores the feature columns; the row's other columns stay in the JVM."""
    depth = max((_deepest(t) for t in forest), default=0)
    typical = float(np.mean(_path_length(np.array([t["size"] for t in forest])))) if forest else 1.0
    trees = [_closed(t) for t in forest]
    width = len(cols)

    laid = [_level_by_level(t, depth) for t in trees] if 0 < depth <= _LEVELS else None

    def walked(values: np.ndarray) -> np.ndarray:
        points = np.ascontiguousarray(values).ravel()
        start = np.arange(len(values)) * width
        total = np.zeros(len(values))
        for feature, cut, left, right, length in trees:
            at = np.zeros(len(values), dtype=np.int64)
            for _ in range(depth):
                below = points.take(start + feature.take(at)) <= cut.take(at)
                at = np.where(below, left.take(at), right.take(at))
            total += length.take(at)
        return total

    def descended(values: np.ndarray) -> np.ndarray:
        """The same by levels: a place's children are twice as far on, so a step looks up one feature and one cut."""
        n = len(values)
        points, rows, total = np.ascontiguousarray(values.T).ravel(), np.arange(n), np.zeros(n)
        at, spot, x, cuts, over = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n), np.empty(n, bool)
        for levels, length in laid:
            at[:] = 0
            for feature, cut in levels:
                np.take(feature * n, at, out=spot, mode="clip")
                spot += rows
                np.take(points, spot, out=x, mode="clip")
                np.take(cut, at, out=cuts, mode="clip")
                np.greater(x, cuts, out=over)
                at += at
                at += over
            np.take(length, at, out=x, mode="clip")
            total += x
        return total

    @F.pandas_udf(T.DoubleType())
    def score(values: pd.DataFrame) -> pd.Series:
        points = values.to_numpy(dtype=float)
        total = descended(points) if laid else walked(points)
        return pd.Series(np.power(2.0, -total / max(len(trees), 1) / max(typical, 1e-12)))

    return score(F.struct(*[F.col(c).cast("double").alias(c) for c in cols]))


def _scored(df: DataFrame, cols, trees: int, sample: int, contamination: float, seed: int):
    """Complete rows with their score, the written counts of each score, and the flagging limit."""
    cols = list(cols)
    score = forest_score(train_forest(df, cols, trees, sample, seed), cols)
    rows = keep_complete(df, cols).withColumn("anomaly_score", score)
    counts = materialize(value_counts(rows.select("anomaly_score"), ["anomaly_score"]))
    limit = (
        ranked_values(counts)
        .groupBy("column")
        .agg(quantile(1 - contamination).alias("_limit"), F.max("n").alias("_n"))
        .where(F.col("_n") >= 10)
        .select("_limit")
    )
    return rows, counts, limit


def isolation_forest(
    df: DataFrame, cols, trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """Complete rows with ``anomaly_score`` (near one: easily isolated) and ``is_anomaly``.

    Rows above the exact ``1 - contamination`` quantile of the score are flagged; ten rows at least.
    """
    rows, _, limit = _scored(df, cols, trees, sample, contamination, seed)
    return rows.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.col("anomaly_score") > F.col("_limit")).drop("_limit")


def anomaly_score(
    df: DataFrame, cols, trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """``n, anomaly_count, anomaly_rate, method`` by isolation forest; rows are scored once."""
    _, counts, limit = _scored(df, cols, trees, sample, contamination, seed)
    over = F.when(F.col("value") > F.col("_limit"), F.col("cnt")).otherwise(0)
    totals = counts.crossJoin(F.broadcast(limit)).groupBy().agg(F.sum("cnt").alias("n"), F.sum(over).alias("anomaly_count"))
    return totals.where(F.col("n") > 0).select(
        "n", "anomaly_count", (F.col("anomaly_count") / F.col("n")).alias("anomaly_rate"), F.lit("isolation_forest").alias("method")
    )


def duplicates(df: DataFrame, id_cols=(), time_cols=(), near_cols: int | None = None) -> DataFrame:
    """Exact copies, and copies on the columns that are neither identifiers nor times, all or the first: counts and rates."""
    cols = plain_columns(df)
    skip = {*id_cols, *time_cols}
    keys = [c for c in cols if c not in skip][:near_cols]
    # Copies are copies on fewer columns as well, so those are counted among the distinct rows.
    rows = df.select(row_digest(keys).alias("_near"), row_digest(cols).alias("_row"))
    distinct = rows.groupBy("_near", "_row").agg(F.count(F.lit(1)).alias("_k"))
    near = distinct.groupBy("_near").agg(F.count(F.lit(1)).alias("_distinct"), F.sum("_k").alias("_k"))
    none = F.lit(0).cast("long")
    counts = near.agg(
        F.coalesce(F.sum("_k"), none).alias("_rows"),
        F.coalesce(F.sum(F.col("_k") - F.col("_distinct")), none).alias("exact_duplicate_count"),
        (F.coalesce(F.sum(F.col("_k") - 1), none) if keys else none).alias("near_duplicate_count"),
    )
    n = F.greatest(F.col("_rows"), F.lit(1))
    return counts.select(
        "exact_duplicate_count",
        (F.col("exact_duplicate_count") / n).alias("exact_duplicate_rate"),
        "near_duplicate_count",
        (F.col("near_duplicate_count") / n).alias("near_duplicate_rate"),
    )


def duplicate_groups(df: DataFrame, cols=None) -> DataFrame:
    """Each repeated combination with its number of ``copies``."""
    cols = list(cols or plain_columns(df))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def co_missing(df: DataFrame, cols=None) -> DataFrame:
    """``col_a, col_b, both_null_count, pct`` for column pairs that are null together; one pass.

    Rows collapse to distinct null patterns first, so the pair work does not grow with the rows.
    """
    cols = list(cols or plain_columns(df))
    patterns = df.groupBy(F.array(*[F.col(c).isNull() for c in cols]).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    rows = patterns.agg(F.sum("_k").alias("_rows"))
    nulls = F.filter(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.element_at(F.col("_p"), i + 1))
    held = patterns.select("_k", nulls.alias("_at")).where(F.size("_at") > 1)
    pairs = held.select("_k", "_at", F.explode("_at").alias("_a")).select("_k", "_a", F.explode("_at").alias("_b")).where(F.col("_a") < F.col("_b"))
    names = F.array(*[F.lit(c) for c in cols])
    return (
        pairs.groupBy("_a", "_b")
        .agg(F.sum("_k").alias("both_null_count"))
        .crossJoin(F.broadcast(rows))
        .select(
            F.element_at(names, F.col("_a") + 1).alias("col_a"),
            F.element_at(names, F.col("_b") + 1).alias("col_b"),
            "both_null_count",
            (F.col("both_null_count") / F.col("_rows")).alias("pct"),
        )
    )


def missing_rows(df: DataFrame, cols=None) -> DataFrame:
    """``n_rows, null_columns, rows_mostly_null, rows_all_null``: half or more, and all columns missing."""
    cols = list(cols or plain_columns(df))
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    wide = df.select(missing.alias("_m"), *[F.col(c).isNull().alias(f"_c{i}") for i, c in enumerate(cols)]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_m") >= len(cols) * 0.5).alias("rows_mostly_null"),
        F.count_if(F.col("_m") == len(cols)).alias("rows_all_null"),
        *[F.coalesce(F.bool_or(f"_c{i}"), F.lit(False)).alias(f"_c{i}") for i in range(len(cols))],
    )
    null_columns = sum((F.col(f"_c{i}").cast("long") for i in range(len(cols))), F.lit(0))
    return wide.select("n_rows", null_columns.alias("null_columns"), "rows_mostly_null", "rows_all_null")
