"""Distributions, associations and group tests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.algebra import partial_correlations, variance_inflation
from tablescout.functions.columns import (
    adjusted_kurtosis,
    adjusted_skewness,
    keep_complete,
    ratio,
    union_all,
    zscore,
)
from tablescout.functions.tails import chi2_upper, f_upper, slope_p_value
from tablescout.plans.counts import PAIR_KEY, category_counts, distinct_counts, full_table, pair_counts, with_margins
from tablescout.plans.gram import gram
from tablescout.plans.ranks import cell_splits, count_cells, is_whole, quantile, quantiles, ranked_quantiles, ranked_values, value_counts, with_average_rank
from tablescout.plans.stats import column_moments, pair_list, pair_statistics, tally


def distribution(df: DataFrame, cols) -> DataFrame:
    """``column, n, skewness, kurtosis, iqr, shape`` for columns with at least four values."""
    moments = column_moments(df, cols).where(F.col("n") >= 4)
    spread = quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).drop("n")
    # A constant column has no moments about its mean; the adjusted forms are then zero.
    skew = F.when(F.col("std") > 0, adjusted_skewness("skew_pop", "n")).otherwise(F.lit(0.0))
    kurt = F.when(F.col("std") > 0, adjusted_kurtosis("kurt_pop", "n")).otherwise(F.lit(0.0))
    return (
        moments.join(F.broadcast(spread), "column")
        .select(
            "column", "n", skew.alias("skewness"), kurt.alias("kurtosis"), (F.col("q3") - F.col("q1")).alias("iqr")
        )
        .withColumn(
            "shape",
            F.when(F.col("skewness") > 1, "right-skewed").when(F.col("skewness") < -1, "left-skewed").otherwise("symmetric"),
        )
    )


def fences(df: DataFrame, cols) -> DataFrame:
    """``column, n, mean, std, lower_fence, upper_fence`` from quartiles and moments."""
    spread = quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).drop("n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        column_moments(df, cols)
        .join(F.broadcast(spread), "column")
        .select(
            "column", "n", "mean", "std", (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence")
        )
    )


def _outside_fences() -> Column:
    return (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))


def outliers(df: DataFrame, cols) -> DataFrame:
    """Per column: values outside the quartile fences and values beyond three deviations."""
    limits = fences(df, cols).where(F.col("n") >= 4)
    counted = tally(
        df,
        cols,
        limits,
        {
            "iqr_outlier_count": lambda v, at: (v < at("lower_fence")) | (v > at("upper_fence")),
            "zscore_outlier_count": lambda v, at: (at("std") > 0) & (F.abs(ratio(v - at("mean"), at("std"))) > 3),
        },
    )
    return counted.drop("mean", "std").withColumn("iqr_outlier_pct", F.col("iqr_outlier_count") / F.col("n"))


def flag_outliers(df: DataFrame, col: str) -> DataFrame:
    """The input rows with ``is_iqr_outlier`` and ``is_zscore_outlier`` for one column."""
    limits = fences(df, [col]).drop("column", "n")
    value = F.col(col).cast("double")
    return (
        df.crossJoin(F.broadcast(limits))
        .withColumn("value", value)
        .withColumn("is_iqr_outlier", F.coalesce(_outside_fences(), F.lit(False)))
        .withColumn("is_zscore_outlier", F.coalesce(F.abs(zscore("value", "mean", "std")) > 3, F.lit(False)))
        .drop("value", "mean", "std", "lower_fence", "upper_fence")
    )


def normality(df: DataFrame, cols) -> DataFrame:
    """Omnibus K-squared test from moments: ``column, n, statistic, p_value, is_normal`` (n of eight or more)."""
    n, b2 = F.col("n").cast("double"), F.col("kurt_pop") + 3
    moments = column_moments(df, cols).where((F.col("n") >= 8) & (F.col("std") > 0))
    y = F.col("skew_pop") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    moments = moments.withColumns({"_y": y, "_w2": F.sqrt(2 * (beta - 1)) - 1})
    z1 = F.asinh(F.col("_y") / F.sqrt(2 / (F.col("_w2") - 1))) / F.sqrt(F.log(F.col("_w2")) / 2)
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    moments = moments.withColumns({"_x": (b2 - expected) / F.sqrt(variance), "_s": s})
    moments = moments.withColumn(
        "_a", 6 + (8 / F.col("_s")) * (2 / F.col("_s") + F.sqrt(1 + 4 / (F.col("_s") * F.col("_s"))))
    )
    a = F.col("_a")
    inner = ratio(1 - 2 / a, 1 + F.col("_x") * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.cbrt(inner)) / F.sqrt(2 / (9 * a))
    return (
        moments.withColumn("statistic", z1 * z1 + z2 * z2)
        .withColumn("p_value", F.exp(-F.col("statistic") / 2))
        .select("column", "n", "statistic", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))
    )


def _rank_correlations(df: DataFrame, pairs, splits) -> DataFrame:
    """Rank correlations of ``pairs`` over rows complete in their columns, which must have ``splits``.

    Copies of a row collapse first; each column's ranks take one shuffle at most, and all pairs share one aggregate.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    values = df.select(*[F.col(c).cast("long" if is_whole(df, c) else "double").alias(c) for c in cols])
    cells = count_cells(values, {c: splits[c] for c in cols})
    joint = values.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w"))
    for c in cols:
        # Average ranks always have mean (n + 1) / 2, which centres the products. The rank takes the place of the value.
        rank = with_average_rank(joint, c, cells[c], "_w", "_rank").withColumn(c, F.col("_rank") - (cells[c].total + 1) / 2)
        joint = rank.drop("_rank")
    squares = [F.sum(F.col("_w") * F.col(c) * F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)]
    products = [F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)]
    at = {c: i for i, c in enumerate(cols)}
    cells_of_pairs = [
        F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            ratio(F.col(f"_p{i}"), F.sqrt(f"_s{at[a]}") * F.sqrt(f"_s{at[b]}")).alias("spearman"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return joint.agg(*squares, *products).select(F.inline(F.array(*cells_of_pairs)))


def spearman(df: DataFrame, pairs) -> DataFrame:
    """``col_a, col_b, spearman``: Pearson correlation of average ranks over each pair's complete rows.

    Without nulls all pairs share their ranks; with nulls each pair ranks its own complete rows.
    """
    pairs = list(pairs)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    splits, complete = cell_splits(df, cols)
    if complete:
        return _rank_correlations(df, pairs, splits)
    return union_all([_rank_correlations(keep_complete(df, p), [p], splits) for p in pairs])


def correlation(df: DataFrame, cols, min_abs: float = 0.3, top: int | None = None) -> DataFrame:
    """``col_a, col_b, n, pearson, spearman`` of pairs at least ``min_abs`` strong, strongest first; all or ``top``.

    The surviving pairs are looked up first, one row each, so that no column of a dropped pair is ranked.
    """
    kept = _strongest(df, cols, top, min_abs)
    fields = {"col_a": pa.string(), "col_b": pa.string(), "n": pa.int64(), "r": pa.float64()}
    found = df.sparkSession.createDataFrame(pa.table({c: pa.array([r[c] for r in kept], kind) for c, kind in fields.items()}))
    pearson = found.withColumnRenamed("r", "pearson")
    if not kept:
        return pearson.withColumn("spearman", F.lit(None).cast("double"))
    ranked = spearman(df, [(r["col_a"], r["col_b"]) for r in kept])
    return pearson.join(F.broadcast(ranked), ["col_a", "col_b"]).orderBy(F.abs("pearson").desc(), "col_a", "col_b")


def _strongest(df: DataFrame, cols, top: int | None, min_abs: float) -> list[Row]:
    strong = pair_statistics(df, pair_list(cols)).where(F.abs("r") >= min_abs).orderBy(F.abs("r").desc(), "pair_order")
    return (strong.limit(top) if top else strong).collect()


def strongest_pairs(df: DataFrame, cols, top: int | None, min_abs: float = 0.3) -> list[tuple[str, str]]:
    """Names of the most correlated pairs, the default pairs of the pairwise analyses."""
    return [(r["col_a"], r["col_b"]) for r in _strongest(df, cols, top, min_abs)]


def pairwise_regression(df: DataFrame, pairs, p_values: bool = True) -> DataFrame:
    """``col_a, col_b, n, slope, intercept, r2, p_value`` of col_b regressed on col_a."""
    fit = pair_statistics(df, pairs).where((F.col("n") >= 4) & F.col("slope").isNotNull())
    fit = fit.withColumn("r2", F.col("r") * F.col("r"))
    if p_values:
        fit = fit.withColumn("p_value", slope_p_value("r", "n"))
    keep = ["col_a", "col_b", "n", "slope", "intercept", "r2"] + (["p_value"] if p_values else [])
    return fit.select(*keep)


def vif(df: DataFrame, cols) -> DataFrame:
    """``column, vif`` from the inverse of one correlation matrix over complete rows, made in one scan."""
    found = gram(df, cols)
    return df.sparkSession.createDataFrame(variance_inflation(found.correlation, found.n, found.cols), "column string, vif double")


def partial_correlation(df: DataFrame, cols, min_abs: float = 0.2, top: int | None = None) -> DataFrame:
    """``col_a, col_b, partial_r`` given all other columns, strongest first; one scan."""
    found = gram(df, cols)
    rows = partial_correlations(found.correlation, found.n, found.cols)
    pairs = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, partial_r double")
    out = pairs.where(F.abs("partial_r") >= min_abs).orderBy(F.abs("partial_r").desc(), "col_a", "col_b")
    return out.limit(top) if top else out


def frequency(df: DataFrame, cols, top: int = 10) -> DataFrame:
    """``column, value, cnt, share, rank`` of the most frequent values."""
    best = Window.partitionBy("column").orderBy(F.col("cnt").desc(), "value")
    counts = category_counts(df, cols)
    totals = counts.groupBy("column").agg(F.sum("cnt").alias("_n"))
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .join(F.broadcast(totals), "column")
        .select("column", "value", "cnt", (F.col("cnt") / F.col("_n")).alias("share"), "rank")
    )


def frequency_summary(df: DataFrame, cols) -> DataFrame:
    """``column, n, unique_count, top_value_share, long_tail_count`` (values under one percent)."""
    counts = category_counts(df, cols)
    totals = counts.groupBy("column").agg(F.sum("cnt").alias("n"))
    return (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(
            F.max("n").alias("n"),
            F.count(F.lit(1)).alias("unique_count"),
            (F.max("cnt") / F.max("n")).alias("top_value_share"),
            F.count_if(F.col("cnt") < F.col("n") * 0.01).alias("long_tail_count"),
        )
    )


def cardinality(df: DataFrame, cols) -> DataFrame:
    """``column, unique_count, cardinality_ratio, label``."""
    unique = F.col("unique_count")
    share = unique / F.greatest(F.col("n_rows"), F.lit(1))
    return distinct_counts(df, cols).select(
        "column",
        "unique_count",
        share.alias("cardinality_ratio"),
        F.when(unique == 2, "binary")
        .when(unique <= 10, "low")
        .when(unique <= 50, "medium")
        .when(share < 0.5, "high")
        .otherwise("near-unique")
        .alias("label"),
    )


def crosstab(df: DataFrame, pairs, max_values: int | None = None) -> DataFrame:
    """``col_a, val_a, col_b, val_b, cnt, row_share, marginal, deviation``; zero cells count.

    Row shares are rounded to three places before they are compared with the marginal, which runs over
    every row where col_b is present. Every pair is returned with its full grid; ``max_values`` leaves out pairs with
    a column of more values.
    """
    pairs = list(pairs)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    counts = category_counts(df, cols)
    sizes = counts.groupBy("column").agg(F.sum("cnt").alias("_n"))
    marginal = counts.join(F.broadcast(sizes), "column").select(
        F.col("column").alias("col_b"), F.col("value").alias("val_b"), (F.col("cnt") / F.col("_n")).alias("marginal")
    )
    return (
        full_table(pair_counts(df, cols, pairs), max_values)
        .join(marginal, ["col_b", "val_b"])
        .select(
            "col_a", "val_a", "col_b", "val_b", "cnt", F.round(F.col("cnt") / F.col("row_total"), 3).alias("row_share"), "marginal"
        )
        .withColumn("deviation", F.abs(F.col("row_share") - F.col("marginal")))
    )


def crosstab_summary(df: DataFrame, pairs) -> DataFrame:
    """``col_a, col_b, max_deviation``."""
    return crosstab(df, pairs).groupBy("col_a", "col_b").agg(F.max("deviation").alias("max_deviation"))


def segment_comparison(df: DataFrame, segment: str, metrics) -> DataFrame:
    """``segment_col, metric_col, group, mean, median, std, count, pct_diff_from_mean``."""
    by = F.col(segment).cast("string")
    base = df.where(F.col(segment).isNotNull()).withColumn("group", by)
    moments = column_moments(base, metrics, by=["group"]).drop("min", "max", "skew_pop", "kurt_pop", "n_rows")
    medians = ranked_quantiles(base, metrics, {"median": 0.5}, by=["group"]).drop("n", "unique_count")
    overall = column_moments(df, metrics).select("column", F.col("mean").alias("_overall"))
    return (
        moments.join(medians, ["group", "column"], "left")
        .join(F.broadcast(overall), "column")
        .select(
            F.lit(segment).alias("segment_col"),
            F.col("column").alias("metric_col"),
            "group",
            "mean",
            "median",
            "std",
            F.col("n").alias("count"),
            (ratio(F.col("mean") - F.col("_overall"), F.abs("_overall")) * 100).alias("pct_diff_from_mean"),
        )
    )


def segment_spread(df: DataFrame, segment: str, metrics) -> DataFrame:
    """``segment_col, metric_col, top_group, bottom_group, relative_spread``."""
    base = df.where(F.col(segment).isNotNull()).withColumn("group", F.col(segment).cast("string"))
    overall = column_moments(df, metrics).select("column", F.col("mean").alias("_overall"))
    return (
        column_moments(base, metrics, by=["group"])
        .where(F.col("mean").isNotNull())
        .groupBy("column")
        .agg(
            F.min(F.struct((-F.col("mean")).alias("m"), F.col("group").alias("g")))["g"].alias("top_group"),
            F.min(F.struct(F.col("mean").alias("m"), F.col("group").alias("g")))["g"].alias("bottom_group"),
            (F.max("mean") - F.min("mean")).alias("_spread"),
        )
        .join(F.broadcast(overall), "column")
        .select(
            F.lit(segment).alias("segment_col"),
            F.col("column").alias("metric_col"),
            "top_group",
            "bottom_group",
            F.coalesce(ratio(F.col("_spread"), F.abs("_overall")), F.lit(0.0)).alias("relative_spread"),
        )
    )


def interaction(df: DataFrame, segment: str, pairs) -> DataFrame:
    """``col_a, col_b, group, n, r`` for groups with five or more complete rows."""
    base = df.where(F.col(segment).isNotNull()).withColumn("group", F.col(segment).cast("string"))
    return pair_statistics(base, pairs, by=["group"]).where(F.col("n") >= 5).select("col_a", "col_b", "group", "n", "r")


def interaction_spread(df: DataFrame, segment: str, pairs) -> DataFrame:
    """``col_a, col_b, segment_col, spread``: the range of the rounded group correlations."""
    r = F.round("r", 3)
    return (
        interaction(df, segment, pairs)
        .groupBy("col_a", "col_b")
        .agg((F.max(r) - F.min(r)).alias("spread"))
        .select("col_a", "col_b", F.lit(segment).alias("segment_col"), "spread")
    )


def _one_way(groups: DataFrame, p_values: bool) -> DataFrame:
    """F test from group sizes, means and standard deviations (``metric_col, n, mean, std``)."""
    kept = groups.where(F.col("n") >= 3)
    grand = kept.groupBy("metric_col").agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum("n").alias("_n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"),
    )
    gap = F.col("mean") - F.col("_grand")
    sums = (
        kept.join(F.broadcast(grand.where(F.col("_k") >= 2)), "metric_col")
        .groupBy("metric_col")
        .agg(
            F.max("_k").alias("_k"),
            F.max("_n").alias("_n"),
            F.sum(F.col("n") * gap * gap).alias("_between"),
            F.sum((F.col("n") - 1) * F.col("std") * F.col("std")).alias("_within"),
        )
    )
    out = sums.select(
        "metric_col",
        ratio(F.col("_between") / (F.col("_k") - 1), ratio(F.col("_within"), F.col("_n") - F.col("_k"))).alias("statistic"),
        (F.col("_k") - 1).alias("df1"),
        (F.col("_n") - F.col("_k")).alias("df2"),
    )
    return out.withColumn("p_value", f_upper("statistic", F.col("df1").cast("double"), F.col("df2").cast("double"))) if p_values else out


def anova(df: DataFrame, segment: str, metrics, p_values: bool = True) -> DataFrame:
    """One-way F test over groups of three or more: ``metric_col, f_statistic, df1, df2, p_value, significant``."""
    base = df.where(F.col(segment).isNotNull())
    groups = column_moments(base, metrics, by=[segment]).withColumnRenamed("column", "metric_col")
    out = _one_way(groups, p_values).withColumnRenamed("statistic", "f_statistic")
    return out.withColumn("significant", F.col("p_value") < 0.05) if p_values else out


def _few_groups(df: DataFrame, segment: str, limit: int = 10_000) -> bool:
    """Are the groups few enough to broadcast a row of facts for each?"""
    return df.select(segment).distinct().limit(limit + 1).count() <= limit


def levene(df: DataFrame, segment: str, metrics, p_values: bool = True) -> DataFrame:
    """Median-centred test of equal variances: ``metric_col, statistic, df1, df2, p_value, equal_variance``.

    Medians and deviations both come from the per-group value counts, so rows are scanned once.
    """
    base = df.withColumn("_group", F.col(segment).cast("string"))
    counts = value_counts(base, metrics, by=["_group"])
    medians = ranked_values(counts, by=["_group"]).groupBy("_group", "column").agg(quantile(0.5).alias("_median"))
    gap = F.abs(F.col("value") - F.col("_median"))
    # Moments of the deviations with weights, about a mean taken in a first pass for accuracy.
    few = _few_groups(df, segment)
    deviations = counts.join(F.broadcast(medians) if few else medians, ["_group", "column"]).select("_group", "column", "cnt", gap.alias("d"))
    means = deviations.groupBy("_group", "column").agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("cnt") * F.col("d")) / F.sum("cnt")).alias("mean")
    )
    off = F.col("d") - F.col("mean")
    groups = (
        deviations.join(F.broadcast(means) if few else means, ["_group", "column"])
        .groupBy("_group", F.col("column").alias("metric_col"))
        .agg(
            F.max("n").alias("n"),
            F.max("mean").alias("mean"),
            F.sqrt(ratio(F.sum(F.col("cnt") * off * off), F.max("n") - 1)).alias("std"),
        )
    )
    out = _one_way(groups, p_values)
    return out.withColumn("equal_variance", F.col("p_value") > 0.05) if p_values else out


def chi_square(df: DataFrame, cols=None, pairs=None, p_values: bool = True) -> DataFrame:
    """Independence of column pairs: ``col_a, col_b, chi2, dof, p_value, cramers_v, significant``.

    The continuity correction applies to two-by-two tables; V divides by the number of all rows.
    """
    pairs = list(pairs) if pairs else pair_list(cols)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    cells = with_margins(pair_counts(df, cols, pairs))
    tables = cells.groupBy(*PAIR_KEY).agg(
        F.sum("cnt").alias("_n"), F.countDistinct("val_a").alias("_r"), F.countDistinct("val_b").alias("_c")
    )
    present = cells.join(F.broadcast(tables), PAIR_KEY).withColumn(
        "_e", F.col("row_total") * (F.col("col_total") / F.col("_n"))
    )
    gap = F.abs(F.col("cnt") - F.col("_e"))
    # Every cell of a two-by-two table is off by the same gap, so one cell and the margins give the rest.
    inverse = (F.col("_n") / F.col("row_total")) * (F.col("_n") / F.col("col_total"))
    other = ratio(inverse, (F.col("_n") / F.col("row_total") - 1) * (F.col("_n") / F.col("col_total") - 1))
    sums = present.groupBy("col_a", "col_b", "_n", "_r", "_c").agg(
        F.sum(gap * gap / F.col("_e")).alias("_present"),
        F.sum("_e").alias("_covered"),
        F.count(F.lit(1)).alias("_cells"),
        F.max(gap).alias("_gap"),
        F.max(F.when((F.col("_r") == 2) & (F.col("_c") == 2), inverse * other)).alias("_weights"),
    )
    # An empty cell contributes its expectation; none is missing when all cells are present.
    missing = F.when(F.col("_cells") < F.col("_r") * F.col("_c"), F.col("_n") - F.col("_covered")).otherwise(F.lit(0.0))
    shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    two_by_two = (F.col("_r") == 2) & (F.col("_c") == 2)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    smaller = F.least(F.col("_r"), F.col("_c")) - 1
    out = (
        sums.withColumn(
            "chi2",
            F.when(two_by_two, shrunk * shrunk * F.col("_weights") / F.col("_n")).otherwise(F.col("_present") + missing),
        )
        .crossJoin(F.broadcast(rows))
        .select(
            "col_a",
            "col_b",
            "chi2",
            ((F.col("_r") - 1) * (F.col("_c") - 1)).alias("dof"),
            F.sqrt(ratio(F.col("chi2"), F.col("_rows") * smaller)).alias("cramers_v"),
        )
    )
    if not p_values:
        return out
    return out.withColumn("p_value", chi2_upper("chi2", F.col("dof").cast("double"))).withColumn(
        "significant", F.col("p_value") < 0.05
    )
