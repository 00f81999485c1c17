import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablescout.operators import exploratory
from tablescout.plans import ranks, sequence, stats
from tablescout.plans import spectrum
from tablescout.plans.spectrum import dominant_frequency


def noisy(n=500, seed=1):
    g = np.random.default_rng(seed)
    x = np.round(g.lognormal(2, 1, n), 1)
    # A third of all rows hold one value.
    x[: n // 3] = 7.5
    return pd.DataFrame({"id": range(n), "g": g.integers(0, 3, n), "x": x, "y": g.normal(size=n)}).sample(frac=1, random_state=seed)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_quantiles_match_linear_interpolation(spark, partitions):
    pdf = noisy()
    df = spark.createDataFrame(pdf).repartition(partitions)
    points = {"a": 0.1, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0}
    for way in (ranks.quantiles, ranks.ranked_quantiles):
        for row in rows(way(df, ["x", "y"], points), "column"):
            assert [row[k] for k in points] == pytest.approx(list(pdf[row["column"]].quantile(list(points.values()))))
            assert row.get("unique_count") in (None, pdf[row["column"]].nunique())


def test_bracketed_quantiles_of_a_large_skewed_column(spark, monkeypatch):
    """Above the small size only the bracket is ranked, whatever the order and the hot values."""
    monkeypatch.setattr(ranks, "SMALL_COLUMN", 1_000)
    g = np.random.default_rng(6)
    x = np.concatenate([np.full(20_000, 3.0), g.lognormal(0, 3, 40_000)])
    for values in (np.sort(x), g.permutation(x)):
        df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
        points = {"a": 0.0005, "b": 0.1, "c": 0.5, "d": 0.67, "e": 0.9999}
        got = rows(ranks.quantiles(df, ["x"], points))[0]
        assert [got[k] for k in points] == pytest.approx(list(np.quantile(x, list(points.values()))), rel=1e-12)


def test_grouped_quantiles(spark):
    pdf = noisy()
    got = rows(ranks.ranked_quantiles(spark.createDataFrame(pdf), ["x"], {"m": 0.5}, by=["g"]), "g")
    assert [r["m"] for r in got] == pytest.approx(list(pdf.groupby("g")["x"].median()))


def test_ranks_and_prefix_sums(spark):
    pdf = noisy()
    df = spark.createDataFrame(pdf)
    got = {r["value"]: r for r in rows(ranks.ranked_values(ranks.value_counts(df, ["x"]), descending=True))}
    ordered = pdf["x"].sort_values(ascending=False).reset_index(drop=True)
    for value, row in got.items():
        assert row["before"] == (ordered > value).sum()
        assert row["sum_before"] == pytest.approx(ordered[ordered > value].sum())
        assert row["cnt"] == (ordered == value).sum()
    average = {r["value"]: r["avg_rank"] for r in ranks.average_ranks(ranks.value_counts(df, ["x"])).collect()}
    assert [average[v] for v in pdf["x"]] == list(pdf["x"].rank())


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    got = rows(ranks.quantiles(df, ["a", "b"], {"m": 0.5}))
    assert [(r["column"], r["m"], r["n"]) for r in got] == [("a", 2.0, 2)]


@pytest.mark.parametrize("partitions", [1, 5, 9])
def test_positions_equal_row_number(spark, partitions):
    pdf = pd.DataFrame({"t": [i % 4 for i in range(200)], "k": [i % 3 for i in range(200)], "v": [float(i % 11) for i in range(200)]})
    df = spark.createDataFrame(pdf).repartition(partitions)
    got = sequence.index_rows(df, ["t", "v"]).toPandas().sort_values("pos")
    assert list(got["pos"]) == list(range(200)) and set(got["n_rows"]) == {200}
    assert got[["t", "v"]].apply(tuple, axis=1).is_monotonic_increasing
    keyed = sequence.index_rows(df, ["t", "v"], keys=["k"]).toPandas().sort_values(["k", "pos"])
    for _, part in keyed.groupby("k"):
        assert list(part["pos"]) == list(range(len(part)))
        assert part[["t", "v"]].apply(tuple, axis=1).is_monotonic_increasing


def test_equal_rows_are_split_over_partitions(spark):
    df = spark.range(5000).select(F.lit(1).alias("t"), F.lit(2.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = sequence.index_rows(df, ["t", "v"])
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 4000
        assert placed.agg(F.countDistinct("pos"), F.max("pos")).first() == (5000, 4999)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series(spark, values, metric="m"):
    n = len(values)
    data = [(metric, i, i, n, n, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "metric string, pos long, idx long, n long, n_rows long, value double")


def test_running_totals_cross_blocks(spark, small_blocks):
    values = np.random.default_rng(3).normal(size=200)
    got = sequence.running_totals(series(spark, values), ["metric"], "idx", {"s": F.col("value")}).orderBy("idx").toPandas()
    assert np.allclose(got["s"], values.cumsum())


@pytest.mark.parametrize("width", [1, 5, 23, 100])
def test_rolling_sums_equal_a_frame(spark, small_blocks, width):
    values = np.random.default_rng(4).normal(size=150)
    got = sequence.rolling_sums(series(spark, values), ["metric"], "idx", F.lit(width), {"s": F.col("value")}).orderBy("idx").toPandas()
    assert np.allclose(got["s"], pd.Series(values).rolling(width, min_periods=1).sum())


def test_neighbours_cross_blocks(spark, small_blocks):
    values = list(range(100))
    got = sequence.with_neighbours(
        series(spark, values), ["metric"], "idx", {"a": ("value", -1), "b": ("value", 1), "c": ("value", -6)}
    ).orderBy("idx").toPandas()
    assert len(got) == 100
    expected = pd.Series(values, dtype=float)
    for name, shift in {"a": 1, "b": -1, "c": 6}.items():
        pd.testing.assert_series_equal(got[name], expected.shift(shift), check_names=False)


def test_series_with_nulls_number_present_values(spark, small_blocks):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=40), "v": [None if i % 3 == 0 else float(i) for i in range(40)]})
    got = sequence.row_series(spark.createDataFrame(pdf), "t", ["v"]).orderBy("idx").toPandas()
    assert list(got["idx"]) == list(range(26)) and set(got["n"]) == {26} and set(got["n_rows"]) == {40}
    assert list(got["pos"]) == [i for i in range(40) if i % 3]


def test_pair_statistics_on_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    got = rows(stats.pair_statistics(df, [("a", "b"), ("a", "c")]), "col_b")
    assert [(r["n"], r["r"]) for r in got] == [(3, None), (0, None)]


@pytest.mark.parametrize("n,limit", [(48, 16), (97, 10), (64, 1000), (150, 20)])
def test_distributed_transform_equals_numpy(spark, n, limit):
    """Lengths with a divisor use it; a prime length goes through the chirp identity."""
    g = np.random.default_rng(n)
    values = g.normal(size=n) + np.sin(np.arange(n) * 2 * np.pi * 5 / n)
    df = series(spark, values).select("metric", "idx", "n", "value")
    got = dominant_frequency(df, limit).collect()[0]
    size = np.abs(np.fft.rfft(values))[1:]
    assert got["dominant_k"] == int(size.argmax()) + 1
    assert got["magnitude"] == pytest.approx(size.max())


def test_distributed_transform_sends_half_and_returns_little(spark):
    """No branch for short series where there is none, and the second grouping gets the lower rows only."""
    n = 3600
    df = spark.range(n).selectExpr("'v' AS metric", "id AS idx", f"{n}L AS n", "sin(id * 0.3) + id % 7 AS value")
    plan = dominant_frequency(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") in (2, 4)  # the adaptive plan may be shown twice
    turned = spectrum._by_columns_real(df.selectExpr("metric", "idx AS j", "value AS re"), 60, 60)
    assert turned.count() == 31 * 60
    assert spectrum._strongest(turned, 60, 60, -1, n, True).count() == 31


def test_neighbours_further_than_a_block(spark, small_blocks):
    df = spark.range(60).selectExpr("id as pos", "id * 10 as v")
    far = {"a": ("v", -20), "b": ("v", 17), "c": ("v", -7), "d": ("v", 8)}
    got = {r["pos"]: r for r in sequence.with_neighbours(df, [], "pos", far).collect()}
    for i in range(60):
        want = {n: (i + o) * 10 if 0 <= i + o < 60 else None for n, (_, o) in far.items()}
        assert {n: got[i][n] for n in far} == want


def test_neighbours_are_sorted_by_more_tasks_than_a_shuffle_has(spark):
    wide = sequence.with_neighbours(spark.range(60).selectExpr("id as pos", "id * 10 as v"), [], "pos", {"a": ("v", -1)})
    tasks = sequence.TASKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {tasks}), REPARTITION_BY_NUM" in wide._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_used(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2.0D as x", "id * 3.0D as y", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(ranks.quantiles(df, ["x"], {"m": 0.5}))
    assert "ReadSchema: struct<x:double>" in plan and "y:double" not in plan


def test_rows_are_never_brought_to_one_partition(spark, tmp_path):
    from tablescout.operators import timeseries

    spark.range(100).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) as t", "cast(id as double) as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    made = sequence.row_series(df, "t", ["v"])
    for frame in (timeseries.trend(made), timeseries.peaks_valleys(made), timeseries.rolling_volatility(made, window=5)):
        for line in plan_of(frame).split("Exchange SinglePartition")[1:]:
            # What reaches one partition is a partial aggregate or the per-partition sizes, never rows.
            below = line.split("\n")[1]
            assert "HashAggregate" in below or "SortAggregate" in below, below


def test_gaps_are_counted_along_rows_before_they_are_one_for_each_metric(spark, small_blocks):
    data = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), float(i) if i % 3 else None, float(-i) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(data, "t timestamp_ntz, x double, y double")
    series = sequence.row_series(df, "t", ["x", "y"])
    got = sorted((r["metric"], r["idx"], r["pos"], r["n"], r["n_rows"], r["value"]) for r in series.collect())
    want = [("x", i, p, 40, 60, float(p)) for i, p in enumerate(p for p in range(60) if p % 3)]
    want += [("y", i, p, 48, 60, float(-p)) for i, p in enumerate(p for p in range(60) if p % 5)]
    assert got == want
    windows = [line for line in series._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert windows and not any("metric" in line for line in windows)


def test_rank_correlations_of_hot_and_coarse_values_zeros_and_large_whole_numbers(spark):
    g = np.random.default_rng(3)
    n = 3_000
    pdf = pd.DataFrame({"a": g.normal(size=n), "few": g.integers(0, 3, n).astype(float), "hot": np.where(g.random(n) < 0.6, 7.5, g.lognormal(0, 3, n))})
    pdf["sum"] = pdf["a"] + pdf["few"]
    pdf["zero"] = np.where(g.random(n) < 0.5, -0.0, 0.0) + np.where(g.random(n) < 0.3, pdf["a"], -0.0)
    # As doubles these would all be one value.
    pdf["large"] = 2**60 + pdf["few"].astype(int) + g.integers(0, 9, n)
    pairs = [("a", "sum"), ("few", "sum"), ("hot", "few"), ("zero", "a"), ("large", "few")]
    got = {(r["col_a"], r["col_b"]): r["spearman"] for r in exploratory.spearman(spark.createDataFrame(pdf).repartition(5), pairs).collect()}
    assert got == {p: pytest.approx(pdf[p[0]].rank().corr(pdf[p[1]].rank()), abs=1e-9) for p in pairs}


def test_columns_are_ranked_with_one_shuffle_and_coarse_ones_with_none(spark, tmp_path):
    made = spark.range(4_000).selectExpr("cast(id as double) as a", "id * id + 0.5D as b", "cast(id % 5 as double) as few")
    made.write.parquet(str(tmp_path / "t"))
    plan = plan_of(exploratory.spearman(spark.read.parquet(str(tmp_path / "t")), [("a", "b"), ("a", "few")]))
    # Equal rows meet once, then each of the two columns that are not coarse moves them once.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("FileScan") == 1


def test_pair_statistics_of_a_correlation_are_made_once(spark, monkeypatch):
    calls = []
    counted = lambda *args, **kinds: calls.append(args) or stats.pair_statistics(*args, **kinds)
    monkeypatch.setattr(exploratory, "pair_statistics", counted)
    df = spark.createDataFrame([(float(i), i * 2.0, float(-i)) for i in range(9)], "a double, b double, c double")
    got = rows(exploratory.correlation(df, ["a", "b", "c"], top=2), "col_a", "col_b")
    want = [("a", "b", 9, 1.0, 1.0), ("a", "c", 9, -1.0, -1.0)]
    assert [(r["col_a"], r["col_b"], r["n"], round(r["pearson"], 9), round(r["spearman"], 9)) for r in got] == want
    assert len(calls) == 1
