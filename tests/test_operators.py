import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import only, rows
from tablescout.operators import anomaly, business, candidates, exploratory, findings, foundation, ranking, signals, structure, text, timeseries
from tablescout.operators.sampling import representative_rows
from tablescout.plans.sequence import calendar_series, row_series
from tablescout.sources.tables import nan_to_null, read_table, with_time, write_results


def gaps(spark):
    data = [
        (1, 1.0, None, "x", None),
        (2, None, None, None, None),
        (3, 3.0, None, "X", "2024-01-03"),
        (4, float("nan"), None, "y", "2024-01-04"),
    ]
    return nan_to_null(spark.createDataFrame(data, "id long, a double, b double, c string, d string"))


def test_nan_is_null(spark):
    assert gaps(spark).where("a is null").count() == 2


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("day,amount,kind\n2024-01-01,1.5,a\n2024-01-02,2.5,b\n,3.5,a\n")
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes)["amount"] == "double" and df.count() == 3
    assert with_time(df, "day").count() == 2
    write_results({"counts": df.groupBy("kind").count()}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("operator").distinct().collect()[0][0] == "counts"


@pytest.mark.parametrize("written", ["2024-03-05", "3/5/2024", "Mar 5, 2024", "2024-03-05 00:00:00", "2024/03/05", "05-Mar-2024"])
def test_written_dates(spark, written):
    df = with_time(spark.createDataFrame([(written,), ("no date",), (None,)], "d string"), "d")
    assert [str(r["d"]) for r in df.collect()] == ["2024-03-05 00:00:00"]


def test_roles_with_dates_flags_and_empty_columns(spark):
    n = 60
    pdf = pd.DataFrame(
        {
            "order_ref": [f"r{i}" for i in range(n)],
            "day": [f"2024-01-{i % 28 + 1:02d}" for i in range(n)],
            "ok": [i % 2 == 0 for i in range(n)],
            "note": [f"a rather long remark that differs in every row, number {i}" for i in range(n)],
            "kind": ["a", "b"] * (n // 2),
            "amount": [float(i) for i in range(n)],
            "few": [float(i % 5) for i in range(n)],
        }
    )
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    got = {r["column"]: r["role"] for r in foundation.infer_roles(df).collect()}
    assert got == {
        "order_ref": "id_col", "day": "datetime", "ok": "boolean", "note": "text", "kind": "categorical",
        "amount": "id_col", "few": "numeric", "none": "numeric",
    }
    assert foundation.detect(df, mode="strict").numeric == ["amount", "few", "none"]
    sketch = {r["column"]: r["role"] for r in foundation.infer_roles(df, exact=False).collect()}
    assert sketch == got


def test_nested_columns_are_left_out(spark):
    df = spark.range(3).withColumn("v", F.array(F.lit(1.0)))
    assert [r["column"] for r in foundation.infer_roles(df).collect()] == ["id"]


def test_quality_of_gaps(spark):
    df = gaps(spark)
    assert [(r["column"], r["null_rate"]) for r in foundation.quality_gate(df).collect()] == [("b", 1.0)]
    quality = only(foundation.data_quality(df, ["c"]))
    assert (quality["columns_with_nulls"], quality["high_null_columns"], quality["case_issue_columns"]) == (4, 4, 1)
    assert quality["overall_null_rate"] == pytest.approx((0 + 0.5 + 1 + 0.25 + 0.5) / 5)
    assert only(foundation.duplicate_count(df.select("a"), ["a"]))["duplicate_count"] == 1


def test_profile_leaves_out_empty_columns(spark):
    got = rows(foundation.numeric_profile(gaps(spark), ["a", "b"]))
    assert [r["column"] for r in got] == ["a"]
    assert (got[0]["mean"], got[0]["p50"], got[0]["null_rate"]) == (2.0, 2.0, 0.5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y double, g string")
    assert rows(exploratory.distribution(df, ["x"])) == []
    assert rows(exploratory.outliers(df, ["x"])) == []
    assert rows(exploratory.anova(df, "g", ["x"])) == []
    assert rows(ranking.composite_score(df, ["x", "y"])) in ([], [{"n": 0, "p90_threshold": None, "p10_threshold": None, "top_10pct_count": 0, "min_score": None, "max_score": None}])
    assert rows(business.pareto(df, ["x"])) == []
    assert only(foundation.data_quality(df))["row_count"] == 0


@pytest.mark.parametrize("n", [3, 4, 7, 8])
def test_minimum_sizes(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    assert bool(rows(exploratory.distribution(df, ["x"]))) == (n >= 4)
    assert bool(rows(exploratory.outliers(df, ["x"]))) == (n >= 4)
    assert bool(rows(exploratory.normality(df, ["x"]))) == (n >= 8)
    assert bool(rows(ranking.tiers(df, ["x"]))) == (n >= 6)


def test_constant_column(spark):
    df = spark.range(20).select(F.lit(3.0).alias("x"), F.lit("a").alias("g"))
    row = only(exploratory.distribution(df, ["x"]))
    assert (row["skewness"], row["kurtosis"], row["shape"]) == (0.0, 0.0, "symmetric")
    assert only(exploratory.outliers(df, ["x"]))["zscore_outlier_count"] == 0
    assert rows(exploratory.normality(df, ["x"])) == []
    assert rows(signals.outlier_prevalence(df, ["x"])) == []
    assert only(exploratory.cardinality(df, ["g"]))["label"] == "low"
    assert only(business.gini(df, ["x"]))["gini"] == pytest.approx(0.0)


def test_moments_match_pandas(spark):
    x = np.random.default_rng(5).gamma(2, size=300)
    row = only(exploratory.distribution(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]))
    assert row["skewness"] == pytest.approx(pd.Series(x).skew())
    assert row["kurtosis"] == pytest.approx(pd.Series(x).kurt())


def two_by_two(spark):
    cells = [("a", "p", 10), ("a", "q", 20), ("b", "p", 30), ("b", "q", 5)]
    return spark.createDataFrame([(a, b) for a, b, k in cells for _ in range(k)], "a string, b string")


def test_continuity_correction(spark):
    row = only(exploratory.chi_square(two_by_two(spark), ["a", "b"]))
    n, e = 65, 30 * 40 / 65
    gap = abs(10 - e) - 0.5
    expected = gap * gap * sum(1 / (r * c / n) for r in (30, 35) for c in (40, 25))
    assert row["chi2"] == pytest.approx(expected) and row["dof"] == 1
    assert row["cramers_v"] == pytest.approx((expected / 65) ** 0.5) and row["significant"]


def test_two_by_two_with_an_empty_cell(spark):
    df = two_by_two(spark).where("not (a = 'b' and b = 'q')")
    row = only(exploratory.chi_square(df, ["a", "b"]))
    n, e = 60, 30 * 40 / 60
    gap = abs(10 - e) - 0.5
    assert row["chi2"] == pytest.approx(gap * gap * sum(1 / (r * c / n) for r in (30, 30) for c in (40, 20)))


def test_one_valued_column_is_independent(spark):
    row = only(exploratory.chi_square(two_by_two(spark).withColumn("b", F.lit("z")), ["a", "b"]))
    assert (row["chi2"], row["dof"], row["p_value"]) == (pytest.approx(0.0), 0, 1.0)


def groups(spark):
    data = {"g": list("aaaabbbbcccc") + ["d", "d", None], "x": [6, 8, 4, 5, 8, 12, 9, 11, 13, 9, 11, 8, 99, 98, 1]}
    return spark.createDataFrame(pd.DataFrame(data)).withColumn("x", F.col("x").cast("double"))


def test_anova_ignores_small_and_null_groups(spark):
    row = only(exploratory.anova(groups(spark), "g", ["x"]))
    parts = [np.array(v, float) for v in ([6, 8, 4, 5], [8, 12, 9, 11], [13, 9, 11, 8])]
    grand = np.concatenate(parts).mean()
    between = sum(len(p) * (p.mean() - grand) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / 9
    assert row["f_statistic"] == pytest.approx(between / within)
    assert row["p_value"] == pytest.approx((9 / (9 + 2 * between / within)) ** 4.5)


def test_levene_is_median_centred(spark):
    row = only(exploratory.levene(groups(spark), "g", ["x"]))
    parts = [np.abs(np.array(v, float) - np.median(v)) for v in ([6, 8, 4, 5], [8, 12, 9, 11], [13, 9, 11, 8])]
    grand = np.concatenate(parts).mean()
    between = sum(len(p) * (p.mean() - grand) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / 9
    assert row["statistic"] == pytest.approx(between / within)


def test_regression_p_value(spark):
    x = np.arange(12.0)
    y = 2 * x + np.array([1, -1, 2, -2, 1, 0, 3, -3, 1, -1, 0, 2.0])
    row = only(exploratory.pairwise_regression(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), [("x", "y")]))
    slope, intercept = np.polyfit(x, y, 1)
    assert (row["slope"], row["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    assert 0 < row["p_value"] < 1e-6


def test_vif_and_partial_correlation_by_least_squares(spark):
    g = np.random.default_rng(8)
    a, b = g.normal(size=200), g.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": b, "c": a + 0.5 * b + 0.3 * g.normal(size=200), "k": 1.0})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r["vif"] for r in exploratory.vif(df, ["a", "b", "c", "k"]).collect()}
    assert set(got) == {"a", "b", "c"}
    design = np.column_stack([np.ones(200), pdf["a"], pdf["b"]])
    fitted = design @ np.linalg.lstsq(design, pdf["c"], rcond=None)[0]
    r2 = 1 - ((pdf["c"] - fitted) ** 2).sum() / ((pdf["c"] - pdf["c"].mean()) ** 2).sum()
    assert got["c"] == pytest.approx(1 / (1 - r2))
    partial = {(r["col_a"], r["col_b"]): r["partial_r"] for r in exploratory.partial_correlation(df, ["a", "b", "c"], 0.0).collect()}
    rest = lambda y: y - np.column_stack([np.ones(200), b]) @ np.linalg.lstsq(np.column_stack([np.ones(200), b]), y, rcond=None)[0]
    assert partial[("a", "c")] == pytest.approx(np.corrcoef(rest(a), rest(pdf["c"].to_numpy()))[0, 1])


def test_perfect_collinearity_is_infinite(spark):
    df = spark.range(50).selectExpr("cast(id as double) a", "cast(id * 2 + 1 as double) b", "cast(id * id % 7 as double) c")
    got = {r["column"]: r["vif"] for r in exploratory.vif(df, ["a", "b", "c"]).collect()}
    assert got["a"] == float("inf") and got["c"] < 2


# --- series ---------------------------------------------------------------------------------------


def dated(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"t": pd.date_range("2020-01-01", periods=n), **columns}))


def test_all_changepoints_are_returned(spark):
    series = row_series(dated(spark, v=[float(i) for i in range(1, 20)]), "t", ["v"])
    assert [r["cp_index"] for r in rows(timeseries.changepoints(series).orderBy("cp_index"))] == [3, 7, 11, 15]
    assert timeseries.changepoints(series, top=3).count() == 3


def test_step_is_a_changepoint(spark, small_blocks):
    values = [10.0] * 60 + [20.0] * 40
    got = rows(timeseries.changepoints(row_series(dated(spark, v=values), "t", ["v"])), "cp_index")
    expected, last, mean = [], None, np.mean(values)
    for i in range(20, 80):
        if abs(np.mean(values[i:]) - np.mean(values[:i])) / mean > 0.15 and (last is None or i - last > 20):
            expected.append(i)
            last = i
    assert [r["cp_index"] for r in got] == expected[:3]
    assert str(got[0]["cp_date"])[:10] == str(pd.date_range("2020-01-01", periods=100)[expected[0]])[:10]


def test_sine_has_its_period(spark, small_blocks):
    values = np.sin(np.arange(120) * 2 * np.pi / 12)
    df = dated(spark, v=values)
    assert only(timeseries.long_cycles(row_series(df, "t", ["v"])))["dominant_period"] == 12
    assert only(timeseries.cycles(calendar_series(df, "t", ["v"])))["dominant_period"] == 12


def test_detrending_windows_of_short_series(spark):
    values = np.random.default_rng(1).normal(size=8)
    got = timeseries.detrended(row_series(dated(spark, v=values), "t", ["v"])).orderBy("idx").toPandas()["value"]
    assert np.allclose(got, values - pd.Series(values).rolling(4, min_periods=1).mean())


def test_trend_of_a_line(spark):
    row = only(timeseries.trend(row_series(dated(spark, v=[1.0, 2.0, 3.0, 4.0, 5.0]), "t", ["v"])))
    assert (row["slope"], row["r_squared"], row["direction"]) == (pytest.approx(1.0), pytest.approx(1.0), "upward")
    assert row["p_value"] < 1e-12
    assert row["total_pct_change"] == pytest.approx(5 / 3 * 100)


def test_lead_and_lag(spark, small_blocks):
    b = np.random.default_rng(2).normal(size=90)
    a = np.concatenate([np.zeros(3), b[:-3]])
    row = only(timeseries.lag_correlation(dated(spark, a=a, b=b), "t", ["a", "b"]))
    assert (row["best_lag"], row["leader"]) == (3, "b") and row["r"] > 0.95


def test_lag_limit_follows_length(spark):
    b = np.random.default_rng(2).normal(size=16)
    a = np.concatenate([np.zeros(6), b[:-6]])
    got = rows(timeseries.lag_correlation(dated(spark, a=a, b=b), "t", ["a", "b"], min_abs=0.0))
    assert got[0]["best_lag"] <= 4


def test_smoothing_equals_the_recursion(spark):
    values = [5.0, 7.0, 4.0, 9.0, 6.0, 8.0, 7.0, 5.0, 6.0, 10.0]
    row = only(timeseries.forecast_baseline(row_series(dated(spark, v=values), "t", ["v"])))
    level = values[0]
    for v in values[:8]:
        level = 0.3 * v + 0.7 * level
    assert row["next_period_forecast"] == pytest.approx(level)
    assert row["naive_mape"] == pytest.approx(np.mean([1 / 6, 5 / 10]) * 100)


def test_forecast_of_zeros_and_constants(spark):
    zero = only(timeseries.forecast_baseline(row_series(dated(spark, v=[0.0] * 10), "t", ["v"])))
    assert zero["naive_mape"] is None and zero["best_method"] is None
    flat = only(timeseries.forecast_baseline(row_series(dated(spark, v=[4.0] * 10), "t", ["v"])))
    assert flat["naive_mape"] is None and flat["best_method"] == "naive"


def test_zero_start_has_no_growth_rate(spark):
    row = only(timeseries.growth_rate(row_series(dated(spark, v=[0.0, 2.0, 4.0]), "t", ["v"])))
    assert row["total_pct_change"] == 0.0 and row["cagr_pct"] is None and row["avg_period_growth_pct"] == pytest.approx(100.0)


def test_zero_peak_has_no_swing(spark):
    row = only(timeseries.peaks_valleys(row_series(dated(spark, v=[-1.0, 0.0, -1.0, -2.0, -1.0, -3.0]), "t", ["v"])))
    assert (row["peak_count"], row["valley_count"], row["max_peak"], row["swing_pct"]) == (2, 1, 0.0, None)


def test_drift_and_quarters_split_tied_times(spark):
    pdf = pd.DataFrame({"t": pd.to_datetime(["2024-01-01"] * 3 + ["2024-01-02"] * 10 + ["2024-01-03"] * 3), "k": range(16)})
    pdf["c"] = ["a" if k < 8 else "b" for k in pdf["k"]]
    pdf["v"] = pdf["k"].astype(float)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=0))
    got = rows(timeseries.category_drift(df, "t", ["c"], ["k"]), "category")
    assert [(r["early_share"], r["late_share"]) for r in got] == [(1.0, 0.0), (0.0, 1.0)]
    growth = only(signals.growth_signal(df, "t", ["v"], ["k"]))
    assert (growth["early_mean"], growth["late_mean"]) == (1.5, 13.5)


def test_one_time_for_all_rows(spark):
    df = spark.range(40).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("t"), F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    growth = only(signals.growth_signal(df, "t", ["v"], ["k"]))
    assert (growth["early_mean"], growth["late_mean"]) == (4.5, 34.5)
    coverage = only(signals.temporal_coverage(df, "t"))
    assert (coverage["span_days"], coverage["granularity"], coverage["gap_count"]) == (0, "daily", 0)


def test_coverage_finds_gaps(spark):
    days = [0, 7, 14, 21, 60, 67]
    pdf = pd.DataFrame({"t": [pd.Timestamp("2024-01-01") + pd.Timedelta(days=d) for d in days]})
    row = only(signals.temporal_coverage(spark.createDataFrame(pdf), "t"))
    assert (row["granularity"], row["gap_count"], row["span_days"], row["date_min"]) == ("weekly", 1, 67, "2024-01-01")


# --- ranking and business -------------------------------------------------------------------------


def test_percentile_rank_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "x double")
    got = [r["pct_rank"] for r in ranking.with_percentile_rank(df, "x").orderBy("x").collect()]
    assert got == [None, 0.25, 0.625, 0.625, 1.0]


def test_pareto_by_brute_force(spark):
    g = np.random.default_rng(9)
    x = np.concatenate([g.pareto(1.2, 200).round(1), np.full(100, 2.5), [-4.0, 0.0]])
    row = only(business.pareto(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]))
    s = np.sort(x[x > 0])[::-1]
    c, n = s.cumsum(), len(s)
    assert row["top_20pct_share"] == pytest.approx(c[int(n * 0.2) - 1] / s.sum())
    assert row["pct_rows_for_80pct"] == pytest.approx((c <= s.sum() * 0.8).sum() / n)
    up = s[::-1]
    assert row["gini"] == pytest.approx((2 * (np.arange(1, n + 1) * up).sum() - (n + 1) * up.sum()) / (n * up.sum()))


def test_benchmark_with_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 20 + [50.0, None]], "x double")
    row = only(business.benchmark(df, ["x"]))
    assert (row["above_2std_count"], row["below_2std_count"]) == (1, 0)


def test_single_month_has_no_cohorts(spark):
    df = dated(spark, v=[1.0, 2.0])
    assert rows(business.cohorts(df, "t", "v")) == []
    assert rows(business.retention(business.cohorts(df, "t", "v"))) == []
    assert rows(business.decompose(df, "t", "v", "v")) == []


def test_funnel_in_given_order(spark):
    df = spark.createDataFrame([("view",)] * 10 + [("buy",)] * 4 + [("cart",)] * 5, "s string")
    got = business.funnel(df, "s", ["view", "cart", "buy"]).collect()
    by = {r["stage"]: r["conversion_from_prev"] for r in got}
    assert by == {"view": pytest.approx(10 / 19, abs=1e-4), "cart": 0.5, "buy": 0.8}


# --- text and anomaly -----------------------------------------------------------------------------


def test_patterns(spark):
    data = [("mail me: a.b@c.org",), ("call +1 (555) 010-9999",), ("see https://x.y/z",), ("on 2024-01-31",), ("costs €12.50",), ("zip 12345-6789",), (None,)]
    got = {r["pattern"]: r["match_count"] for r in text.pattern_counts(spark.createDataFrame(data, "t string"), ["t"]).collect()}
    assert set(got) == {"email", "phone", "url", "date_string", "currency", "postal_code"}
    assert got["email"] == got["url"] == got["currency"] == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@pytest.mark.parametrize("min_sim", [0.6, 0.8])
def test_near_duplicates_by_brute_force(spark, min_sim):
    g = np.random.default_rng(11)
    base = ["".join(g.choice(list("abcd "), size=g.integers(3, 14))) for _ in range(60)]
    changed = []
    for w in base:
        letters = list(w)
        for _ in range(g.integers(1, 3)):
            at = g.integers(0, len(letters))
            letters[at : at + 1] = g.choice(["", "x", "ab"])
        changed.append("".join(letters).upper())
    values = sorted({v for v in base + changed + ["New York", "new york", "New Yrok", "Newyork"] if v})
    got = {(r["value_a"], r["value_b"]) for r in text.near_duplicate_values(spark.createDataFrame([(v,) for v in values], "v string"), ["v"], min_sim).collect()}
    expected = set()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            x, y = a.lower().strip(), b.lower().strip()
            if x and y and x != y and 1 - edit_distance(x, y) / max(len(x), len(y)) >= min_sim - 1e-12:
                expected.add((a, b))
    assert got == expected


def test_near_duplicates_of_one_host_meet_few_others(spark, monkeypatch):
    """Short and longer values by brute force, and values that share host and ending are not compared pair by pair."""
    g = np.random.default_rng(5)
    values = [f"https://www.host.example.net/en/{n}{e}" for n in g.integers(100_000, 100_999, 40) for e in ("", "0", ".html", "?utm_source=feed&page=2")]
    values = sorted({*values, *[v.replace("https", "http") for v in values[:20]], *[v.replace("/en/", "/e/") for v in values[:20]], "a", "b"})
    df = spark.createDataFrame([(v,) for v in values], "v string")
    expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if edit_distance(a, b) <= max(len(a), len(b)) * 0.05 + 1e-9}
    for most in (text.SHORTENED, 900):
        monkeypatch.setattr(text, "SHORTENED", most)
        assert {(r["value_a"], r["value_b"]) for r in text.near_duplicate_values(df, ["v"], 0.95).collect()} == expected
    monkeypatch.undo()
    held = spark.createDataFrame([(i, f"https://www.host.example.net/en/{n}") for i, n in enumerate(range(100_003, 999_999, 449))], "_id long, key string")
    assert text._meet_shortened(held, 0.95).count() < 10 * held.count()


def test_levels_score_as_nodes_do(spark, monkeypatch):
    """Trees laid out by levels give the score of a walk from node to node, at cuts and beyond all points too."""
    g = np.random.default_rng(4)
    points = [(float(a), float(b)) for a, b in g.integers(0, 9, (300, 2))] + [(1e9, -1e9), (4.0, 4.0)]
    df = spark.createDataFrame(points, "a double, b double")
    forest = anomaly.train_forest(df, ["a", "b"], trees=5, sample=40)
    calls = []
    whole = anomaly._level_by_level
    monkeypatch.setattr(anomaly, "_level_by_level", lambda *a: calls.append(a) or whole(*a))
    by_levels = [r.s for r in df.select(anomaly.forest_score(forest, ["a", "b"]).alias("s")).collect()]
    assert len(calls) == 5
    monkeypatch.setattr(anomaly, "_LEVELS", 0)
    assert [r.s for r in df.select(anomaly.forest_score(forest, ["a", "b"]).alias("s")).collect()] == by_levels


def test_planted_outliers_are_found(spark):
    g = np.random.default_rng(0)
    x = np.vstack([g.normal(size=(2000, 4)), g.normal(12, 1, size=(20, 4)) * g.choice([-1, 1], size=(20, 1))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(2020)))
    scored = anomaly.isolation_forest(df, list("abcd"))
    flagged = {r["id"] for r in scored.where("is_anomaly").collect()}
    assert set(range(2000, 2020)) <= flagged and len(flagged) == 101
    top = [r["id"] for r in scored.orderBy(F.col("anomaly_score").desc()).limit(20).collect()]
    assert len(set(top) & set(range(2000, 2020))) >= 18


def test_copies_have_their_weight_in_every_tree(spark):
    values = np.random.default_rng(1).uniform(1, 2, (2000, 2)).tolist() + [[0.0, 0.0]] * 1000
    df = spark.createDataFrame(values, "a double, b double")
    forest = anomaly.train_forest(df.repartition(3), ["a", "b"], sample=60)
    assert len(forest) == 50 and forest == anomaly.train_forest(df.repartition(7), ["a", "b"], sample=60)
    for tree in forest:
        at = depth = 0
        while tree["feature"][at] >= 0:
            at, depth = tree["left"][at], depth + 1
        # About 20 of 60 rows are the copies at the low end; the leaf's length stands for those it could not part.
        assert anomaly._path_length(np.array([5]))[0] < tree["length"][at] - depth < anomaly._path_length(np.array([40]))[0]


def test_forest_of_many_rows_samples_all_trees(spark):
    df = spark.range(40_000).selectExpr("cast(id % 997 as double) a", "cast(id % 31 as double) b")
    forest = anomaly.train_forest(df, ["a", "b"])
    assert len(forest) == 50 and all(t["size"] == 256 for t in forest)


def test_few_or_equal_rows_have_no_anomalies(spark):
    assert rows(anomaly.anomaly_score(spark.range(9).selectExpr("cast(id as double) a", "cast(id as double) b"), ["a", "b"])) == []
    same = only(anomaly.anomaly_score(spark.range(30).selectExpr("1.0D a", "2.0D b"), ["a", "b"]))
    assert same["anomaly_count"] == 0


def test_missing_patterns(spark):
    got = {(r["col_a"], r["col_b"]): r["both_null_count"] for r in anomaly.co_missing(gaps(spark)).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1, ("b", "d"): 2, ("a", "c"): 1, ("a", "d"): 1, ("c", "d"): 1}
    row = only(anomaly.missing_rows(gaps(spark)))
    assert (row["null_columns"], row["rows_mostly_null"], row["rows_all_null"]) == (4, 1, 0)


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "i int, s string")
    assert only(anomaly.duplicates(df))["exact_duplicate_count"] == 1
    assert rows(anomaly.duplicate_groups(df))[0]["copies"] == 2


def test_systematic_nulls(spark):
    df = spark.createDataFrame([(None, None, 1.0)] * 3 + [(1.0, 1.0, None)] * 7, "a double, b double, c double")
    got = {r["column"]: r["pattern"] for r in signals.null_intent(df, ["a", "b", "c"]).collect()}
    assert got == {"a": "systematic", "b": "systematic", "c": "distributed"}


# --- screens, candidates and findings ---------------------------------------------------------------


def test_flags_in_disguise(spark):
    df = spark.createDataFrame([(0, " Yes", 0), (1, "no", 2), (None, None, 1)], "z int, q string, w int")
    got = {r["column"]: r["disguised_as"] for r in structure.boolean_disguise(df, ["z", "w"], ["q"]).collect()}
    assert got == {"z": "numeric 0/1", "q": "string/no/yes"}


def test_pool_keeps_the_most_confident(spark):
    data = [
        ("question", "a", 0, "L", "first", 0.8), ("question", "b", 1, "L", "second", 0.9),
        ("question", "c", 2, "M", "x", 0.7), ("question", "d", 3, "M", "y", 0.7),
    ]
    got = candidates.pool([spark.createDataFrame(data, candidates.SCHEMA)]).collect()
    assert [(r["label"], r["description"]) for r in got] == [("L", "second"), ("M", "x")]


def test_pages_skip_known_labels(spark):
    data = [("question", "s", i, f"Label {c}", "", 0.9 - i / 100) for i, c in enumerate("ABCDEFG")]
    frame = spark.createDataFrame(data, candidates.SCHEMA)
    known = spark.createDataFrame([("label a",), ("what about Label C?",)], "label string")
    first = candidates.next_page(frame, known, 1).orderBy("position").collect()
    assert [r["label"] for r in first] == ["Label B", "Label D", "Label E"] and all(r["has_more"] for r in first)
    second = candidates.next_page(frame, known, 2).collect()
    assert sorted(r["label"] for r in second) == ["Label F", "Label G"] and not any(r["has_more"] for r in second)


def test_edges_keep_the_first_direction(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 0), ("a", "c", 2)], "s string, t string, k int")
    assert rows(candidates.unique_edges(edges, "s", "t", ["k"]), "t") == [{"s": "b", "t": "a", "k": 0}, {"s": "a", "t": "c", "k": 2}]


def test_figures_are_searched_for_once(spark):
    """Each pattern is looked for once in a whole text; between, start, end and parts of matches are as the regex gives them."""
    data = [(1, "5% 6.5 %7%x 8 %"), (2, "%"), (3, "1 a VS 2 b versus 3.5 compared to 4, r = .5 R-value of: 0.25r=1"), (4, None), (5, ""), (6, "é 9% ü r:0.5 r 0.75")]
    df = spark.createDataFrame(data, "id int, t string")
    got = [(r["text_id"], r["kind"], r["value"], r["value_b"], r["context"]) for r in rows(findings.extract_metrics(df, "id", "t"), "text_id", "kind", "ordinal")]
    assert [(g[0], g[2]) for g in got if g[1] == "percentage"] == [(1, 5.0), (1, 6.5), (1, 7.0), (1, 8.0), (6, 9.0)]
    assert [g[2:] for g in got if g[1] == "comparison"] == [(1.0, 2.0, "a"), (3.5, 4.0, "Group A")]
    assert [(g[0], g[2]) for g in got if g[1] == "correlation"] == [(3, 0.25), (3, 1.0), (6, 0.75)]
    plan = findings.extract_metrics(df, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3


def test_figures_in_texts(spark):
    data = [
        (1, "Revenue of the north grew 12.5% and 0% stayed, 300 % is out"),
        (2, "average of 6.20 malnutrition cases compared to 14.55 elsewhere; 3 apples vs. 4"),
        (3, "strong link (r=0.71) and r-value of 0.3, but r=7 is none"),
        (4, "nothing here"),
        (5, "they correlate"),
        (6, "7%"),
        (7, None),
    ]
    df = spark.createDataFrame(data, "id int, t string")
    got = rows(findings.extract_metrics(df, "id", "t"), "text_id", "ordinal")
    assert [(r["kind"], r["value"], r["value_b"], r["context"]) for r in got if r["text_id"] == 1] == [("percentage", 12.5, None, "of the north grew")]
    assert [(r["value"], r["value_b"], r["context"]) for r in got if r["text_id"] == 2] == [(6.2, 14.55, "malnutrition cases"), (3.0, 4.0, "apples")]
    three = [r for r in got if r["text_id"] == 3]
    assert [(r["kind"], r["value"]) for r in three] == [("correlation", 0.71), ("correlation", 0.3)]
    assert three[0]["context"] == "strong link (r=0.71) and r-value of 0.3,"[:40].strip()
    assert [r["context"] for r in got if r["text_id"] == 6] == ["7.0%"]
    kinds = {r["text_id"]: r["chart_type"] for r in findings.classify_findings(df, "id", "t").collect()}
    assert kinds == {1: "percentage", 2: "comparison", 3: "correlation", 4: "text", 5: "correlation", 6: "percentage", 7: "text"}


def test_findings_tell_or_stay_neutral(spark):
    skewed = spark.createDataFrame([(float(2**i),) for i in range(12)], "x double")
    told = only(findings.findings_of("distribution", exploratory.distribution(skewed, ["x"])))
    assert told["subject"] == "x" and told["rank"] == 1
    even = spark.range(12).selectExpr("cast(id as double) x")
    assert only(findings.findings_of("distribution", exploratory.distribution(even, ["x"])))["finding"] == "nothing stands out"


def test_every_rule_names_a_known_operator():
    from tablescout import analysis

    source = open(analysis.__file__).read()
    assert [name for name in findings.RULES if f'"{name}"' not in source] == []


def test_representative_rows_fall_back_to_the_first(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("double"))
    assert [r["id"] for r in representative_rows(df, "id").collect()] == ["0", "1", "2"]
    df = df.withColumn("x", F.col("id") * -1.0)
    got = {r["id"] for r in representative_rows(df, "id", ["x"]).collect()}
    assert got == {"0", "5", "9"}


def test_crosstab_has_combinations_that_do_not_occur(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("b", None)], "p string, q string")
    got = {(r["val_a"], r["val_b"]): r["cnt"] for r in exploratory.crosstab(df, [("p", "q")]).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 0}
    summary = only(exploratory.crosstab_summary(df, [("p", "q")]))
    assert summary["max_deviation"] == pytest.approx(0.25)
