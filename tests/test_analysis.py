import numpy as np
import pandas as pd
import pytest

from tablescout.analysis import MODULES, analyze, explore, explore_many
from tablescout.sources.tables import read_table


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    g = np.random.default_rng(12)
    n = 240
    pdf = pd.DataFrame(
        {
            "sale_id": [f"s{i:04d}" for i in range(n)],
            "day": [str(pd.Timestamp("2023-01-01") + pd.Timedelta(days=int(i * 1.5)))[:10] for i in range(n)],
            "region": g.choice(["north", "south", "west"], n),
            "channel": g.choice(["shop", "web"], n),
            "units": g.integers(1, 30, n),
            "discount": g.choice([0.0, 0.1, 0.2], n),
            "visits": g.integers(10, 90, n),
        }
    )
    pdf["spend"] = (pdf["units"] * 3 + g.integers(0, 9, n)).astype(float)
    path = tmp_path_factory.mktemp("csv") / "sales.csv"
    pdf.to_csv(path, index=False)
    return read_table(spark, str(path)).cache()


def test_all_modules_run_from_a_csv(sales):
    out = analyze(sales, MODULES, tie_breakers=["sale_id"])
    assert out.blocked == []
    for name, frame in out.results.items():
        frame.collect()
    expected = {"distribution", "chi_square", "trend", "cycles", "winners_losers", "ltv", "funnel", "near_duplicate_values", "anomaly_score"}
    assert expected - {"near_duplicate_values"} <= set(out.results)
    told = out.findings.collect()
    assert {r["operator"] for r in told} >= {"correlation", "forecast_baseline", "cohorts"}
    assert any("units" in r["finding"] and "spend" in r["finding"] for r in told if r["operator"] == "correlation")


def test_mostly_empty_columns_stop_the_run(spark):
    df = spark.createDataFrame([(i, None if i else 1.0) for i in range(20)], "id int, x double")
    out = analyze(df, MODULES)
    assert out.blocked == [("x", pytest.approx(0.95))] and "distribution" not in out.results


def test_unknown_modules_are_refused(sales):
    with pytest.raises(ValueError):
        analyze(sales, ["astrology"])


def test_exploration_suggests_candidates(sales):
    out = explore(sales, tie_breakers=["sale_id"])
    labels = {r["label"]: r for r in out.candidates.collect()}
    assert labels["Cohort & retention analysis"]["confidence"] == 0.82
    assert "Segment by 'region'" in labels and "Trend & seasonality analysis" in labels
    assert any(k.startswith("Correlation deep-dive") for k in labels)
    assert out.summary.count() == len(sales.columns)


def test_candidates_of_several_tables(sales):
    both = explore_many({"all": sales, "north": sales.where("region = 'north'").drop("day")}, ["sale_id"])
    labels = {(r["dataset_id"], r["label"]) for r in both.collect()}
    assert ("all", "Trend & seasonality analysis") in labels and ("north", "Trend & seasonality analysis") not in labels
    assert {d for d, _ in labels} == {"all", "north"} and len(labels) == both.count()
