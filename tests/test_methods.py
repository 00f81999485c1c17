"""Named techniques on small tables, against plain loops."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescout.operators import attribution as A
from tablescout.operators import basket, churn, control, demand, engagement, experiment, survival, terms
from tablescout.operators import multivariate as M
from tablescout.plans import gram as G


def test_itemsets_and_rules_are_brute_force(spark):
    draw = random.Random(2)
    baskets = {b: {"hot"} | {f"i{draw.randrange(9)}" for _ in range(draw.randrange(7))} for b in range(80)}
    rows = [(b, i) for b, s in baskets.items() for i in s] + [(1, "hot"), (None, "i1"), (3, None), (900, None)]
    df = spark.createDataFrame(rows, "b int, i string").repartition(3)
    want = {}
    for size in range(1, 5):
        for combo in itertools.combinations(sorted({"hot"} | {f"i{k}" for k in range(9)}), size):
            n = sum(set(combo) <= s for s in baskets.values())
            if n >= 5:
                want[combo] = n
    sets = basket.itemsets(df, "b", "i", min_count=5, max_size=4)
    assert {tuple(r["items"]): r.support_count for r in sets.collect()} == want
    for r in basket.association_rules(sets).collect():
        both = want[tuple(sorted([*r.antecedent, r.consequent]))]
        confidence = both / want[tuple(r.antecedent)]
        assert (r.support_count, r.confidence) == (both, pytest.approx(confidence))
        assert r.lift == pytest.approx(confidence * 80 / want[(r.consequent,)])
    assert basket.itemsets(df.limit(0), "b", "i").count() == 0


def test_item_in_most_baskets_is_no_group(spark, monkeypatch):
    """Behind the most frequent item nothing is left, so its sets are made from the rarer items' side."""
    seen = []
    whole = basket.materialize
    monkeypatch.setattr(basket, "materialize", lambda df: seen.append(whole(df)) or seen[-1])
    rows = [(b, i) for b in range(200) for i in ("hot", f"i{b % 10}")]
    basket.itemsets(spark.createDataFrame(rows, "b int, i string"), "b", "i", min_count=2, max_size=2).collect()
    (projected,) = [df for df in seen if "rest" in df.columns]
    assert {r["items"][0] for r in projected.collect()} == {f"i{k}" for k in range(10)} and projected.count() == 10


def test_baskets_meet_before_items_are_counted(spark, monkeypatch):
    """Equal baskets are one row before anything of their items is written, whatever their number, and repeats count once."""
    seen = []
    whole = basket.materialize
    monkeypatch.setattr(basket, "materialize", lambda df: seen.append(whole(df)) or seen[-1])
    rows = [(b, i) for b in range(300) for i in ("x", "y", "x", f"rare{b}")] + [(500, "alone")]
    sets = basket.itemsets(spark.createDataFrame(rows, "b int, i string").repartition(5), "b", "i", min_count=2)
    got = {tuple(r["items"]): (r.support_count, r.n_baskets) for r in sets.collect()}
    assert got == {("x",): (300, 301), ("y",): (300, 301), ("x", "y"): (300, 301)}
    assert max(df.count() for df in seen) == 2


def _cloud(spark, rows=400, seed=0):
    random = np.random.default_rng(seed)
    values = random.normal(0, 1, (rows, 4)) @ random.normal(0, 1, (4, 4)) + 1e7
    df = spark.createDataFrame([(*map(float, v), [float(v[0]), 1.0]) for v in values], "a double, b double, c double, d double, v array<double>")
    return values, df


def test_gram_keeps_digits_and_skips_missing_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "SLICE_ROWS", 7)
    values, df = _cloud(spark)
    gaps = df.union(spark.createDataFrame([(1.0, None, 2.0, 3.0, None), (float("nan"), 1.0, 1.0, 1.0, None)], df.schema)).repartition(5)
    found = G.gram(gaps, list("abcd"))
    assert found.n == 400 and np.allclose(found.mean, values.mean(axis=0), rtol=1e-14)
    assert np.allclose(found.covariance, np.cov(values.T), rtol=1e-9)
    one = G.gram(df, ["v"])
    assert one.cols == ["v[0]", "v[1]"] and np.isnan(one.correlation[1]).all() and one.correlation[0, 0] == 1
    assert G.gram(df.limit(0), ["a", "b"]).n == 0


def test_components_are_those_of_numpy(spark):
    values, df = _cloud(spark)
    found = M.principal_components(df, list("abcd"), standardize=False)
    want = np.sort(np.linalg.eigvalsh(np.cov(values.T)))[::-1]
    assert np.allclose(found.variance, want, rtol=1e-7)
    placed = found.project(df, list("abcd"), 2)
    spread = placed.agg(F.var_samp("pc1"), F.var_samp("pc2"), F.corr("pc1", "pc2")).first()
    assert np.allclose(spread[:2], want[:2], rtol=1e-7) and abs(spread[2]) < 1e-6
    shares = [r.share for r in M.principal_components(df, list("abcd")).summary(df).collect()]
    assert sum(shares) == pytest.approx(1) and shares == sorted(shares, reverse=True)


def test_hundred_columns_take_one_scan(spark):
    df = spark.range(50).select(*(F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(100)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gram", "gram")
    assert G.gram(df, df.columns).product.shape == (100, 100)
    assert len(tracker.getJobIdsForGroup("gram")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("sign", (1, -1))
def test_rows_stand_on_the_axis_along_which_columns_rise(spark, sign):
    random = np.random.default_rng(4)
    x = random.normal(size=300)
    y = sign * 0.1 * x + random.normal(size=300)
    assert np.corrcoef(x, y)[0, 1] * sign > 0
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y)], "x double, y double")
    found = M.principal_components(df, ["x", "y"])
    assert found.alike() == (0 if sign > 0 else 1)
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    got = found.project(df, ["x", "y"], 1, first=found.alike()).collect()
    want = {r: (a + b) / np.sqrt(2) for r, a, b in zip(zip(x, y), z(x), z(y))}
    assert all(r.pc1 == pytest.approx(want[r.x, r.y], abs=1e-9) for r in got)


def test_clusters_are_the_same_for_any_partitioning(spark):
    random = np.random.default_rng(3)
    points = np.concatenate([random.normal(c, 0.4, (150, 3)) for c in ((0, 0, 0), (5, 5, 0), (0, 5, 5), (9, 0, 9))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points] + [(None, 1.0, 1.0)] + [(0.0, 0.0, 0.0)] * 300, "x double, y double, z double")
    one, two = (M.kmeans(df.repartition(n), ["x", "y", "z"], 4) for n in (2, 9))
    assert np.array_equal(one.centres, two.centres) and one.sizes == two.sizes and one.inertia == two.inertia
    assert all(b <= a * (1 + 1e-12) for a, b in zip(one.inertia, one.inertia[1:]))
    assert sorted(one.sizes) == [150, 150, 150, 450]
    marked = one.assign(df, ["x", "y", "z"])
    assert {r.cluster: r["count"] for r in marked.groupBy("cluster").count().collect()} == {None: 1, **dict(enumerate(one.sizes))}
    few = M.kmeans(spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "x double"), ["x"], 4)
    assert sorted(few.sizes) == [1, 5] and few.inertia[-1] == 0
    assert M.kmeans(df.limit(0), ["x", "y", "z"], 3).sizes == []


def test_clusters_go_on_until_the_centres_stand(spark):
    df = spark.range(800).select(F.col("id").cast("double").alias("x")).coalesce(1)
    found = M.kmeans(df, ["x"], 8, start=[[float(i)] for i in range(8)])
    assert len(found.inertia) > 51 and sum(found.sizes) == 800
    again = M.kmeans(df, ["x"], 8, start=found.centres, rounds=1)
    assert np.array_equal(again.centres, found.centres)
    assert len(M.kmeans(df, ["x"], 8, start=[[float(i)] for i in range(8)], rounds=3).inertia) == 4


@pytest.mark.parametrize("numbers", (600, 1 << 22))
def test_clusters_pass_over_all_rows_only_now_and_then(spark, monkeypatch, numbers):
    """Rounds between the passes come from rows at borders, of which few or all are at hand, and are those of plain k-means."""
    from pyspark.sql import DataFrame

    random = np.random.default_rng(8)
    points = np.concatenate([random.normal(size=(3000, 3)), np.zeros((40, 3)), np.full((300, 3), 0.1)])
    centres, inertia = points[:6].copy(), []
    while True:
        apart = np.square(points[:, None] - centres).sum(axis=2)
        near = apart.argmin(axis=1)
        inertia.append(apart.min(axis=1).sum())
        moved = np.array([points[near == i].mean(axis=0) for i in range(6)])
        if np.abs(moved - centres).max() < 1e-12:
            break
        centres = moved
    calls, whole = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *args, **more: calls.append(1) or whole(self, *args, **more))
    monkeypatch.setattr(M, "LOOSE_NUMBERS", numbers, raising=False)
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
    found = M.kmeans(df.repartition(5), ["x", "y", "z"], 6, start=points[:6])
    assert found.sizes == np.bincount(near).tolist() and found.centres == pytest.approx(centres, abs=1e-9)
    assert found.inertia[: len(inertia)] == pytest.approx(inertia, rel=1e-9) and len(inertia) > 15
    assert all(b <= a for a, b in zip(found.inertia, found.inertia[1:]))
    assert len(calls) < 0.75 * len(found.inertia)
    # Far from zero, rounding is larger than the gaps of many rows.
    off = M.kmeans(df.select(*((F.col(c) + 2.0**20).alias(c) for c in "xyz")), ["x", "y", "z"], 6, start=points[:6] + 2.0**20)
    assert off.sizes == found.sizes


def test_panel_is_dense_and_censored(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0), ("a", "2024-01-04", None), ("b", "2024-01-03", 5.0), (None, "2024-01-09", 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "e string, t string, v double").withColumn("t", F.to_timestamp("t"))
    panel = churn.activity_panel(df, "e", "t", "day", "v", silent=2)
    got = [tuple(r) for r in panel.orderBy("entity", "period").collect()]
    assert got == [
        ("a", 0, 2, 3.0, 0, 0, 2, False, True), ("a", 1, 0, 0.0, 1, 1, 2, False, False), ("a", 2, 0, 0.0, 2, 2, 2, True, None), ("a", 3, 1, 0.0, 3, 0, 3, True, None),
        ("b", 2, 1, 5.0, 0, 0, 1, True, None), ("b", 3, 0, 0.0, 1, 1, 1, True, None),
    ]
    assert [tuple(r) for r in churn.churn_by_period(panel).orderBy("period").collect()][0] == (0, 1, 1, 1, 0, 1.0)
    assert churn.activity_panel(df.limit(0), "e", "t").count() == 0


def test_logistic_regression_is_that_of_numpy(spark):
    random = np.random.default_rng(5)
    x = random.normal(0, 1, (600, 2)) * [1, 100] + [0, 5000]
    y = random.uniform(size=600) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - (x[:, 1] - 5000) / 80)))
    df = spark.createDataFrame([(*map(float, r), 7.0, bool(k)) for r, k in zip(x, y)] + [(None, 1.0, 1.0, True), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y boolean")
    found = churn.logistic_regression(df.repartition(5), ["a", "b", "c"], "y")
    full, beta = np.column_stack([np.ones(600), x]), np.zeros(3)
    centre = np.array([0, 0, 5000.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-((full - centre) @ beta)))
        beta += np.linalg.solve(((full - centre) * (p * (1 - p))[:, None]).T @ (full - centre), (full - centre).T @ (y - p))
    assert np.allclose(found.coefficients, [beta[1], beta[2], 0], rtol=1e-6)
    assert found.intercept == pytest.approx(beta[0] - 5000 * beta[2], rel=1e-6) and found.n == 600
    spread = np.linalg.inv((full * (p * (1 - p))[:, None]).T @ full)
    assert np.allclose(found.errors[:3], np.sqrt(np.diag(spread)), rtol=1e-4)
    parted = spark.createDataFrame([(float(i), i > 5) for i in range(12)], "a double, y boolean")
    assert np.isfinite(churn.logistic_regression(parted, ["a"], "y", ridge=0.1).coefficients).all()


def test_rank_sum_counts_pairs(spark):
    draw = random.Random(4)
    a, b = [draw.randrange(6) for _ in range(40)], [draw.randrange(1, 7) for _ in range(25)]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("c", 9), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(4)
    (r,) = experiment.rank_sum(df, "g", "v", "a", "b").collect()
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    ties = sum(t**3 - t for t in (sum(v == k for v in a + b) for k in range(8)))
    sigma = (40 * 25 / 12 * (66 - ties / (65 * 64))) ** 0.5
    assert (r.n_a, r.n_b, r.u) == (40, 25, u) and r.z == pytest.approx((u - 500) / sigma)
    assert experiment.rank_sum(df, "g", "v", "a", "nobody").count() == 0


def test_resampled_interval_does_not_depend_on_partitions(spark):
    random = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], float(random.normal(3 if i % 2 else 5, 2))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    one, two = (experiment.resampled_difference(df.repartition(n), "g", "v", "a", "b", ["id"]).collect()[0] for n in (1, 7))
    assert tuple(one) == pytest.approx(tuple(two), rel=1e-9)
    error = (sum(np.var([r[2] for r in rows if r[1] == s], ddof=1) / 1000 for s in "ab")) ** 0.5
    assert one.low == pytest.approx(one.difference - 1.96 * error, abs=error / 3) and one.high == pytest.approx(one.difference + 1.96 * error, abs=error / 3)


def test_product_limit_over_blocks(spark, small_blocks):
    draw = random.Random(6)
    rows = [(draw.choice("ab"), float(draw.randrange(40)), draw.random() < 0.6) for _ in range(300)] + [("a", 99.0, True), ("b", 7.0, None), (None, 1.0, True)]
    df = spark.createDataFrame(rows, "g string, d double, seen boolean").repartition(4)
    got = {(r.g, r.duration): r for r in survival.product_limit(df, "d", "seen", ["g"]).collect()}
    for g in "ab":
        own = [(d, e) for k, d, e in rows if k == g and e is not None]
        s = v = None
        for t in sorted({d for d, _ in own}):
            risk, events = sum(d >= t for d, _ in own), sum(d == t and e for d, e in own)
            s = (1.0 if s is None else s) * (1 - events / risk)
            v = (0.0 if v is None else v) + (events / (risk * (risk - events)) if events < risk else 0)
            r = got[g, t]
            assert (r.at_risk, r.events) == (risk, events) and r.survival == pytest.approx(s, abs=1e-12) and r.std_error == pytest.approx(s * v**0.5, abs=1e-12)
    assert got["a", 99.0].survival == 0
    assert survival.product_limit(df.limit(0), "d", "seen").count() == 0


def test_log_rank_of_three_groups(spark):
    """The statistic is that of the pairwise sums, and equal groups give next to nothing."""
    rows = [(g, float(d), d % 4 > 0) for g in "abc" for d in range(1, 40)]
    (r,) = survival.log_rank(spark.createDataFrame(rows, "g string, d double, seen boolean"), "d", "seen", "g").collect()
    assert r.groups == 3 and r.dof == 2 and r.chi2 == pytest.approx(0, abs=1e-9) and r.p_value == pytest.approx(1)
    late = [(g, d * (3 if g == "c" else 1), e) for g, d, e in rows]
    (r,) = survival.log_rank(spark.createDataFrame(late, "g string, d double, seen boolean"), "d", "seen", "g").collect()
    assert r.p_value < 1e-3 and r.observed_events[2] < r.expected_events[2]
    assert sum(r.observed_events) == pytest.approx(sum(r.expected_events))
    assert survival.log_rank(spark.createDataFrame(rows[:5], "g string, d double, seen boolean"), "d", "seen", "g").count() == 0


def test_time_to_next_of_a_hot_entity(spark, small_blocks):
    rows = [("hot", i // 2) for i in range(40)] + [("x", 5), ("x", 100), (None, 3), ("y", None)]
    df = spark.createDataFrame(rows, "e string, s int").select("e", F.timestamp_seconds("s").alias("t"), F.monotonically_increasing_id().alias("k"))
    got = survival.time_to_next(df, "e", "t", ["k"]).collect()
    hot = sorted(r.duration for r in got if r.entity == "hot" and r.observed)
    assert hot == [0.0] * 20 + [1.0] * 19 and len(got) == 42
    assert {(r.entity, r.duration) for r in got if not r.observed} == {("hot", 81.0), ("x", 0.0)}


def test_rolling_distinct_is_a_count_of_each_window(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(12), f"2024-01-{draw.randrange(1, 29):02d}") for _ in range(60)] + [(99, f"2024-01-{d:02d}") for d in range(1, 29)] * 3 + [(None, "2024-01-05"), (5, None)]
    df = spark.createDataFrame(rows, "e int, t string").withColumn("t", F.to_timestamp("t"))
    days = {e: {int(t[-2:]) for k, t in rows if k == e and t} for e, _ in rows if e is not None}
    for r in engagement.rolling_distinct(df, "e", "t", (1, 3, 10)).collect():
        for w in (1, 3, 10):
            assert r[f"active_{w}"] == sum(any(r.day.day - w < d <= r.day.day for d in own) for own in days.values())
    assert engagement.rolling_distinct(df.limit(0), "e", "t").count() == 0


def test_runs_go_on_over_block_edges(spark, small_blocks):
    draw = random.Random(7)
    series = [draw.choice([1, 2, 3, 5, 6, 7]) for _ in range(60)] + [9] * 30 + [1, 2, 3, 4, 5, 6, 7, 8] + [1, 8] * 12 + [60] + [4] * 5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(series)] + [(500, None)], "i int, v double").repartition(3)
    centre = float(np.mean(series))
    sigma = float(np.mean(np.abs(np.diff(series)))) / 1.128

    def runs(states, least, more):
        out, at = set(), 0
        for state, some in itertools.groupby(states):
            n = len(list(some))
            if state and n >= least:
                out.add((at - more, at + n - 1, n + more))
            at += n
        return out

    step = [0, *np.sign(np.diff(series)).tolist()]
    want = {
        "beyond": runs([(v > centre + 3 * sigma) - (v < centre - 3 * sigma) for v in series], 1, 0),
        "shift": runs([(v > centre) - (v < centre) for v in series], 8, 0),
        "trend": runs(step, 5, 1),
        "zigzag": runs([s * (1 if i % 2 == 0 else -1) for i, s in enumerate(step)], 13, 1),
    }
    got = {}
    for r in control.run_rules(df, "v", ["i"]).collect():
        got.setdefault(r.rule, set()).add((r.start, r.stop, r.length))
    assert got == want and all(want.values())
    keyed = control.run_rules(df.withColumn("k", F.explode(F.array(F.lit("a"), F.lit("b")))), "v", ["i"], ["k"])
    assert keyed.count() == 2 * sum(map(len, want.values()))


def test_no_step_gathers_the_rows(spark):
    """Only sums by day, group or block pass through one task."""
    df = spark.range(1000).selectExpr("id % 7 AS e", "timestamp_seconds(id * 5000) AS t", "double(id) AS v")
    for frame in (engagement.rolling_distinct(df, "e", "t"), churn.activity_panel(df, "e", "t"), experiment.rank_sum(df, "e", "v", 1, 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        for above in plan.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in above.split("\n")[1] or "Project" in above.split("\n")[1] or "Generate" in above.split("\n")[1], plan


def test_removal_effect_of_a_small_chain():
    """Half of the paths go through a, a third of those convert through b; the rest is direct to b."""
    counts = [(A.START, "a", 60), (A.START, "b", 40), ("a", "b", 20), ("a", A.LOST, 40), ("b", A.CONVERSION, 30), ("b", A.LOST, 30)]
    # Conversions: b holds 60 paths, half convert: 0.3 of all. Without a, 40 reach b: 0.2. Without b none.
    assert A._removal(counts) == pytest.approx({"a": (1 / 3) / (4 / 3), "b": 1 / (4 / 3)})
    loop = [(A.START, "a", 10), ("a", "a", 90), ("a", A.CONVERSION, 5), ("a", A.LOST, 5)]
    assert A._removal(loop) == pytest.approx({"a": 1.0})
    assert A._removal([(A.START, "a", 1), ("a", A.LOST, 1)]) == {"a": 0.0}


def test_paths_of_a_hot_entity(spark, small_blocks):
    """One entity with most rows over many blocks, conversions at their edges, conversions without touches."""
    draw = random.Random(2)
    rows = [("hot", i, draw.choice(["a", "b", "buy"])) for i in range(60)] + [("x", 1, "a"), ("y", 2, "buy"), (None, 3, "a"), ("z", 4, None)]
    df = spark.createDataFrame(rows, "e string, t int, c string").repartition(4)
    steps = A.touches(df, "e", "t", "c", F.col("c") == "buy")
    want, open_ = [], {}
    for e, _, c in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[0], r[1])):
        path = open_.setdefault(e, [])
        if c == "buy":
            want.append((e, tuple(path), True))
            open_[e] = []
        else:
            path.append(c)
    want += [(e, tuple(p), False) for e, p in open_.items() if p]
    got = [(r.entity, r.touches, r.first_touch, r.last_touch, r.converted) for r in A.paths(steps).collect()]
    assert sorted(got, key=str) == sorted(((e, len(p), p[0] if p else None, p[-1] if p else None, k) for e, p, k in want), key=str)
    out = A.attribution(steps).collect()
    won = [p for _, p, k in want if k and p]
    assert {r.channel: r.linear for r in out} == pytest.approx({c: sum(p.count(c) / len(p) for p in won) for c in "ab"})
    assert sum(r.markov for r in out) == pytest.approx(sum(k for *_, k in want))


def test_terms_that_are_few_go_to_all_tasks(spark, monkeypatch):
    """Nothing is shuffled by term if the terms are few, and weights are the same if they are not."""
    df = spark.createDataFrame([(i, f"all w{i % 3} W{i % 3} v{i % 5} own{i}") for i in range(30)] + [(None, "v1"), (40, "--"), (41, None), (42, "")], "id int, t string")
    few = terms.term_weights(df, "id", "t")
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(terms, "VOCABULARY", 3)
    many = terms.term_weights(df, "id", "t")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 60


def test_term_weights_are_those_of_plain_counts(spark):
    texts = {1: "Alpha beta beta the", 2: "alpha gamma the THE", 3: "beta, gamma! the", 4: "", 5: None, 6: "only the"}
    df = spark.createDataFrame([*texts.items(), (None, "alpha")], "id long, text string")
    got = {(r.key, r.term): r.weight for r in terms.term_weights(df, "id", "text", max_share=0.75).collect()}
    says = {t: np.log(4 / 2) for t in ("alpha", "beta", "gamma")}
    one = np.array([says["alpha"], 2 * says["beta"]])
    assert got[1, "alpha"] == pytest.approx(one[0] / np.linalg.norm(one)) and got[1, "beta"] == pytest.approx(one[1] / np.linalg.norm(one))
    assert {t for _, t in got} == {"alpha", "beta", "gamma"}
    weights = terms.term_weights(df, "id", "text", max_share=0.75)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 6), (1, 1)], "a long, b long")
    near = {(r.a, r.b): r.similarity for r in terms.text_similarity(weights, pairs).collect()}
    assert near[1, 1] == pytest.approx(1) and near[1, 6] == 0 and near[1, 3] > near[1, 2] > 0
    assert [r.term for r in terms.top_terms(weights, 1).where("key = 1").collect()] == ["beta"]
    assert terms.term_weights(df.limit(0), "id", "text").count() == 0


def test_levels_over_blocks_are_those_of_a_walk(spark, small_blocks):
    draw = random.Random(8)
    series = [draw.uniform(1, 9) for _ in range(60)]
    df = spark.createDataFrame([(k, i, v) for k in "ab" for i, v in enumerate(series)] + [("a", 99, None)], "k string, i int, v double").repartition(4)
    got = {r.pos: r for r in demand.exponential_level(df, "v", ["i"], ["k"], 0.4).where("k = 'b'").collect()}
    level = None
    for i, v in enumerate(series):
        assert got[i].forecast == (None if level is None else pytest.approx(level))
        level = v if level is None else level + 0.4 * (v - level)
        assert got[i].level == pytest.approx(level)
    assert demand.exponential_level(df.limit(0), "v", ["i"]).count() == 0


def test_intermittent_demand_needs_no_walk(spark, small_blocks, monkeypatch):
    """Levels of many blocks come with the other sums; without keys, with ties and with one demand."""
    monkeypatch.setattr(demand, "_smoothed", None)
    values = [0.0, 3.0, 0.0, 0.0, 5.0, 5.0] * 9
    df = spark.createDataFrame([(k, i, v) for k, vs in (("a", values), ("b", [0.0, 2.0]), ("c", [0.0])) for i, v in enumerate(vs)], "k string, i int, v double")
    size, gap, last = None, None, -1
    for i, v in enumerate(values):
        if v > 0:
            size = v if size is None else size + 0.1 * (v - size)
            gap = float(i - last) if gap is None else gap + 0.1 * (i - last - gap)
            last = i
    got = {r.k: r for r in demand.intermittent_demand(df, "v", ["i"], ["k"]).collect()}
    assert set(got) == {"a", "b"} and (got["b"].size_level, got["b"].interval_level) == (2.0, 2.0)
    for r in (got["a"], *demand.intermittent_demand(df.where("k = 'a'"), "v", ["i"]).collect()):
        assert (r.size_level, r.interval_level, r.rate) == (pytest.approx(size), pytest.approx(gap), pytest.approx(size / gap))


def test_intermittent_demand_and_seasons(spark, small_blocks):
    series = [0, 0, 4, 0, 6, 0, 0, 0, 5, 1] + [0] * 5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(series)], "i int, v double")
    (r,) = demand.intermittent_demand(df, "v", ["i"], alpha=0.5).collect()
    size = interval = None
    last = -1
    for i, v in enumerate(series):
        if v:
            size, interval = (v, i - last) if size is None else ((size + v) / 2, (interval + i - last) / 2)
            last = i
    assert (r.periods, r.demands, r.size_level, r.interval_level) == (15, 4, size, interval) and r.rate == pytest.approx(size / interval)
    wave = spark.createDataFrame([(i, float([10, 20, 60][i % 3])) for i in range(30)], "i int, v double")
    ahead = demand.seasonal_forecast(wave, "v", ["i"], 3, 4).orderBy("step").collect()
    assert [x.forecast for x in ahead] == pytest.approx([10, 20, 60, 10])


def test_run_rules_share_one_pass(spark, monkeypatch):
    calls = []
    for name in ("with_neighbours", "running_totals"):
        whole = getattr(control, name)
        monkeypatch.setattr(control, name, lambda *a, whole=whole, name=name: calls.append(name) or whole(*a))
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(60)], "t int, v double")
    found = control.run_rules(df, "v", ["t"]).collect()
    assert {(r.rule, r.start, r.stop, r.length) for r in found} == {("trend", 9 * i, min(9 * i + 8, 59), min(9, 60 - 9 * i)) for i in range(7)}
    # One for the moving ranges, one for the four rules together.
    assert sorted(calls) == ["running_totals", "with_neighbours", "with_neighbours"]
