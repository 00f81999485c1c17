"""Ranking and business queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import business as bu
from tablescout.operators import ranking as op
from tablescout.operators.timeseries import growth_rate
from tablescout.plans.sequence import calendar_series
from verification.registry import GAPPY, MEASURES, long_sql, query

G = ["quantity", "l_extendedprice", "discount", "tax"]
GLONG = long_sql(GAPPY, G)


@query(
    "percentile_ranking",
    f"""WITH l AS (SELECT * FROM {GLONG}), q AS (SELECT "column", quantile_cont(v, 0.9) AS hi, quantile_cont(v, 0.1) AS lo FROM l GROUP BY 1)
      SELECT l."column", round(max(hi), 4) AS p90_threshold, round(max(lo), 4) AS p10_threshold, count(*) FILTER (v >= hi) AS top_10pct_count,
      count(*) FILTER (v <= lo) AS bottom_10pct_count FROM l JOIN q ON l."column" = q."column" GROUP BY 1""",
)
def _(t):
    return op.percentile_ranking(t.gappy, G)


@query(
    "with_percentile_rank",
    """SELECT p_partkey, round((rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / count(*) OVER (), 6) AS pct_rank FROM part""",
    digits=6,
)
def _(t):
    return op.with_percentile_rank(t.part, "p_retailprice").select("p_partkey", "pct_rank")


def _score_sql(table, cols):
    z = " + ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in cols)
    return f"(SELECT ({z}) / {len(cols)} AS score FROM {table} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)})"


@query(
    "composite_score",
    f"""WITH s AS (SELECT * FROM {_score_sql(GAPPY, G)}), q AS (SELECT quantile_cont(score, 0.9) AS hi, quantile_cont(score, 0.1) AS lo FROM s)
      SELECT count(*) AS n, round(max(hi), 4) AS p90_threshold, round(max(lo), 4) AS p10_threshold, count(*) FILTER (score >= hi) AS top_10pct_count,
      round(min(score), 4) AS min_score, round(max(score), 4) AS max_score FROM s, q""",
)
def _(t):
    return op.composite_score(t.gappy, G)


@query(
    "composite_scores",
    """SELECT o_orderkey, round(((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()
      + (o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER ()) / 2, 4) AS score FROM orders""",
)
def _(t):
    return op.composite_scores(t.orders, ["o_totalprice", "o_custkey"]).select("o_orderkey", "score")


_TB = " UNION ALL ".join(
    f"""SELECT '{a}' AS by_col, '{b}' AS other_col, avg({b}) FILTER ({a} >= (SELECT quantile_cont({a}, 0.9) FROM {GAPPY})) AS t,
      avg({b}) FILTER ({a} <= (SELECT quantile_cont({a}, 0.1) FROM {GAPPY})) AS b FROM {GAPPY}"""
    for a in G[:3]
    for b in G
    if a != b
)


@query("top_bottom", f"SELECT by_col, other_col, round(t, 4) AS top_mean, round(b, 4) AS bottom_mean, round(t / b, 4) AS ratio FROM ({_TB})")
def _(t):
    return op.top_bottom(t.gappy, G[:3], G)


@query(
    "tiers",
    f"""WITH l AS (SELECT * FROM {GLONG} WHERE v IS NOT NULL), q AS (SELECT "column", quantile_cont(v, 0.33) AS lo, quantile_cont(v, 0.67) AS hi FROM l GROUP BY 1)
      SELECT l."column", round(max(lo), 4) AS low_threshold, round(max(hi), 4) AS high_threshold, count(*) FILTER (v < lo) AS low_count, count(*) FILTER (v >= lo AND v < hi) AS mid_count,
      count(*) FILTER (v >= hi) AS high_count, round(count(*) FILTER (v < lo) / count(*), 4) AS low_pct, round(count(*) FILTER (v >= lo AND v < hi) / count(*), 4) AS mid_pct,
      round(count(*) FILTER (v >= hi) / count(*), 4) AS high_pct FROM l JOIN q ON l."column" = q."column" GROUP BY 1""",
)
def _(t):
    return op.tiers(t.gappy, G)


@query(
    "with_tier",
    """SELECT c_custkey, CASE WHEN c_acctbal < (SELECT quantile_cont(c_acctbal, 0.33) FROM customer) THEN 'low'
      WHEN c_acctbal < (SELECT quantile_cont(c_acctbal, 0.67) FROM customer) THEN 'mid' ELSE 'high' END AS tier FROM customer""",
)
def _(t):
    return op.with_tier(t.customer, "c_acctbal").select("c_custkey", "tier")


_DAILY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "winners_losers",
    f"""WITH d AS (SELECT date_trunc('day', l_shipdate) AS ts, {", ".join(f"avg({m}) AS {m}" for m in _DAILY)} FROM lineitem GROUP BY 1),
      g AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, (arg_max({m}, ts) - arg_min({m}, ts)) / nullif(abs(arg_min({m}, ts)), 0) * 100 AS p FROM d" for m in _DAILY)}),
      r AS (SELECT metric, coalesce(p, 0) AS p, row_number() OVER (ORDER BY coalesce(p, 0) DESC, metric) AS r, row_number() OVER (ORDER BY coalesce(p, 0), metric DESC) AS w FROM g)
      SELECT metric, round(p, 4) AS total_pct_change, CAST(r AS INT) AS rank, CASE WHEN r <= 2 AND p > 0 THEN 'winner' WHEN w <= 2 AND p < 0 THEN 'loser' ELSE 'neutral' END AS verdict FROM r""",
)
def _(t):
    return op.winners_losers(growth_rate(calendar_series(t.lineitem, "l_shipdate", _DAILY)))


@query(
    "entity_winners_losers",
    """WITH d AS (SELECT user_id, date_trunc('day', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2),
      g AS (SELECT user_id, (arg_max(v, ts) - arg_min(v, ts)) / nullif(abs(arg_min(v, ts)), 0) * 100 AS p FROM d GROUP BY 1 HAVING count(*) >= 2)
      SELECT user_id, 'value' AS metric, round(p, 4) AS total_pct_change, CASE WHEN p > 0 THEN 'winner' ELSE 'loser' END AS verdict FROM (
      (SELECT * FROM g WHERE p > 0 ORDER BY p DESC, user_id LIMIT 2) UNION ALL (SELECT * FROM g WHERE p < 0 ORDER BY p, user_id DESC LIMIT 2))""",
)
def _(t):
    growth = growth_rate(calendar_series(t.events, "ts", ["value"], keys=["user_id"]), ["user_id"])
    return op.entity_winners_losers(growth, "user_id")


def _pareto_sql(source):
    return f"""WITH l AS (SELECT "column", v FROM {source} WHERE v > 0), r AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v DESC) AS r,
      sum(v) OVER (PARTITION BY "column" ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS cs, sum(v) OVER (PARTITION BY "column") AS t, count(*) OVER (PARTITION BY "column") AS n FROM l)
      SELECT "column", max(n) AS n, round(coalesce(sum(v) FILTER (r <= CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)), 0) / max(t), 4) AS top_20pct_share,
      round(count(*) FILTER (cs <= t * CAST(0.8 AS DOUBLE)) / max(n), 4) AS pct_rows_for_80pct,
      round((2 * sum((n + 1 - r) * v) - (max(n) + 1) * max(t)) / (max(n) * max(t)), 4) AS gini FROM r GROUP BY 1 HAVING max(n) >= 4"""


@query("pareto", _pareto_sql(long_sql("lineitem", MEASURES)))
def _(t):
    return bu.pareto(t.lineitem, MEASURES)


@query("pareto_by_customer", _pareto_sql("""(SELECT 'o_totalprice' AS "column", sum(o_totalprice) AS v FROM orders GROUP BY o_custkey)"""))
def _(t):
    return bu.pareto(t.orders, ["o_totalprice"], entity="o_custkey")


def _hhi_sql(source):
    return f"""WITH l AS (SELECT "column", v FROM {source} WHERE v > 0), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v DESC) AS r FROM l),
      h AS (SELECT "column", count(*) AS n, sum(v * v) / sum(v) ** 2 AS hhi, sum(v) FILTER (r <= 5) / sum(v) AS cr5 FROM r GROUP BY 1 HAVING count(*) >= 4)
      SELECT "column", n, round(hhi, 4) AS hhi, round(cr5, 4) AS cr5, CASE WHEN hhi > 0.25 THEN 'highly concentrated' WHEN hhi > 0.1 THEN 'moderately concentrated' ELSE 'competitive' END AS hhi_label FROM h"""


@query("concentration", _hhi_sql(long_sql("supplier", ["s_acctbal", "s_nationkey"])))
def _(t):
    return bu.concentration(t.supplier, ["s_acctbal", "s_nationkey"])


@query("concentration_by_flag", _hhi_sql("""(SELECT 'l_extendedprice' AS "column", sum(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey % 7)"""))
def _(t):
    return bu.concentration(t.lineitem.withColumn("lane", F.col("l_suppkey") % 7), ["l_extendedprice"], entity="lane")


_COHORTS = "(SELECT strftime(o_orderdate, '%Y-%m') AS cohort, count(*) AS cnt, avg(o_totalprice) AS avg_metric FROM orders GROUP BY 1)"
_RATES = f"(SELECT cohort, round(cnt / (SELECT max(cnt) FROM {_COHORTS}), 4) AS retention_rate FROM {_COHORTS})"


def _cohorts(t):
    return bu.cohorts(t.orders, "o_orderdate", "o_totalprice")


@query("cohorts", f"SELECT cohort, cnt, round(avg_metric, 4) AS avg_metric FROM {_COHORTS}")
def _(t):
    return _cohorts(t)


@query(
    "cohorts_by_entity",
    """WITH m AS (SELECT DISTINCT o_custkey AS e, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders), f AS (SELECT *, min(m) OVER (PARTITION BY e) AS f FROM m),
      c AS (SELECT f, m - f AS period, count(*) AS active FROM f GROUP BY 1, 2)
      SELECT printf('%d-%02d', f // 12, f % 12 + 1) AS cohort, CAST(period AS INT) AS period, active, round(active / max(CASE WHEN period = 0 THEN active END) OVER (PARTITION BY f), 4) AS retention FROM c""",
)
def _(t):
    return bu.cohorts_by_entity(t.orders, "o_orderdate", "o_custkey")


@query("retention", f"SELECT * FROM {_RATES}")
def _(t):
    return bu.retention(_cohorts(t))


@query(
    "ltv",
    f"""WITH a AS (SELECT avg(round(avg_metric, 4)) AS m FROM {_COHORTS}), r AS (SELECT sum(retention_rate) AS s, count(*) AS k FROM (SELECT * FROM {_RATES} ORDER BY cohort LIMIT 12))
      SELECT round(m * s, 4) AS ltv_estimate, round(m, 4) AS avg_metric_per_period, k AS periods_used FROM a, r""",
)
def _(t):
    cohorts = _cohorts(t)
    return bu.ltv(cohorts, bu.retention(cohorts))


@query(
    "funnel",
    """WITH c AS (SELECT event_type AS stage, count(*) AS cnt FROM events GROUP BY 1), p AS (SELECT *, coalesce(lag(cnt) OVER (ORDER BY cnt DESC, stage), (SELECT sum(cnt) FROM c)) AS prev FROM c)
      SELECT stage, cnt, round(cnt / (SELECT sum(cnt) FROM c), 4) AS pct_of_total, round(cnt / prev, 4) AS conversion_from_prev, round(1 - round(cnt / prev, 4), 4) AS drop_off FROM p""",
)
def _(t):
    return bu.funnel(t.events, "event_type")


_STAGES = ["view", "click", "signup", "purchase"]


@query(
    "entity_funnel",
    """WITH c AS (SELECT event_type AS stage, count(DISTINCT user_id) AS entities FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1),
      o AS (SELECT *, lag(entities) OVER (ORDER BY list_position(['view', 'click', 'signup', 'purchase'], stage)) AS prev FROM c)
      SELECT stage, entities, round(coalesce(entities / prev, 1.0), 4) AS conversion_from_prev FROM o""",
)
def _(t):
    return bu.entity_funnel(t.events, "user_id", "event_type", _STAGES)


@query(
    "decompose",
    """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS k, sum(l_extendedprice) AS x, count(l_quantity) AS v FROM lineitem GROUP BY 1),
      e AS (SELECT arg_min(x, k) AS x0, arg_max(x, k) AS x1, arg_min(v, k) AS v0, arg_max(v, k) AS v1 FROM m),
      d AS (SELECT x1 - x0 AS dm, (v1 - v0) * (x0 / v0) AS ve, (x1 / v1 - x0 / v0) * v0 AS re FROM e)
      SELECT round(dm, 3) AS delta_metric, round(ve, 3) AS volume_effect, round(re, 3) AS rate_effect, round(coalesce(ve / nullif(ve + re, 0) * 100, 0), 3) AS vol_share, round(coalesce(re / nullif(ve + re, 0) * 100, 0), 3) AS rate_share,
      CASE WHEN abs(ve) > abs(re) THEN 'volume-driven' ELSE 'rate-driven' END AS dominant FROM d""",
    digits=3,
)
def _(t):
    return bu.decompose(t.lineitem, "l_shipdate", "l_extendedprice", "l_quantity")


@query(
    "benchmark",
    f"""WITH l AS (SELECT * FROM {GLONG} WHERE v IS NOT NULL), m AS (SELECT "column", avg(v) AS mu, stddev_samp(v) AS sd FROM l GROUP BY 1)
      SELECT l."column", round(max(mu), 4) AS mean, round(max(sd), 4) AS std, count(*) FILTER ((v - mu) / sd > 2) AS above_2std_count, count(*) FILTER ((v - mu) / sd < -2) AS below_2std_count
      FROM l JOIN m ON l."column" = m."column" GROUP BY 1""",
)
def _(t):
    return bu.benchmark(t.gappy, G)


@query("with_zscore", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 4) AS zscore FROM supplier")
def _(t):
    return bu.with_zscore(t.supplier, "s_acctbal").select("s_suppkey", "zscore")


@query(
    "gini",
    f"""WITH l AS (SELECT "column", coalesce(v, 0) AS v FROM {GLONG}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r, count(*) OVER (PARTITION BY "column") AS n FROM l)
      SELECT "column", max(n) AS n, round(min(v), 4) AS smallest, round((2 * sum(r * v) - (max(n) + 1) * sum(v)) / (max(n) * sum(v)), 4) AS gini FROM r GROUP BY 1""",
)
def _(t):
    return bu.gini(t.gappy.fillna(0.0, G), G)
