"""Series queries: calendar series and full row sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import timeseries as op
from tablescout.plans.sequence import calendar_series, row_series
from verification.registry import GAPPY, LINE_ORDER, query

SERIES = ["l_quantity", "l_extendedprice", "l_discount"]
ORDER_SQL = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

# The row sequence of line items as the SQL sees it: one row per metric and dated row.
ROWS = f"""n0 AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}, l_quantity, l_extendedprice, l_discount) - 1 AS pos, count(*) OVER () AS n_rows FROM lineitem),
  s AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, l_shipdate AS ts, pos, n_rows, pos AS idx, n_rows AS n, {m} AS value FROM n0" for m in SERIES)})"""

GAP_METRICS = ["quantity", "l_extendedprice", "discount"]
GAP_ROWS = f"""n0 AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}, quantity, l_extendedprice, discount) - 1 AS pos, count(*) OVER () AS n_rows FROM {GAPPY}),
  s0 AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, l_shipdate AS ts, pos, n_rows, {m} AS value FROM n0 WHERE {m} IS NOT NULL" for m in GAP_METRICS)}),
  s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY metric) AS n FROM s0)"""

DAYS = f"""d AS (SELECT date_trunc('day', l_shipdate) AS ts, {", ".join(f"avg({m}) AS {m}" for m in SERIES)} FROM lineitem GROUP BY 1),
  n0 AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n_rows FROM d),
  s AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, ts, pos, n_rows, pos AS idx, n_rows AS n, {m} AS value FROM n0" for m in SERIES)})"""

# Daily event values per user: many keyed series.
USERS = """s AS (SELECT user_id, 'value' AS metric, ts, value, row_number() OVER w - 1 AS pos, row_number() OVER w - 1 AS idx,
    count(*) OVER (PARTITION BY user_id) AS n_rows, count(*) OVER (PARTITION BY user_id) AS n
    FROM (SELECT user_id, date_trunc('day', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


def _rows(t):
    return row_series(t.lineitem, "l_shipdate", SERIES, LINE_ORDER)


def _gaps(t):
    return row_series(t.gappy, "l_shipdate", GAP_METRICS, LINE_ORDER)


def _days(t):
    return calendar_series(t.lineitem, "l_shipdate", SERIES)


def _users(t):
    return calendar_series(t.events, "ts", ["value"], keys=["user_id"])


def _both(name, body, function, digits=4, keyed=None):
    """Register an analysis on the row sequence, on the sequence with gaps, and on the daily series."""
    query(f"{name}_rows", f"WITH {ROWS} {body}", digits)(lambda t: function(_rows(t)))
    query(f"{name}_gaps", f"WITH {GAP_ROWS} {body}", digits)(lambda t: function(_gaps(t)))
    query(f"{name}_daily", f"WITH {DAYS} {body}", digits)(lambda t: function(_days(t)))
    if keyed:
        query(f"{name}_by_user", f"WITH {USERS} {keyed}", digits)(lambda t: function(_users(t), ["user_id"]))


_TREND = """SELECT {k}metric, count(*) AS n, round(regr_slope(value, pos), 6) AS slope, round(coalesce(corr(value, pos), 0) ** 2, 6) AS r_squared,
  CASE WHEN regr_slope(value, pos) > 0 THEN 'upward' ELSE 'downward' END AS direction,
  round(coalesce(regr_slope(value, pos) * count(*) / abs(avg(value)) * 100, 0), 6) AS total_pct_change FROM s WHERE n >= 4 GROUP BY {g}"""


def _trend(s, keys=()):
    return op.trend(s, keys, p_values=False)


_both("trend", _TREND.format(k="", g="1"), _trend, digits=6, keyed=_TREND.format(k="user_id, ", g="1, 2"))

_GROWTH = """, p AS (SELECT *, lag(value) OVER (PARTITION BY {k}metric ORDER BY idx) AS pv FROM s WHERE n >= 2)
  SELECT {k}metric, round(arg_min(value, idx), 4) AS first_value, round(arg_max(value, idx), 4) AS last_value,
  round(coalesce((arg_max(value, idx) - arg_min(value, idx)) / nullif(abs(arg_min(value, idx)), 0) * 100, 0), 4) AS total_pct_change,
  round(CASE WHEN arg_min(value, idx) > 0 AND arg_max(value, idx) > 0 THEN (pow(arg_max(value, idx) / arg_min(value, idx), 1.0 / (count(*) - 1)) - 1) * 100 END, 4) AS cagr_pct,
  round(avg((value - pv) / nullif(pv, 0)) * 100, 4) AS avg_period_growth_pct, count(*) - 1 AS periods FROM p GROUP BY {g}"""
_both("growth_rate", _GROWTH.format(k="", g="1"), op.growth_rate, keyed=_GROWTH.format(k="user_id, ", g="1, 2"))

_VOL = """, w AS (SELECT *, greatest(5, n_rows // 10) AS w, avg(value) OVER (PARTITION BY metric) AS mu FROM s),
  c AS (SELECT metric, idx, w, sum(value - mu) OVER o AS s1, sum((value - mu) * (value - mu)) OVER o AS s2 FROM w WHERE n >= 2 * w WINDOW o AS (PARTITION BY metric ORDER BY idx)),
  r AS (SELECT a.metric, a.w, sqrt(greatest(((a.s2 - coalesce(b.s2, 0)) - (a.s1 - coalesce(b.s1, 0)) ** 2 / a.w) / (a.w - 1), 0)) AS sd
    FROM c a LEFT JOIN c b ON a.metric = b.metric AND b.idx = a.idx - a.w WHERE a.idx >= a.w - 1)
  SELECT metric, CAST(max(w) AS BIGINT) AS window, round(avg(sd), 3) AS mean_rolling_std, round(max(sd), 3) AS max_rolling_std,
  round(max(sd) / greatest(min(sd), 1e-9), 3) AS vol_ratio FROM r GROUP BY 1"""
_VOL = _VOL.replace(" AS window,", ' AS "window",')
_both("rolling_volatility", _VOL, op.rolling_volatility, digits=3)

_PEAKS = """, p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b, avg(value) OVER (PARTITION BY {k}metric) AS mu FROM s WHERE n >= 5 WINDOW w AS (PARTITION BY {k}metric ORDER BY idx)),
  q AS (SELECT {k}metric, count(*) FILTER (value > a AND value > b) AS peak_count, count(*) FILTER (value < a AND value < b) AS valley_count,
    max(value) FILTER (value > a AND value > b) AS max_peak, min(value) FILTER (value < a AND value < b) AS min_valley, max(mu) AS mu FROM p GROUP BY {g})
  SELECT {k}metric, peak_count, valley_count, round(max_peak, 4) AS max_peak, round(min_valley, 4) AS min_valley,
  round(CASE WHEN max_peak <> 0 AND min_valley <> 0 AND max_peak <> min_valley THEN (max_peak - min_valley) / abs(mu) * 100 END, 4) AS swing_pct
  FROM q WHERE peak_count > 0 OR valley_count > 0"""
_both("peaks_valleys", _PEAKS.format(k="", g="1"), op.peaks_valleys, keyed=_PEAKS.format(k="user_id, ", g="1, 2"))

_STAT = """, h AS (SELECT {k}metric, avg(value) FILTER (idx < n // 2) AS m1, avg(value) FILTER (idx >= n // 2) AS m2, stddev_samp(value) FILTER (idx < n // 2) AS s1,
  stddev_samp(value) FILTER (idx >= n // 2) AS s2, avg(value) AS m, stddev_samp(value) AS sd FROM s WHERE n >= 8 GROUP BY {g})
  SELECT {k}metric, round(coalesce(abs(m1 - m2) / abs(m), 0), 4) AS mean_shift_ratio, round(abs(s1 - s2) / greatest(sd, 1e-9), 4) AS std_shift_ratio,
  coalesce(abs(m1 - m2) / abs(m), 0) < 0.1 AND abs(s1 - s2) / greatest(sd, 1e-9) < 0.3 AS likely_stationary FROM h"""
_both("stationarity", _STAT.format(k="", g="1"), op.stationarity, keyed=_STAT.format(k="user_id, ", g="1, 2"))

_CP = """, w AS (SELECT *, greatest(3, n // 5) AS w, sum(value) OVER (PARTITION BY {k}metric ORDER BY idx) - value AS p, sum(value) OVER (PARTITION BY {k}metric) AS t FROM s WHERE n >= 10),
  c AS (SELECT *, p / idx AS l, (t - p) / (n - idx) AS r FROM w WHERE idx >= w AND idx < n - w),
  k AS (SELECT * FROM c WHERE abs(r - l) / abs(t / n) > {cut}),
  a AS (SELECT {k}metric, min(idx) AS i FROM k GROUP BY {g}),
  b AS (SELECT {kk}k.metric, min(k.idx) AS i FROM k JOIN a ON {on}k.metric = a.metric WHERE k.idx > a.i + k.w GROUP BY {g}),
  e AS (SELECT {kk}k.metric, min(k.idx) AS i FROM k JOIN b ON {on2}k.metric = b.metric WHERE k.idx > b.i + k.w GROUP BY {g}),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e)
  SELECT {kk}k.metric, k.idx AS cp_index, strftime(k.ts, '%Y-%m-%d') AS cp_date, round(l, 8) AS before_mean, round(r, 8) AS after_mean,
  round(coalesce((r - l) / abs(l) * 100, 0), 8) AS pct_shift FROM k JOIN u ON {on3}k.metric = u.metric AND k.idx = u.i"""


def _cps(s, keys=()):
    # Their SQL holds the three earliest.
    return op.changepoints(s, keys, top=3).withColumn("cp_date", F.date_format("cp_date", "yyyy-MM-dd"))


_CP_ALL = _CP.format(k="", kk="", g="1", on="", on2="", on3="", cut=0.15)
_CP_USER = _CP.format(
    k="user_id, ", kk="k.user_id, ", g="1, 2", on="k.user_id = a.user_id AND ", on2="k.user_id = b.user_id AND ", on3="k.user_id = u.user_id AND ", cut=0.15
)
query("changepoints_by_user", f"WITH {USERS} {_CP_USER}", digits=8)(lambda t: _cps(_users(t), ["user_id"]))
# Prices of the second half of the table are halved, so that the row sequence holds a shift.
_SHIFTED = f"""n0 AS (SELECT l_shipdate AS ts, CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 0.5 ELSE 1 END * l_extendedprice AS price,
  CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 3 ELSE 1 END * l_quantity AS amount, {ORDER_SQL[len('l_shipdate, '):]} FROM lineitem),
  n1 AS (SELECT *, row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, amount) - 1 AS idx, count(*) OVER () AS n FROM n0),
  s AS (SELECT 'price' AS metric, ts, idx, n, price AS value FROM n1 UNION ALL SELECT 'amount', ts, idx, n, amount FROM n1)"""


@query("changepoints_rows", f"WITH {_SHIFTED} {_CP_ALL.replace(", 8)", ", 6)")}", digits=6)
def _(t):
    late = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    df = t.lineitem.select(
        "l_shipdate",
        *LINE_ORDER,
        (F.when(late, 0.5).otherwise(1.0) * F.col("l_extendedprice")).alias("price"),
        (F.when(late, 3.0).otherwise(1.0) * F.col("l_quantity")).alias("amount"),
    )
    return _cps(row_series(df, "l_shipdate", ["price", "amount"], LINE_ORDER))


_FORECAST = """, f AS (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS m FROM s WHERE n >= 6),
  t AS (SELECT {k}metric, max(value) FILTER (idx = m - 1) AS a, avg(value) FILTER (idx < m AND idx >= m - 5) AS b,
    sum((CAST(0.3 AS DOUBLE) * pow(CAST(0.7 AS DOUBLE), m - 1 - idx) + CASE WHEN idx = 0 THEN pow(CAST(0.7 AS DOUBLE), m) ELSE 0 END) * value) FILTER (idx < m) AS c FROM f GROUP BY {g}),
  e AS (SELECT {kf}f.metric, avg(abs(value - a) / nullif(abs(value), 0)) * 100 AS ea, avg(abs(value - b) / nullif(abs(value), 0)) * 100 AS eb,
    avg(abs(value - c) / nullif(abs(value), 0)) * 100 AS ec, max(c) AS c FROM f JOIN t ON {on}f.metric = t.metric WHERE idx >= m GROUP BY {g})
  SELECT {k}metric, round(nullif(ea, 0), 4) AS naive_mape, round(nullif(eb, 0), 4) AS moving_avg_mape, round(nullif(ec, 0), 4) AS exp_smoothing_mape, round(c, 4) AS next_period_forecast,
  CASE WHEN ea = least(ea, eb, ec) THEN 'naive' WHEN eb = least(ea, eb, ec) THEN 'moving average' WHEN ec = least(ea, eb, ec) THEN 'exp smoothing' END AS best_method FROM e"""
_both(
    "forecast_baseline",
    _FORECAST.format(k="", kf="", g="1", on=""),
    op.forecast_baseline,
    keyed=_FORECAST.format(k="user_id, ", kf="f.user_id, ", g="1, 2", on="f.user_id = t.user_id AND "),
)

_DETREND = """, b AS (SELECT *, least(5, n // 2) AS w FROM s WHERE n >= 8),
  y AS (SELECT metric, idx, n, value - avg(value) OVER (PARTITION BY metric ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM b)"""
_CYCLE = (
    _DETREND
    + """, f AS (SELECT y.metric, k, max(n) AS n, sqrt(sum(y * cos(2 * pi() * ((k * idx) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((k * idx) % n) / n)) ** 2) AS m
    FROM y, (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM s))) AS k) WHERE k <= n // 2 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY m DESC, k) AS r FROM f)
  SELECT metric, CAST(n AS BIGINT) AS n, CAST(round_even(n / k, 0) AS BIGINT) AS dominant_period, round(k / n, 4) AS dominant_freq, round(m, 4) AS magnitude FROM r WHERE r = 1"""
)

query("cycles_daily", f"WITH {DAYS} {_CYCLE}")(lambda t: op.cycles(_days(t)))
_CYCLE_USER = """, b AS (SELECT *, least(5, n // 2) AS w FROM s WHERE n >= 8),
  y AS (SELECT user_id, metric, idx, n, CASE WHEN w = 5 THEN value - avg(value) OVER (PARTITION BY user_id, metric ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
    ELSE value - avg(value) OVER (PARTITION BY user_id, metric ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS y FROM b),
  f AS (SELECT user_id, metric, k, max(n) AS n, sqrt(sum(y * cos(2 * pi() * ((k * idx) % n) / n)) ** 2 + sum(y * sin(2 * pi() * ((k * idx) % n) / n)) ** 2) AS m
    FROM y, (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM s))) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY m DESC, k) AS r FROM f)
  SELECT user_id, metric, CAST(n AS BIGINT) AS n, CAST(round_even(n / k, 0) AS BIGINT) AS dominant_period, round(k / n, 4) AS dominant_freq, round(m, 4) AS magnitude FROM r WHERE r = 1"""

query("cycles_by_user", f"WITH {USERS} {_CYCLE_USER}")(lambda t: op.cycles(_users(t), ["user_id"]))
query("cycles_rows_long")(lambda t: op.long_cycles(_rows(t)))


@query(
    "seasonality",
    """WITH m AS (SELECT metric, month(d) AS k, avg(v) AS m FROM (SELECT 'l_quantity' AS metric, l_shipdate AS d, l_quantity AS v FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_shipdate, l_extendedprice FROM lineitem) GROUP BY 1, 2)
      SELECT metric, count(*) AS months, round(stddev_samp(m) / abs(avg(m)), 4) AS monthly_cv, CAST(arg_max(k, m) AS INT) AS peak_month, CAST(arg_min(k, m) AS INT) AS trough_month
      FROM m GROUP BY 1 HAVING count(*) >= 4""",
)
def _(t):
    return op.seasonality(t.lineitem, "l_shipdate", ["l_quantity", "l_extendedprice"])


@query("monthly_means", "SELECT 'o_totalprice' AS metric, CAST(month(o_orderdate) AS INT) AS month, round(avg(o_totalprice), 4) AS month_mean FROM orders GROUP BY 2")
def _(t):
    return op.monthly_means(t.orders, "o_orderdate", ["o_totalprice"])


# A lagged copy two rows later is derived from the sequence, so that a lead exists to be found.
_LAG_COLS = ["l_extendedprice", "l_quantity", "l_tax"]


def _lag_sql(cut):
    parts = []
    for i, a in enumerate(_LAG_COLS):
        for b in _LAG_COLS[i + 1 :]:
            for k in range(1, 13):
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {k} AS k, corr({a}, lag{k}_{b}) AS r FROM z")
    lags = ", ".join(f"lag({b}, {k}) OVER (ORDER BY pos) AS lag{k}_{b}" for b in _LAG_COLS[1:] for k in range(1, 13))
    order = ", ".join(["l_shipdate", *LINE_ORDER, *_LAG_COLS])
    return f"""WITH n0 AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pos FROM lineitem), z AS (SELECT *, {lags} FROM n0),
      r AS ({" UNION ALL ".join(parts)}), q AS (SELECT *, row_number() OVER (PARTITION BY col_a, col_b ORDER BY abs(r) DESC, k) AS o FROM r)
      SELECT col_a, col_b, col_b AS leader, CAST(k AS INT) AS best_lag, round(r, 4) AS r FROM q WHERE o = 1 AND abs(r) > {cut}"""


@query("lag_correlation", _lag_sql(0.0))
def _(t):
    return op.lag_correlation(t.lineitem, "l_shipdate", _LAG_COLS, LINE_ORDER, min_abs=0.0)


_DRIFT_COLS = ["l_returnflag", "l_linestatus"]


def _drift_sql(cut):
    return f"""WITH n0 AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS pos, count(*) OVER () AS n FROM lineitem),
      l AS (SELECT 'l_returnflag' AS "column", l_returnflag AS category, pos < n // 2 AS early FROM n0 UNION ALL SELECT 'l_linestatus', l_linestatus, pos < n // 2 FROM n0),
      t AS (SELECT "column", count(*) FILTER (early) AS te, count(*) FILTER (NOT early) AS tl FROM l GROUP BY 1),
      c AS (SELECT l."column", category, count(*) FILTER (early) / max(te) AS e, count(*) FILTER (NOT early) / max(tl) AS f FROM l JOIN t ON l."column" = t."column" GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY abs(round(f - e, 4)) DESC, category) AS r FROM c WHERE abs(f - e) > {cut})
      SELECT "column", category, round(e, 4) AS early_share, round(f, 4) AS late_share, round(f - e, 4) AS delta FROM r WHERE r <= 5"""


@query("category_drift", _drift_sql(0.0001))
def _(t):
    return op.category_drift(t.lineitem, "l_shipdate", _DRIFT_COLS, LINE_ORDER, min_delta=0.0001)


def _lag_by_flag_sql(source, order, cut):
    parts, lags = [], []
    for a, b in [("l_extendedprice", "l_quantity")]:
        for k in range(1, 13):
            parts.append(f"SELECT f, '{a}' AS col_a, '{b}' AS col_b, {k} AS k, corr({a}, lag{k}_{b}) AS r FROM z GROUP BY f HAVING {k} <= max(n) // 4")
            lags.append(f"lag({b}, {k}) OVER (PARTITION BY f ORDER BY {order}) AS lag{k}_{b}")
    return f"""WITH z AS (SELECT *, count(*) OVER (PARTITION BY f) AS n, {", ".join(lags)} FROM {source}), r AS ({" UNION ALL ".join(parts)}),
      q AS (SELECT *, row_number() OVER (PARTITION BY f, col_a, col_b ORDER BY abs(r) DESC, k) AS o FROM r WHERE r IS NOT NULL)
      SELECT f AS l_returnflag, col_a, col_b, col_b AS leader, CAST(k AS INT) AS best_lag, round(r, 4) AS r FROM q WHERE o = 1 AND abs(r) > {cut}"""


_BY_FLAG = ["l_extendedprice", "l_quantity"]


@query("lag_correlation_by_flag", _lag_by_flag_sql("(SELECT *, l_returnflag AS f FROM lineitem)", f"{ORDER_SQL}, l_extendedprice, l_quantity", 0.0))
def _(t):
    return op.lag_correlation(t.lineitem, "l_shipdate", _BY_FLAG, LINE_ORDER, min_abs=0.0, keys=["l_returnflag"])


_MONTHS = """(SELECT l_returnflag AS f, date_trunc('month', l_shipdate) AS ts, avg(l_extendedprice) AS l_extendedprice, avg(l_quantity) AS l_quantity
  FROM lineitem GROUP BY 1, 2)"""


@query("lag_correlation_monthly", _lag_by_flag_sql(_MONTHS, "ts", 0.0))
def _(t):
    return op.lag_correlation(t.lineitem, "l_shipdate", _BY_FLAG, min_abs=0.0, keys=["l_returnflag"], grain="month")


@query(
    "category_drift_by_flag",
    """WITH n0 AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus) - 1 AS pos,
        count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
      t AS (SELECT l_returnflag, count(*) FILTER (pos < n // 2) AS te, count(*) FILTER (pos >= n // 2) AS tl FROM n0 GROUP BY 1),
      c AS (SELECT n0.l_returnflag, l_linestatus AS category, count(*) FILTER (pos < n // 2) / max(te) AS e, count(*) FILTER (pos >= n // 2) / max(tl) AS f
        FROM n0 JOIN t ON n0.l_returnflag = t.l_returnflag GROUP BY 1, 2)
      SELECT l_returnflag, 'l_linestatus' AS "column", category, round(e, 4) AS early_share, round(f, 4) AS late_share, round(f - e, 4) AS delta FROM c WHERE abs(f - e) > 0.0""",
)
def _(t):
    return op.category_drift(t.lineitem, "l_shipdate", ["l_linestatus"], LINE_ORDER, min_delta=0.0, keys=["l_returnflag"])
