"""Distribution, association and group-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import exploratory as op
from verification.registry import GAPPY, MEASURES, long_sql, query, text_sql

LONG = long_sql("lineitem", MEASURES)
PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
# Derived measures that do correlate, so the pairwise thresholds have something to pass.
DERIVED = "(SELECT l_quantity, l_quantity * l_extendedprice AS value, l_extendedprice * (1 - l_discount) AS net, l_extendedprice, l_returnflag, l_linestatus FROM lineitem)"
DERIVED_COLS = ["l_quantity", "value", "net", "l_extendedprice"]


def _derived(t):
    return t.lineitem.select(
        "l_quantity",
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("value"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    )


@query(
    "distribution",
    f"""SELECT "column", count(v) AS n, round(skewness(v), 4) AS skewness, round(kurtosis(v), 4) AS kurtosis,
      round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
      CASE WHEN skewness(v) > 1 THEN 'right-skewed' WHEN skewness(v) < -1 THEN 'left-skewed' ELSE 'symmetric' END AS shape
      FROM {long_sql(DERIVED, DERIVED_COLS)} GROUP BY 1""",
)
def _(t):
    return op.distribution(_derived(t), DERIVED_COLS)


_FENCES = f"""q AS (SELECT "column", count(v) AS n, avg(v) AS m, stddev_samp(v) AS s,
  quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS lo,
  quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS hi FROM l GROUP BY 1)"""


@query(
    "outliers",
    f"""WITH l AS (SELECT * FROM {long_sql(DERIVED, DERIVED_COLS)}), {_FENCES}
      SELECT l."column", max(n) AS n, count(*) FILTER (v < lo OR v > hi) AS iqr_outlier_count, count(*) FILTER (abs(v - m) / s > 3) AS zscore_outlier_count,
      round(max(lo), 4) AS lower_fence, round(max(hi), 4) AS upper_fence, round(count(*) FILTER (v < lo OR v > hi) / max(n), 4) AS iqr_outlier_pct
      FROM l JOIN q ON l."column" = q."column" GROUP BY 1""",
)
def _(t):
    return op.outliers(_derived(t), DERIVED_COLS)


@query(
    "flag_outliers",
    f"""WITH l AS (SELECT * FROM {long_sql("orders", ["o_totalprice"])}), {_FENCES}
      SELECT o_orderkey, (o_totalprice < lo OR o_totalprice > hi) AS is_iqr_outlier, (abs(o_totalprice - m) / s > 3) AS is_zscore_outlier FROM orders, q""",
)
def _(t):
    return op.flag_outliers(t.orders, "o_totalprice").select("o_orderkey", "is_iqr_outlier", "is_zscore_outlier")


@query(
    "normality",
    f"""WITH m AS (SELECT "column", count(v) AS k, CAST(count(v) AS DOUBLE) AS n, avg(v) AS mu FROM {LONG} GROUP BY 1),
      c AS (SELECT l."column", max(k) AS k, max(n) AS n, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4
        FROM {LONG} l JOIN m ON l."column" = m."column" GROUP BY 1),
      g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c),
      a AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
        sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9))-1))-1 AS w2,
        (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
        6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM g),
      d AS (SELECT *, 6+(8/s)*(2/s+sqrt(1+4/(s*s))) AS aa FROM a),
      z AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(ln(w2)/2) AS z1,
        ((1-2/(9*aa))-cbrt((1-2/aa)/(1+x*sqrt(2/(aa-4)))))/sqrt(2/(9*aa)) AS z2 FROM d)
      SELECT "column", k AS n, round(z1*z1+z2*z2, 2) AS statistic, round(exp(-(z1*z1+z2*z2)/2), 2) AS p_value, exp(-(z1*z1+z2*z2)/2) > 0.05 AS is_normal FROM z""",
    digits=2,
)
def _(t):
    return op.normality(t.lineitem, MEASURES)


def _pearson_sql(table, pairs):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, regr_count({b}, {a}) AS n, corr({a}, {b}) AS r FROM {table}" for a, b in pairs
    )


def _spearman_sql(table, pairs):
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, corr(x, y) AS s FROM (SELECT {rank(a)} AS x, {rank(b)} AS y
        FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in pairs
    )


D_PAIRS = [(a, b) for i, a in enumerate(DERIVED_COLS) for b in DERIVED_COLS[i + 1 :]]


@query(
    "correlation",
    f"""SELECT p.col_a, p.col_b, CAST(p.n AS BIGINT) AS n, round(r, 4) AS pearson, round(s, 4) AS spearman FROM ({_pearson_sql(DERIVED, D_PAIRS)}) p
      JOIN ({_spearman_sql(DERIVED, D_PAIRS)}) q ON p.col_a = q.col_a AND p.col_b = q.col_b WHERE abs(r) >= 0.3""",
)
def _(t):
    return op.correlation(_derived(t), DERIVED_COLS)


G_COLS = ["quantity", "discount", "tax"]
G_PAIRS = [("quantity", "discount"), ("quantity", "tax"), ("discount", "tax")]


@query(
    "correlation_with_nulls",
    f"""SELECT p.col_a, p.col_b, CAST(p.n AS BIGINT) AS n, round(r, 4) AS pearson, round(s, 4) AS spearman FROM ({_pearson_sql(GAPPY, G_PAIRS)}) p
      JOIN ({_spearman_sql(GAPPY, G_PAIRS)}) q ON p.col_a = q.col_a AND p.col_b = q.col_b""",
)
def _(t):
    return op.correlation(t.gappy, G_COLS, min_abs=0.0)


@query(
    "pairwise_regression",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(regr_count({b}, {a}) AS BIGINT) AS n, round(regr_slope({b}, {a}), 4) AS slope,
        round(regr_intercept({b}, {a}), 4) AS intercept, round(regr_r2({b}, {a}), 4) AS r2 FROM {DERIVED}"""
        for a, b in D_PAIRS
    ),
)
def _(t):
    return op.pairwise_regression(_derived(t), D_PAIRS, p_values=False)


_THREE = ["l_quantity", "value", "net"]
_R3 = f"SELECT corr(l_quantity, value) AS a, corr(l_quantity, net) AS b, corr(value, net) AS c FROM {DERIVED}"


@query(
    "vif",
    f"""WITH r AS ({_R3}), d AS (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS det FROM r)
      SELECT 'l_quantity' AS "column", round((1 - c*c) / det, 4) AS vif FROM d UNION ALL SELECT 'value', round((1 - b*b) / det, 4) FROM d
      UNION ALL SELECT 'net', round((1 - a*a) / det, 4) FROM d""",
)
def _(t):
    return op.vif(_derived(t), _THREE)


@query(
    "partial_correlation",
    f"""WITH r AS ({_R3}) SELECT * FROM (SELECT 'l_quantity' AS col_a, 'value' AS col_b, round((a - b*c) / sqrt((1-b*b)*(1-c*c)), 4) AS partial_r FROM r
      UNION ALL SELECT 'l_quantity', 'net', round((b - a*c) / sqrt((1-a*a)*(1-c*c)), 4) FROM r
      UNION ALL SELECT 'value', 'net', round((c - a*b) / sqrt((1-a*a)*(1-b*b)), 4) FROM r) WHERE abs(partial_r) >= 0.2""",
)
def _(t):
    return op.partial_correlation(_derived(t), _THREE)


CATS = ["o_orderstatus", "o_orderpriority"]


@query(
    "frequency",
    f"""SELECT "column", v AS value, cnt, round(cnt / n, 4) AS share, CAST(r AS INT) AS rank FROM (SELECT "column", v, count(*) AS cnt,
      sum(count(*)) OVER (PARTITION BY "column") AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS r
      FROM {text_sql("part", ["p_name", "p_brand", "p_type"])} GROUP BY 1, 2) WHERE r <= 10""",
)
def _(t):
    return op.frequency(t.part, ["p_name", "p_brand", "p_type"])


@query(
    "frequency_summary",
    f"""WITH c AS (SELECT "column", v, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY "column") AS BIGINT) AS n
      FROM {text_sql("events", ["event_type", "props"])} GROUP BY 1, 2)
      SELECT "column", max(n) AS n, count(*) AS unique_count, round(max(cnt) / max(n), 4) AS top_value_share,
      count(*) FILTER (cnt < n * CAST(0.01 AS DOUBLE)) AS long_tail_count FROM c GROUP BY 1""",
)
def _(t):
    return op.frequency_summary(t.events, ["event_type", "props"])


def _cardinality_sql(table, cols):
    return f"""SELECT "column", u AS unique_count, round(u / n, 4) AS cardinality_ratio, CASE WHEN u = 2 THEN 'binary' WHEN u <= 10 THEN 'low'
      WHEN u <= 50 THEN 'medium' WHEN u / n < 0.5 THEN 'high' ELSE 'near-unique' END AS label
      FROM (SELECT "column", count(DISTINCT v) AS u, count(*) AS n FROM {text_sql(table, cols)} GROUP BY 1)"""


@query("cardinality", _cardinality_sql("customer", ["c_name", "c_mktsegment"]) + " UNION ALL " + _cardinality_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def _(t):
    return op.cardinality(t.customer, ["c_name", "c_mktsegment"]).unionByName(op.cardinality(t.lineitem, ["l_returnflag", "l_linestatus"]))


_CROSS = """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS k FROM orders GROUP BY 1, 2),
  ra AS (SELECT a, sum(k) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(k) AS n FROM c GROUP BY 1),
  g AS (SELECT ra.a, rb.b, coalesce(k, 0) AS k, ra.n AS ra, rb.n / (SELECT sum(n) FROM rb) AS m FROM ra CROSS JOIN rb LEFT JOIN c ON c.a = ra.a AND c.b = rb.b),
  d AS (SELECT a, b, k, round(k / ra, 3) AS s, m FROM g)"""


@query(
    "crosstab",
    _CROSS + """ SELECT 'o_orderstatus' AS col_a, a AS val_a, 'o_orderpriority' AS col_b, b AS val_b, k AS cnt, round(s, 3) AS row_share,
      round(m, 3) AS marginal, round(abs(s - m), 3) AS deviation FROM d""",
    digits=3,
)
def _(t):
    return op.crosstab(t.orders, [("o_orderstatus", "o_orderpriority")])


@query("crosstab_summary", _CROSS + " SELECT 'o_orderstatus' AS col_a, 'o_orderpriority' AS col_b, round(max(abs(s - m)), 4) AS max_deviation FROM d")
def _(t):
    return op.crosstab_summary(t.orders, [("o_orderstatus", "o_orderpriority")])


_SEG = long_sql("lineitem", MEASURES, "l_returnflag AS g, ")


@query(
    "segment_comparison",
    f"""SELECT 'l_returnflag' AS segment_col, l."column" AS metric_col, g AS "group", round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median,
      round(stddev_samp(v), 4) AS std, count(v) AS count, round((avg(v) - max(o)) / abs(max(o)) * 100, 4) AS pct_diff_from_mean
      FROM {_SEG} l JOIN (SELECT "column", avg(v) AS o FROM {_SEG} GROUP BY 1) t ON l."column" = t."column" GROUP BY 2, 3""",
)
def _(t):
    return op.segment_comparison(t.lineitem, "l_returnflag", MEASURES)


@query(
    "segment_spread",
    f"""WITH m AS (SELECT "column", g, avg(v) AS m FROM {_SEG} GROUP BY 1, 2), o AS (SELECT "column", avg(v) AS o FROM {_SEG} GROUP BY 1)
      SELECT 'l_returnflag' AS segment_col, m."column" AS metric_col, arg_max(g, m) AS top_group, arg_min(g, m) AS bottom_group,
      round((max(m) - min(m)) / abs(max(o)), 4) AS relative_spread FROM m JOIN o ON m."column" = o."column" GROUP BY 2""",
)
def _(t):
    return op.segment_spread(t.lineitem, "l_returnflag", MEASURES)


@query(
    "interaction",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, l_returnflag AS "group", CAST(regr_count({b}, {a}) AS BIGINT) AS n, round(corr({a}, {b}), 4) AS r
        FROM {DERIVED} GROUP BY l_returnflag HAVING regr_count({b}, {a}) >= 5"""
        for a, b in D_PAIRS[:4]
    ),
)
def _(t):
    return op.interaction(_derived(t), "l_returnflag", D_PAIRS[:4])


@query(
    "interaction_spread",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, 'l_linestatus' AS segment_col, round(max(r) - min(r), 4) AS spread FROM (
        SELECT round(corr({a}, {b}), 3) AS r FROM {DERIVED} GROUP BY l_linestatus)"""
        for a, b in D_PAIRS[:4]
    ),
)
def _(t):
    return op.interaction_spread(_derived(t), "l_linestatus", D_PAIRS[:4])


# Three groups make two numerator degrees of freedom, for which the F tail has a closed form.
_F_TEST = """k AS (SELECT "column", count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM gr WHERE n >= 3 GROUP BY 1),
  f AS (SELECT gr."column", max(k) - 1 AS df1, max(k.n) - max(k) AS df2,
    (sum(gr.n * (m - gm) * (m - gm)) / (max(k) - 1)) / (sum((gr.n - 1) * s * s) / (max(k.n) - max(k))) AS f
    FROM gr JOIN k ON gr."column" = k."column" WHERE gr.n >= 3 GROUP BY 1)"""
_P2 = "pow(df2 / (df2 + 2 * f), df2 / 2.0)"


@query(
    "anova",
    f"""WITH gr AS (SELECT "column", g, count(v) AS n, avg(v) AS m, stddev_samp(v) AS s FROM {_SEG} GROUP BY 1, 2), {_F_TEST}
      SELECT "column" AS metric_col, round(f, 4) AS f_statistic, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round({_P2}, 4) AS p_value,
      {_P2} < 0.05 AS significant FROM f""",
)
def _(t):
    return op.anova(t.lineitem, "l_returnflag", MEASURES)


@query(
    "levene",
    f"""WITH md AS (SELECT "column", g, quantile_cont(v, 0.5) AS md FROM {_SEG} GROUP BY 1, 2),
      gr AS (SELECT l."column", l.g, count(v) AS n, avg(abs(v - md)) AS m, stddev_samp(abs(v - md)) AS s
        FROM {_SEG} l JOIN md ON l."column" = md."column" AND l.g = md.g GROUP BY 1, 2), {_F_TEST}
      SELECT "column" AS metric_col, round(f, 4) AS statistic, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round({_P2}, 4) AS p_value,
      {_P2} > 0.05 AS equal_variance FROM f""",
)
def _(t):
    return op.levene(t.lineitem, "l_returnflag", MEASURES)


def _chi_sql(table, a, b, yates=False):
    gap = "(abs(k - e) - least(0.5, abs(k - e)))" if yates else "(k - e)"
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, sum({gap} * {gap} / e) AS chi2, (max(ra) - 1) * (max(rb) - 1) AS dof,
      sqrt(sum({gap} * {gap} / e) / ((SELECT count(*) FROM {table}) * (least(max(ra), max(rb)) - 1))) AS v FROM (
      SELECT coalesce(c.k, 0) AS k, x.n * y.n / (SELECT count(*) FROM {table}) AS e, (SELECT count(DISTINCT {a}) FROM {table}) AS ra,
      (SELECT count(DISTINCT {b}) FROM {table}) AS rb
      FROM (SELECT {a}, CAST(count(*) AS DOUBLE) AS n FROM {table} GROUP BY 1) x CROSS JOIN (SELECT {b}, CAST(count(*) AS DOUBLE) AS n FROM {table} GROUP BY 1) y
      LEFT JOIN (SELECT {a}, {b}, CAST(count(*) AS DOUBLE) AS k FROM {table} GROUP BY 1, 2) c ON c.{a} = x.{a} AND c.{b} = y.{b})"""


# Eight degrees of freedom: an even number gives the tail as a short sum.
@query(
    "chi_square",
    f"""SELECT col_a, col_b, round(chi2, 4) AS chi2, CAST(dof AS BIGINT) AS dof, round(v, 4) AS cramers_v,
      round(exp(-chi2/2) * (1 + chi2/2 + pow(chi2/2, 2)/2 + pow(chi2/2, 3)/6), 4) AS p_value,
      exp(-chi2/2) * (1 + chi2/2 + pow(chi2/2, 2)/2 + pow(chi2/2, 3)/6) < 0.05 AS significant
      FROM ({_chi_sql("orders", "o_orderstatus", "o_orderpriority")})""",
)
def _(t):
    return op.chi_square(t.orders, CATS)


@query(
    "chi_square_pairs",
    " UNION ALL ".join(
        f"SELECT col_a, col_b, round(chi2, 4) AS chi2, CAST(dof AS BIGINT) AS dof, round(v, 4) AS cramers_v FROM ({_chi_sql(table, a, b, yates)})"
        for table, a, b, yates in [
            ("(SELECT l_returnflag, l_linestatus, l_linenumber % 2 AS odd, CASE WHEN l_returnflag = 'A' AND l_linenumber < 4 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS code FROM lineitem)", a, b, y)
            for a, b, y in [
                ("l_returnflag", "l_linestatus", False),
                ("l_returnflag", "odd", False),
                ("l_returnflag", "code", False),
                ("l_linestatus", "odd", True),
                ("l_linestatus", "code", False),
                ("odd", "code", False),
            ]
        ]
    ),
)
def _(t):
    code = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") < 4), "x").otherwise(F.col("l_linenumber").cast("string"))
    df = t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("odd"), code.alias("code"))
    return op.chi_square(df, ["l_returnflag", "l_linestatus", "odd", "code"], p_values=False)
