"""Structure and signal screens, candidates and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import candidates as ca
from tablescout.operators import exploratory as ex
from tablescout.operators import findings as fi
from tablescout.operators import foundation as fo
from tablescout.operators import signals as si
from tablescout.operators import structure as st
from verification.registry import GAPPY, LINE_ORDER, long_sql, query, text_sql


@query("entity_type", "SELECT 'event_id' AS id_col, 'ts' AS date_col, count(DISTINCT event_id) AS unique_count, count(*) AS n_rows, 'one row per entity' AS guess FROM events HAVING count(DISTINCT event_id) = count(*)")
def _(t):
    return st.entity_type(fo.infer_roles(t.events))


@query(
    "target_candidates",
    f"""WITH p AS (SELECT "column", stddev_samp(v) / avg(v) AS cv, 1 - count(v) / count(*) AS nr FROM {long_sql("(SELECT user_id, value, value * value AS spend, user_id % 5 AS lane FROM events)", ["user_id", "value", "spend", "lane"])} GROUP BY 1),
      s AS (SELECT "column", "column" IN ('value', 'spend') AS kw, CASE WHEN "column" IN ('value', 'spend') THEN 1.5 ELSE 0 END + least(cv, 3) / 3 - nr AS score FROM p),
      r AS (SELECT *, row_number() OVER (ORDER BY score DESC, "column") AS r FROM s)
      SELECT "column", round(score, 4) AS score, kw AS keyword_match, CAST(r AS INT) AS rank FROM r WHERE r <= 3""",
)
def _(t):
    df = t.events.select("user_id", "value", (F.col("value") * F.col("value")).alias("spend"), (F.col("user_id") % 5).alias("lane"))
    cols = ["user_id", "value", "spend", "lane"]
    return st.target_candidates(fo.infer_roles(df, mode="strict"), fo.numeric_profile(df, cols))


@query(
    "column_roles",
    """SELECT * FROM (VALUES ('o_orderkey', 0, 'identifier'), ('o_custkey', 1, 'metric'), ('o_orderstatus', 2, 'dimension'), ('o_totalprice', 3, 'metric'),
      ('o_orderdate', 4, 'time axis'), ('o_orderpriority', 5, 'dimension'), ('late', 6, 'unknown')) v("column", ordinal, role)""",
)
def _(t):
    df = t.orders.withColumn("late", F.col("o_orderstatus") == "O")
    return st.column_roles(fo.infer_roles(df, mode="strict"))


@query("dataset_shape", "SELECT CASE WHEN 4 / count(*) > 0.5 THEN 'wide' ELSE 'long' END AS shape, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols, round(4 / count(*), 4) AS col_row_ratio FROM supplier")
def _(t):
    return st.dataset_shape(t.supplier)


@query(
    "id_columns",
    """SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS unique_count, round(count(DISTINCT o_orderkey) / count(*), 4) AS unique_ratio,
      'true unique ID' AS verdict, count(*) // count(DISTINCT o_orderkey) AS average_repeats FROM orders
      UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), round(count(DISTINCT o_totalprice) / count(*), 4),
      CASE WHEN count(DISTINCT o_totalprice) = count(*) THEN 'true unique ID' ELSE 'near-unique' END, count(*) // count(DISTINCT o_totalprice) FROM orders""",
)
def _(t):
    return st.id_columns(fo.infer_roles(t.orders))


@query(
    "join_keys",
    """SELECT 'user_code' AS "column", count(DISTINCT user_id) AS unique_count, round(count(DISTINCT user_id) / count(*), 4) AS unique_ratio FROM events
      HAVING count(DISTINCT user_id) / count(*) > 0.01 AND count(DISTINCT user_id) / count(*) < 0.95""",
)
def _(t):
    return st.join_keys(fo.infer_roles(t.events.withColumn("user_code", F.concat(F.lit("u"), F.col("user_id").cast("string")))))


@query("boolean_disguise", """SELECT 'quality' AS "column", 'numeric 0/1' AS disguised_as UNION ALL SELECT 'toxic', 'numeric 0/1' UNION ALL SELECT 'answer', 'string/no/yes'""")
def _(t):
    df = t.labels.withColumn("answer", F.when(F.col("quality") == 1, " Yes").otherwise("no"))
    return st.boolean_disguise(df, ["doc_id", "quality", "toxic"], ["answer"])


_NULLS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {i} AS ordinal, count(*) FILTER ({c} IS NULL) / count(*) AS nr, count(*) FILTER ({c} IS NULL AND {o} IS NULL) / count(*) FILTER ({c} IS NULL) AS ov FROM {{t}}"""
    for i, c, o in [(6, "quantity", "discount"), (8, "discount", "quantity"), (9, "tax", "quantity"), (10, "echo", "quantity")]
)
_ECHO = GAPPY.replace(" FROM lineitem)", ", CASE WHEN l_returnflag <> 'R' AND l_linenumber < 7 THEN l_quantity END AS echo FROM lineitem)")


@query(
    "null_intent",
    f"""SELECT "column", CAST(ordinal AS INT) AS ordinal, round(nr, 4) AS null_rate, round(ov, 4) AS overlap_rate, CASE WHEN ov > 0.7 THEN 'systematic' ELSE 'distributed' END AS pattern FROM ({_NULLS.format(t=_ECHO)})""",
)
def _(t):
    df = t.gappy.withColumn("echo", F.when((F.col("l_returnflag") != "R") & (F.col("l_linenumber") < 7), F.col("quantity")))
    return si.null_intent(df, ["quantity", "discount", "tax"])


_SKEWED = "(SELECT l_quantity, l_quantity * l_extendedprice AS value, pow(l_discount, 8) AS spike FROM lineitem)"
_SK = ["l_quantity", "value", "spike"]


def _skewed(t):
    return t.lineitem.select(
        "l_quantity", (F.col("l_quantity") * F.col("l_extendedprice")).alias("value"), F.pow("l_discount", F.lit(8.0)).alias("spike")
    )


@query(
    "outlier_prevalence",
    f"""WITH l AS (SELECT * FROM {long_sql(_SKEWED, _SK)}), m AS (SELECT "column", avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1)
      SELECT l."column", round(count(*) FILTER (abs(v - m) / s > 3) / count(*), 4) AS extreme_pct FROM l JOIN m ON l."column" = m."column" GROUP BY 1""",
)
def _(t):
    return si.outlier_prevalence(_skewed(t), _SK)


@query(
    "correlation_opportunity",
    f"""SELECT 'l_quantity' AS col_a, 'value' AS col_b, round(corr(l_quantity, value), 4) AS r FROM {_SKEWED} HAVING abs(corr(l_quantity, value)) > 0.5
      UNION ALL SELECT 'spike', 'value', round(corr(spike, value), 4) FROM {_SKEWED} HAVING abs(corr(spike, value)) > 0.5
      UNION ALL SELECT 'l_quantity', 'spike', round(corr(l_quantity, spike), 4) FROM {_SKEWED} HAVING abs(corr(l_quantity, spike)) > 0.5""",
)
def _(t):
    return si.correlation_opportunity(_skewed(t), _SK)


_SEGS = ["o_orderstatus", "o_orderpriority"]
_SEG_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS segment_col, 'o_totalprice' AS metric_col, count(*) AS n_groups, round((max(m) - min(m)) / (SELECT avg(o_totalprice) FROM orders), 4) AS relative_spread
      FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY {c}) HAVING (max(m) - min(m)) / (SELECT avg(o_totalprice) FROM orders) > 0.001"""
    for c in _SEGS
)


@query("segment_variables", _SEG_SQL)
def _(t):
    return si.segment_variables(t.orders, "o_totalprice", _SEGS, min_spread=0.001)


def _coverage_sql(table, ts, extra=""):
    return f"""WITH d AS (SELECT epoch_us({ts}) - lag(epoch_us({ts})) OVER (ORDER BY {ts}) AS g FROM {table} {extra}), m AS (SELECT quantile_cont(g, 0.5) AS m FROM d)
      SELECT '{ts}' AS date_col, (SELECT strftime(min({ts}), '%Y-%m-%d') FROM {table} {extra}) AS date_min, (SELECT strftime(max({ts}), '%Y-%m-%d') FROM {table} {extra}) AS date_max,
      (SELECT date_diff('day', CAST(min({ts}) AS DATE), CAST(max({ts}) AS DATE)) FROM {table} {extra}) AS span_days,
      CASE WHEN floor(m / 86400000000) <= 1 THEN 'daily' WHEN floor(m / 86400000000) <= 8 THEN 'weekly' WHEN floor(m / 86400000000) <= 32 THEN 'monthly' ELSE 'irregular' END AS granularity,
      (SELECT count(*) FROM d, m WHERE g > 3 * m) AS gap_count FROM m"""


@query("temporal_coverage", _coverage_sql("orders", "o_orderdate"))
def _(t):
    return si.temporal_coverage(t.orders, "o_orderdate")


@query("temporal_coverage_events", _coverage_sql("events", "ts"))
def _(t):
    return si.temporal_coverage(t.events, "ts")


@query(
    "concentration_screen",
    f"""WITH r AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r, count(*) OVER (PARTITION BY "column") AS n FROM {long_sql(_SKEWED, _SK)})
      SELECT "column", round((2 * sum(r * v) - (max(n) + 1) * sum(v)) / (max(n) * sum(v)), 4) AS gini FROM r GROUP BY 1 HAVING max(n) >= 10 AND min(v) >= 0""",
)
def _(t):
    return si.concentration_screen(_skewed(t), _SK)


_GROW = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "growth_signal",
    "WITH n0 AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, "
    + ", ".join(LINE_ORDER + _GROW)
    + ") - 1 AS pos, count(*) OVER () AS n FROM lineitem), g AS ("
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS "column", avg({m}) FILTER (pos < n // 4) AS e, avg({m}) FILTER (pos >= n - n // 4) AS l FROM n0""" for m in _GROW
    )
    + """) SELECT "column", round(e, 4) AS early_mean, round(l, 4) AS late_mean, round((l - e) / abs(e), 4) AS pct_change FROM g WHERE e <> 0""",
)
def _(t):
    return si.growth_signal(t.lineitem, "l_shipdate", _GROW, LINE_ORDER)


_AZ = ", ".join(f"abs(({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-9))" for c in _SK)


@query("anomaly_prevalence", f"SELECT round(count(*) FILTER (z > 3) / count(*), 4) AS anomaly_rate FROM (SELECT greatest({_AZ}) AS z FROM {_SKEWED})")
def _(t):
    return si.anomaly_prevalence(_skewed(t), _SK)


@query(
    "cardinality_screen",
    f"""SELECT "column", count(DISTINCT v) AS unique_count, round(count(DISTINCT v) / count(*), 4) AS unique_ratio, CASE WHEN count(DISTINCT v) / count(*) > 0.8 THEN 'near-unique'
      WHEN count(DISTINCT v) = 1 THEN 'constant' WHEN count(DISTINCT v) <= 10 THEN 'low cardinality' ELSE 'medium cardinality' END AS label
      FROM {text_sql("(SELECT c_name, c_mktsegment, 'x' AS one, CAST(c_nationkey AS VARCHAR) AS land FROM customer)", ["c_name", "c_mktsegment", "one", "land"])} GROUP BY 1""",
)
def _(t):
    df = t.customer.select("c_name", "c_mktsegment", F.lit("x").alias("one"), F.col("c_nationkey").cast("string").alias("land"))
    return si.cardinality_screen(df, ["c_name", "c_mktsegment", "one", "land"])


def _screens(t):
    """All screens of the events table, as the candidate rules use them."""
    df = t.events
    roles = fo.infer_roles(df)
    numeric, cats = ["user_id", "value"], ["event_type", "props"]
    entity = st.entity_type(roles)
    targets = st.target_candidates(roles, fo.numeric_profile(df, numeric))
    corr = si.correlation_opportunity(df, numeric)
    segments = si.segment_variables(df, "user_id", cats)
    conc = si.concentration_screen(df, numeric)
    growth = si.growth_signal(df, "ts", numeric, ["event_id"])
    anomaly = si.anomaly_prevalence(df, numeric)
    return df, roles, entity, targets, corr, segments, conc, growth, anomaly


_GINI = """(SELECT max(g) AS g FROM (SELECT (2 * sum(r * v) - (max(n) + 1) * sum(v)) / (max(n) * sum(v)) AS g FROM (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r,
  count(*) OVER (PARTITION BY "column") AS n FROM """ + long_sql("events", ["user_id", "value"]) + """) GROUP BY "column" HAVING min(v) >= 0))"""
_AR = """(SELECT count(*) FILTER (z > 3) / count(*) AS a FROM (SELECT greatest(abs((user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER ()), abs((value - avg(value) OVER ()) / stddev_samp(value) OVER ())) AS z FROM events))"""
_GROWTH = """(SELECT max_by(p, abs(p)) AS p FROM (SELECT (l - e) / abs(e) AS p FROM (SELECT avg(user_id) FILTER (o < n // 4) AS e, avg(user_id) FILTER (o >= n - n // 4) AS l FROM o UNION ALL
  SELECT avg(value) FILTER (o < n // 4), avg(value) FILTER (o >= n - n // 4) FROM o)))"""
_CORR = "(SELECT abs(corr(user_id, value)) AS c FROM events)"
_SPREAD = "(SELECT max(s) AS s FROM (SELECT (max(m) - min(m)) / (SELECT avg(user_id) FROM events) AS s FROM (SELECT avg(user_id) AS m FROM events GROUP BY event_type)))"


@query(
    "analysis_hypotheses",
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, user_id, value) - 1 AS o, count(*) OVER () AS n FROM events)
      SELECT 'technique' AS kind, 'Pareto concentration deep-dive' AS label, CAST(0.92 AS DOUBLE) AS confidence FROM {_GINI} WHERE g > 0.4
      UNION ALL SELECT 'technique', CASE WHEN p > 0 THEN 'Time series growth analysis' ELSE 'Time series decline analysis' END, 0.9 FROM {_GROWTH} WHERE abs(p) > 0.15
      UNION ALL SELECT 'technique', 'Regression & causality analysis', 0.88 FROM {_CORR} WHERE c > 0.5
      UNION ALL SELECT 'technique', 'Statistical segment comparison', 0.87 FROM {_SPREAD} WHERE s > 0.2
      UNION ALL SELECT 'technique', 'Cohort & retention analysis', 0.82
      UNION ALL SELECT 'technique', 'Anomaly detection sweep', 0.8 FROM {_AR} WHERE a > 0.03""",
)
def _(t):
    _, roles, entity, _, corr, segments, conc, growth, anomaly = _screens(t)
    out = ca.analysis_hypotheses(entity, conc, growth, corr, segments, anomaly, roles)
    return out.select("kind", "label", "confidence")


@query(
    "missing_analyses",
    """SELECT 'question' AS kind, 'Which metric should we optimize or predict?' AS label, CAST(0.9 AS DOUBLE) AS confidence FROM events HAVING count(DISTINCT user_id) > 1
      UNION ALL SELECT 'question', 'Is there a target period or baseline to compare against?', 0.75
      UNION ALL SELECT 'question', 'Is there external context we should factor in?', 0.65""",
)
def _(t):
    df = t.events
    roles = fo.infer_roles(df, mode="strict")
    targets = st.target_candidates(roles, fo.numeric_profile(df, ["user_id", "value"]))
    return ca.missing_analyses(st.entity_type(roles), targets).select("kind", "label", "confidence")


@query(
    "composite_opportunity",
    f"""SELECT 'technique' AS kind, 'Composite score index' AS label, 'Related columns: l_quantity, value' AS description, CAST(0.75 AS DOUBLE) AS confidence
      FROM (SELECT abs(corr(l_quantity, value)) AS r FROM {_SKEWED}) WHERE r > 0.5 AND r < 0.85""",
)
def _(t):
    df = _skewed(t).withColumn("l_line", F.col("l_quantity") % 7)
    return ca.composite_opportunity(si.correlation_opportunity(df, _SK), fo.infer_roles(df, mode="strict")).select("kind", "label", "description", "confidence")


@query(
    "benchmark_opportunity",
    """SELECT 'question' AS kind, 'Is ''plan'' a treatment/control split?' AS label, CAST(0.85 AS DOUBLE) AS confidence FROM customer HAVING count(*) FILTER (c_nationkey < 5) > 0
      UNION ALL SELECT 'technique', 'A/B or pre/post comparison', 0.85 FROM customer HAVING count(*) FILTER (c_nationkey < 5) > 0""",
)
def _(t):
    plan = F.when(F.col("c_nationkey") < 5, "Control group").otherwise("other")
    return ca.benchmark_opportunity(t.customer.withColumn("plan", plan), ["c_mktsegment", "plan"], ["c_acctbal"]).select("kind", "label", "confidence")


@query(
    "benchmark_opportunity_target",
    """SELECT 'technique' AS kind, 'Actuals vs target analysis on ''budget_acctbal''' AS label, CAST(0.8 AS DOUBLE) AS confidence FROM customer
      HAVING count(*) FILTER (regexp_matches(lower(c_mktsegment), 'control|baseline|benchmark|reference|standard|default|organic|untreated|before|pre')) = 0""",
)
def _(t):
    df = t.customer.withColumnRenamed("c_acctbal", "budget_acctbal")
    return ca.benchmark_opportunity(df, ["c_mktsegment"], ["budget_acctbal"]).select("kind", "label", "confidence")


# One candidate per label and part brand, with confidences taken from the data.
_CANDS = """(SELECT CASE WHEN p_size % 2 = 0 THEN 'question' ELSE 'technique' END AS kind, CAST(p_size % 4 AS INT) AS source_order, p_type || ' ' || (p_size % 10) AS label, p_name AS description, p_retailprice AS confidence FROM part)"""


def _cands(t):
    return t.part.select(
        F.when(F.col("p_size") % 2 == 0, "question").otherwise("technique").alias("kind"),
        F.lit("part").alias("source"),
        (F.col("p_size") % 4).cast("int").alias("source_order"),
        F.concat("p_type", F.lit(" "), (F.col("p_size") % 10).cast("string")).alias("label"),
        F.col("p_name").alias("description"),
        F.col("p_retailprice").alias("confidence"),
    )


_POOL = f"(SELECT kind, source_order, label, description, confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind, label ORDER BY confidence DESC, source_order, description) AS r FROM {_CANDS}) WHERE r = 1)"


@query("pool_candidates", f"SELECT kind, source_order, label, description, round(confidence, 4) AS confidence FROM {_POOL}")
def _(t):
    return ca.pool([_cands(t)]).drop("source")


@query(
    "next_page",
    f"""WITH known AS (SELECT upper(p_type || ' ' || (p_size % 10)) AS label FROM part WHERE p_partkey <= 3),
      f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, source_order, label) AS p, count(*) OVER (PARTITION BY kind) AS n FROM {_POOL} c
        WHERE NOT EXISTS (SELECT 1 FROM known k WHERE contains(lower(c.label), lower(k.label)) OR contains(lower(k.label), lower(c.label))))
      SELECT kind, label, CAST(p AS INT) AS position, n > 6 AS has_more FROM f WHERE p > 3 AND p <= 6""",
)
def _(t):
    known = t.part.where("p_partkey <= 3").select(F.upper(F.concat("p_type", F.lit(" "), (F.col("p_size") % 10).cast("string"))).alias("label"))
    return ca.next_page(ca.pool([_cands(t)]), known, page=2).select("kind", "label", "position", "has_more")


# A dictionary of three frameworks: keywords weigh two, domains one.
_WORDS = [
    ("Alpha", 0, "data", 2), ("Alpha", 0, "model", 2), ("Alpha", 0, "time", 1),
    ("Beta", 1, "data", 2), ("Beta", 1, "people", 2), ("Beta", 1, "city", 1),
    ("Gamma", 2, "water", 2), ("Gamma", 2, "river", 1), ("Gamma", 2, "time", 1),
    ("Delta", 3, "music", 2), ("Delta", 3, "people", 1),
]


@query(
    "match_frameworks",
    f"""WITH w AS (SELECT * FROM (VALUES {", ".join(str(w) for w in _WORDS)}) v(framework, ordinal, word, weight)),
      s AS (SELECT doc_id AS text_id, framework, ordinal, sum(weight) AS score FROM documents JOIN w ON contains(lower(text), word) GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ordinal) AS r FROM s)
      SELECT text_id, framework, CAST(score AS BIGINT) AS score, CAST(r AS INT) AS rank FROM r WHERE r <= 3""",
)
def _(t):
    words = t.spark.createDataFrame(_WORDS, "framework string, ordinal int, word string, weight int")
    return ca.match_frameworks(t.documents, "doc_id", "text", words)


@query("ground_columns", "SELECT doc_id, NOT (contains(lower(text), 'data') OR contains(lower(text), 'source')) AS low_confidence FROM documents")
def _(t):
    return ca.ground_columns(t.documents, "text", ["Data", "Source"]).select("doc_id", "low_confidence")


@query(
    "unique_edges",
    """SELECT s, t, k FROM (SELECT *, row_number() OVER (PARTITION BY least(s, t), greatest(s, t) ORDER BY k) AS r FROM
      (SELECT l_suppkey AS s, l_partkey % 100 AS t, l_orderkey * 10 + l_linenumber AS k FROM lineitem)) WHERE r = 1""",
)
def _(t):
    edges = t.lineitem.select(
        F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")
    )
    return ca.unique_edges(edges, "s", "t", ["k"])


@query(
    "findings",
    f"""WITH l AS (SELECT * FROM {long_sql(_SKEWED, _SK)}), d AS (SELECT "column", skewness(v) AS s FROM l GROUP BY 1),
      f AS (SELECT 'distribution' AS operator, row_number() OVER (ORDER BY "column") AS rank, "column" AS subject, s AS metric FROM d WHERE abs(s) > 1.5)
      SELECT operator, CAST(rank AS INT) AS rank, subject, round(metric, 4) AS metric FROM f""",
)
def _(t):
    return fi.findings_of("distribution", ex.distribution(_skewed(t), _SK)).select("operator", "rank", "subject", "metric")


@query(
    "top_findings",
    """SELECT operator, CAST(r AS INT) AS rank, finding FROM (SELECT event_type AS operator, props AS finding, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5""",
)
def _(t):
    rows = t.events.select(F.col("event_type").alias("operator"), F.col("event_id").alias("rank"), F.col("props").alias("finding"))
    from pyspark.sql.window import Window

    top = fi.top_findings(rows, 5)
    return top.select("operator", F.row_number().over(Window.partitionBy("operator").orderBy("rank")).alias("rank"), "finding")
