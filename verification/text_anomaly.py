"""Text, anomaly and duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import anomaly as an
from tablescout.operators import findings as fi
from tablescout.operators import text as op
from verification.registry import GAPPY, query, text_sql

_PATTERN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{name}' AS pattern, count(*) FILTER (regexp_matches({c}, '{pattern}')) AS match_count,
      round(count(*) FILTER (regexp_matches({c}, '{pattern}')) / count({c}), 4) AS match_pct FROM {table}"""
    for table, c in [("documents", "text"), ("documents", "source")]
    for name, pattern in op.PATTERNS.items()
)


@query("pattern_counts", f"SELECT * FROM ({_PATTERN_SQL}) WHERE match_count > 0")
def _(t):
    return op.pattern_counts(t.documents, ["text", "source"])


_PAGE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{name}' AS pattern, count(*) FILTER (regexp_matches({c}, '{pattern}')) AS match_count,
      round(count(*) FILTER (regexp_matches({c}, '{pattern}')) / count({c}), 4) AS match_pct FROM pages"""
    for c in ("url", "html")
    for name, pattern in op.PATTERNS.items()
)


@query("pattern_counts_pages", f"SELECT * FROM ({_PAGE_SQL}) WHERE match_count > 0")
def _(t):
    return op.pattern_counts(t.pages, ["url", "html"])


@query(
    "near_duplicate_values",
    f"""WITH v AS (SELECT DISTINCT "column", v, lower(trim(v)) AS k FROM {text_sql("part", ["p_name", "p_brand", "p_type"])})
      SELECT a."column", a.v AS value_a, b.v AS value_b, round(1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)), 4) AS similarity
      FROM v a JOIN v b ON a."column" = b."column" AND a.v < b.v AND a.k <> b.k WHERE 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)) >= 0.8""",
)
def _(t):
    return op.near_duplicate_values(t.part, ["p_name", "p_brand", "p_type"])


@query(
    "near_duplicate_urls",
    f"""WITH v AS (SELECT DISTINCT url AS v, lower(trim(url)) AS k FROM pages)
      SELECT 'url' AS "column", a.v AS value_a, b.v AS value_b, round(1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)), 4) AS similarity
      FROM v a JOIN v b ON a.v < b.v AND a.k <> b.k WHERE 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)) >= 0.95""",
)
def _(t):
    return op.near_duplicate_values(t.pages, ["url"], min_sim=0.95)


_CO = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{a}' AS col_a, {a} AS val_a, '{b}' AS col_b, {b} AS val_b, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM lineitem), 4) AS pct,
      count(*) / (SELECT count(*) FROM lineitem) AS p FROM {{t}} GROUP BY 2, 4 ORDER BY cnt DESC, val_a, val_b LIMIT 3) WHERE p > 0.05"""
    for a, b in [("l_returnflag", "l_linestatus"), ("l_returnflag", "code"), ("l_linestatus", "code")]
)


@query(
    "co_occurrence",
    "SELECT col_a, val_a, col_b, val_b, cnt, pct FROM ("
    + _CO.format(t="(SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS code FROM lineitem)")
    + ")",
)
def _(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("code"))
    return op.co_occurrence(df, ["l_returnflag", "l_linestatus", "code"], per_pair=3)


_Z_COLS = ["quantity", "l_extendedprice", "discount"]
_Z = " + ".join(f"abs(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ())" for c in _Z_COLS)


@query(
    "zscore_anomaly",
    f"""WITH z AS (SELECT ({_Z}) / 3 AS z FROM {GAPPY} WHERE quantity IS NOT NULL AND discount IS NOT NULL)
      SELECT count(*) AS n, count(*) FILTER (z > 3) AS anomaly_count, round(count(*) FILTER (z > 3) / count(*), 4) AS anomaly_rate, 'zscore_average' AS method FROM z""",
)
def _(t):
    return an.zscore_anomaly(t.gappy, _Z_COLS)


@query(
    "zscore_rows",
    """SELECT s_suppkey, round((abs((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER ()) + abs((s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER ())) / 2, 4) AS mean_abs_z,
      (abs((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER ()) + abs((s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER ())) / 2 > 3 AS is_anomaly FROM supplier""",
)
def _(t):
    return an.zscore_rows(t.supplier, ["s_acctbal", "s_nationkey"]).select("s_suppkey", "mean_abs_z", "is_anomaly")


@query("isolation_forest")
def _(t):
    scored = an.isolation_forest(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return scored.where("is_anomaly").select("l_orderkey", "l_linenumber", "anomaly_score")


@query("anomaly_score")
def _(t):
    return an.anomaly_score(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _dup_sql(table, keys):
    return f"""SELECT n - e AS exact_duplicate_count, round((n - e) / n, 4) AS exact_duplicate_rate, n - d AS near_duplicate_count, round((n - d) / n, 4) AS near_duplicate_rate
      FROM (SELECT (SELECT count(*) FROM {table}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS e, (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table})) AS d)"""


@query("duplicates", _dup_sql("documents", "text, lang, source, n_chars"))
def _(t):
    return an.duplicates(t.documents, id_cols=["doc_id"])


@query("duplicates_events", _dup_sql("events", "user_id, event_type, value, props"))
def _(t):
    return an.duplicates(t.events, id_cols=["event_id"], time_cols=["ts"])


@query("duplicate_groups", "SELECT md5(text) AS text_md5, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1")
def _(t):
    return an.duplicate_groups(t.documents, ["text", "lang"]).select(F.md5("text").alias("text_md5"), "lang", "copies")


@query(
    "co_missing",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS both_null_count,
          round(count(*) FILTER ({a} IS NULL AND {b} IS NULL) / count(*), 4) AS pct FROM {GAPPY}"""
        for a, b in [("quantity", "discount"), ("quantity", "tax"), ("discount", "tax")]
    ),
)
def _(t):
    return an.co_missing(t.gappy)


@query(
    "missing_rows",
    f"""WITH m AS (SELECT (quantity IS NULL)::INT + (discount IS NULL)::INT + (tax IS NULL)::INT AS m FROM {GAPPY})
      SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS null_columns, count(*) FILTER (m >= 1.5) AS rows_mostly_null, count(*) FILTER (m = 3) AS rows_all_null FROM m""",
)
def _(t):
    return an.missing_rows(t.gappy, ["quantity", "discount", "tax"])


# Finding-like sentences are derived from the tables, with whole documents besides.
_SENTENCES = """(SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'e' || event_id, event_type || ' took ' || value || '% of ' || user_id || ' units compared to ' || (user_id % 7) || ' before, with r=0.' || (event_id % 90 + 10) || ' overall' FROM
    (SELECT event_id, event_type, user_id, CAST(floor(value) AS BIGINT) AS value FROM events))"""


def _sentences(t):
    e = t.events
    value = F.floor("value").cast("string")
    words = F.concat(
        F.col("event_type"), F.lit(" took "), value, F.lit("% of "), F.col("user_id").cast("string"), F.lit(" units compared to "),
        (F.col("user_id") % 7).cast("string"), F.lit(" before, with r=0."), (F.col("event_id") % 90 + 10).cast("string"), F.lit(" overall"),
    )
    made = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), words.alias("text"))
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(made)


# DuckDB takes the case as an option.
_PCT, _CMP, _RV = fi.PERCENT, fi.COMPARISON.removeprefix("(?i)"), fi.R_VALUE.removeprefix("(?i)")


@query(
    "extract_metrics",
    f"""WITH s AS (SELECT * FROM {_SENTENCES}),
      p AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '{_PCT}', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0.1 AND x <= 100) AS v FROM s),
      r AS (SELECT id, list_filter(list_transform(regexp_extract_all(text, '{_RV}', 1, 'i'), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0 AND x <= 1) AS v FROM s),
      c AS (SELECT id, regexp_extract_all(text, '{_CMP}', 1, 'i') AS a, regexp_extract_all(text, '{_CMP}', 3, 'i') AS b FROM s)
      SELECT id AS text_id, 'percentage' AS kind, CAST(i AS INT) AS ordinal, round(v[i], 4) AS value, CAST(NULL AS DOUBLE) AS value_b FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM p)
      UNION ALL SELECT id, 'correlation', CAST(i AS INT), round(v[i], 4), NULL FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM r)
      UNION ALL SELECT id, 'comparison', CAST(i AS INT), round(CAST(a[i] AS DOUBLE), 4), round(CAST(b[i] AS DOUBLE), 4) FROM (SELECT id, a, b, unnest(range(1, len(a) + 1)) AS i FROM c)""",
)
def _(t):
    return fi.extract_metrics(_sentences(t), "id", "text").drop("context")


@query(
    "classify_findings",
    f"""SELECT id AS text_id, CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, '{_RV}', 1, 'i'), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0 AND x <= 1)) > 0 THEN 'correlation'
      WHEN regexp_matches(text, '{_CMP}', 'i') THEN 'comparison'
      WHEN len(list_filter(list_transform(regexp_extract_all(text, '{_PCT}', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 0.1 AND x <= 100)) > 0 THEN 'percentage'
      WHEN contains(lower(text), 'correlat') OR contains(lower(text), 'r=') THEN 'correlation' ELSE 'text' END AS chart_type FROM {_SENTENCES}""",
)
def _(t):
    return fi.classify_findings(_sentences(t), "id", "text")
