"""Scan, role, profile and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import foundation as op
from tablescout.operators.sampling import representative_rows
from tablescout.sources.tables import with_time
from verification.registry import GAPPY, long_sql, query, text_sql


@query(
    "scan_events",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, round(value, 4) AS value, props FROM events""",
)
def _(t):
    return t.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "coerce_time",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS cnt FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def _(t):
    date = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown")
        .when(F.col("o_orderstatus") == "F", F.date_format(date, "M/d/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format(date, "MMM d, yyyy"))
        .otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    )
    return with_time(t.orders.withColumn("day", written), "day").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def _roles_sql(table: str, columns: dict[str, str], strict: bool = False) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        id_name = any(p in c for p in ("id", "uuid", "key", "code", "ref", "sku"))
        if kind == "time":
            role = "'datetime'"
        elif kind == "measure" and strict:
            role = "'numeric'"
        elif kind in ("number", "measure"):
            role = f"CASE WHEN count(DISTINCT {c}) / count(*) > 0.95 AND count(DISTINCT {c}) > 50 THEN 'id_col' ELSE 'numeric' END"
        else:
            near = f"WHEN count(DISTINCT {c}) / count(*) > 0.9 THEN 'id_col'" if id_name else ""
            role = f"""CASE WHEN avg(CASE WHEN TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0 END) > 0.8 THEN 'datetime'
              WHEN count(DISTINCT {c}) / count(*) > 0.5 AND avg(length({c})) > 30 THEN 'text' {near} ELSE 'categorical' END"""
        parts.append(
            f"""SELECT '{c}' AS "column", {i} AS ordinal, {role} AS role, count(*) AS n_rows,
            count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM {table}"""
        )
    return " UNION ALL ".join(parts)


LINE = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
    "l_quantity": "measure", "l_extendedprice": "measure", "l_discount": "measure", "l_tax": "measure",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time",
}
ORDERS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "measure",
    "o_orderdate": "time", "o_orderpriority": "string",
}
EVENTS = {
    "event_id": "number", "ts": "time", "user_id": "number", "event_type": "string", "value": "measure", "props": "string",
}
DOCUMENTS = {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number"}

_ROLE_COLUMNS = ["column", "ordinal", "role", "n_rows", "null_count", "unique_count"]


@query("infer_roles_lineitem", _roles_sql("lineitem", LINE))
def _(t):
    return op.infer_roles(t.lineitem).select(*_ROLE_COLUMNS)


@query("infer_roles_strict", _roles_sql("lineitem", LINE, strict=True))
def _(t):
    return op.infer_roles(t.lineitem, mode="strict").select(*_ROLE_COLUMNS)


@query("infer_roles_events", _roles_sql("events", EVENTS))
def _(t):
    return op.infer_roles(t.events).select(*_ROLE_COLUMNS)


@query("infer_roles_documents", _roles_sql("documents", DOCUMENTS))
def _(t):
    return op.infer_roles(t.documents).select(*_ROLE_COLUMNS)


@query(
    "role_samples_orders",
    """SELECT "column", string_agg(v, '|' ORDER BY v) AS samples FROM (
      SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r FROM (SELECT DISTINCT * FROM """
    + text_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    + """)) WHERE r <= 5 GROUP BY 1""",
)
def _(t):
    return op.infer_roles(t.orders, samples=True).select("column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "field_profile_numeric",
    f"""SELECT "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max,
      round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75,
      round(1 - count(v) / count(*), 4) AS null_rate, count(DISTINCT v) AS unique_count, round(max(v) - min(v), 4) AS range,
      round(stddev_samp(v) / avg(v), 4) AS cv
      FROM {long_sql(GAPPY, ["quantity", "l_extendedprice", "discount", "tax"])} GROUP BY 1""",
)
def _(t):
    return op.numeric_profile(t.gappy, ["quantity", "l_extendedprice", "discount", "tax"])


@query(
    "field_profile_categorical",
    f"""WITH c AS (SELECT "column", v, count(*) AS k FROM {text_sql("orders", ["o_orderstatus", "o_orderpriority"])} WHERE v IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k DESC, v) AS r FROM c)
      SELECT "column", CAST(sum(k) AS BIGINT) AS n, max(CASE WHEN r = 1 THEN v END) AS top_value, round(max(k) / sum(k), 4) AS top_freq,
      count(*) AS unique_count, round(1 - sum(k) / (SELECT count(*) FROM orders), 4) AS null_rate FROM b GROUP BY 1""",
)
def _(t):
    return op.categorical_profile(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "data_quality",
    f"""WITH g AS (SELECT * FROM {GAPPY}), r AS (SELECT count(*) AS n,
        (1 - count(quantity) / count(*)) AS a, (1 - count(discount) / count(*)) AS b, (1 - count(tax) / count(*)) AS c FROM g)
      SELECT round((a + b + c) / 10, 4) AS overall_null_rate, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS columns_with_nulls,
      CAST((a > 0.2)::INT + (b > 0.2)::INT + (c > 0.2)::INT AS BIGINT) AS high_null_columns, n AS row_count, CAST(10 AS BIGINT) AS col_count,
      n - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS duplicate_count,
      round((n - (SELECT count(*) FROM (SELECT DISTINCT * FROM g))) / n, 4) AS duplicate_rate, CAST(0 AS BIGINT) AS case_issue_columns FROM r""",
)
def _(t):
    return op.data_quality(t.gappy, ["l_returnflag"])


@query(
    "case_issues",
    """SELECT 'name' AS "column", count(DISTINCT name) AS raw_values, count(DISTINCT lower(name)) AS folded_values FROM (
      SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name FROM part) HAVING count(DISTINCT lower(name)) < count(DISTINCT name)""",
)
def _(t):
    mixed = t.part.select(F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), "p_brand")
    return op.case_issues(mixed, ["name", "p_brand"])


@query(
    "quality_gate",
    """SELECT 'l_tax' AS "column", CAST(2 AS INT) AS ordinal, round(avg(CASE WHEN l_tax < 0.075 THEN 1.0 ELSE 0 END), 4) AS null_rate FROM lineitem
      HAVING avg(CASE WHEN l_tax < 0.075 THEN 1.0 ELSE 0 END) > 0.85""",
)
def _(t):
    return op.quality_gate(t.lineitem.select("l_orderkey", "l_quantity", F.when(F.col("l_tax") >= 0.075, F.col("l_tax")).alias("l_tax")))


@query(
    "dataset_summary",
    f"""SELECT r.*, p.mean, (SELECT count(*) FROM events) AS row_count, CAST(6 AS BIGINT) AS col_count FROM ({_roles_sql("events", EVENTS)}) r
      LEFT JOIN (SELECT "column", round(avg(v), 4) AS mean FROM {long_sql("events", ["user_id", "value"])} GROUP BY 1) p ON r."column" = p."column" """,
)
def _(t):
    events = t.events
    summary = op.dataset_summary(events, op.infer_roles(events), ["user_id", "value"], ["event_type", "props"])
    return summary.select(*_ROLE_COLUMNS, "mean", "row_count", "col_count")


@query(
    "representative_rows",
    """WITH keys AS (
      SELECT arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS k FROM orders UNION SELECT arg_min(o_orderkey, (-o_totalprice, o_orderkey)) FROM orders
      UNION SELECT arg_min(o_orderkey, (o_custkey, o_orderkey)) FROM orders UNION SELECT arg_min(o_orderkey, (-o_custkey, o_orderkey)) FROM orders
      UNION SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p = (SELECT count(*) // 2 FROM orders)
      UNION SELECT k FROM (SELECT min(o_orderkey) AS k, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY o_orderstatus) WHERE r <= 3
      UNION SELECT k FROM (SELECT min(o_orderkey) AS k, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_orderpriority) WHERE r <= 3)
      SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority
      FROM orders WHERE o_orderkey IN (SELECT k FROM keys ORDER BY k LIMIT 8)""",
)
def _(t):
    rows = representative_rows(t.orders, "o_orderkey", ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
