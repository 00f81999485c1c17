"""Written cells and dates, large keys, whole results, and forests and cycles that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import anomaly as an
from tablescout.operators import candidates as ca
from tablescout.operators import exploratory as ex
from tablescout.operators import findings as fi
from tablescout.operators import foundation as fo
from tablescout.operators import ranking as rk
from tablescout.operators import structure as st
from tablescout.operators import timeseries as ts
from tablescout.operators.sampling import representative_rows
from tablescout.plans.sequence import calendar_series, row_series
from tablescout.sources.tables import parse_csv, with_time
from verification.registry import query
from verification.timeseries import _CYCLE, DAYS, SERIES, USERS


@query(
    "scan_csv",
    """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name || ' "' || p_brand || '", ' || p_type END AS name,
      CASE WHEN p_size % 5 <> 0 THEN p_size END AS size, CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice, 4) END AS price FROM part""",
)
def _(t):
    size = F.col("p_size")
    cell = F.concat(F.lit('"'), F.col("p_name"), F.lit(' ""'), F.col("p_brand"), F.lit('"", '), F.col("p_type"), F.lit('"'))
    line = F.concat_ws(
        ",",
        F.col("p_partkey").cast("string"),
        F.when(size % 7 != 0, cell).otherwise("N/A"),
        F.when(size % 5 != 0, size.cast("string")).otherwise("NULL"),
        F.when(size % 3 != 0, F.col("p_retailprice").cast("string")).otherwise("nan"),
    )
    return parse_csv(t.part.select(line.alias("line")), "line", "p_partkey long, name string, size int, price double")


_ISO = """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 250 MILLISECOND - CASE o_orderstatus WHEN 'F' THEN INTERVAL 120 MINUTE
  WHEN 'O' THEN INTERVAL 0 MINUTE ELSE INTERVAL (-330) MINUTE END, '%Y-%m-%d %H:%M:%S.%g') AS day FROM orders WHERE o_orderpriority <> '5-LOW'"""


@query("coerce_iso_times", _ISO)
def _(t):
    zone = F.when(F.col("o_orderstatus") == "F", "+02:00").when(F.col("o_orderstatus") == "O", "Z").otherwise("-0530")
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250"), zone)
    written = F.when(F.col("o_orderpriority") == "5-LOW", "not a time").otherwise(written)
    return with_time(t.orders.withColumn("day", written), "day").select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm:ss.SSS").alias("day"))


@query(
    "coerce_written_months",
    """SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') AS day FROM orders""",
)
def _(t):
    status = F.col("o_orderstatus")
    layout = lambda f: F.date_format("o_orderdate", f)
    written = F.when(status == "F", layout("MMMM d, yyyy")).when(status == "O", layout("d MMMM yyyy")).otherwise(layout("M/d/yyyy H:mm:ss"))
    days = t.orders.withColumn("o_orderdate", F.date_trunc("day", "o_orderdate"))
    return with_time(days.withColumn("day", written), "day").select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"))


_WIDE = """WITH c AS (SELECT event_type AS a, CAST(user_id AS VARCHAR) AS b, count(*) AS k FROM events GROUP BY 1, 2),
  ra AS (SELECT a, sum(k) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(k) AS n FROM c GROUP BY 1)
  SELECT 'event_type' AS col_a, ra.a AS val_a, 'user_id' AS col_b, rb.b AS val_b, CAST(coalesce(k, 0) AS BIGINT) AS cnt, round(coalesce(k, 0) / ra.n, 3) AS row_share
  FROM ra CROSS JOIN rb LEFT JOIN c ON c.a = ra.a AND c.b = rb.b"""


@query("crosstab_many_values", _WIDE)
def _(t):
    return ex.crosstab(t.events, [("event_type", "user_id")]).select("col_a", "val_a", "col_b", "val_b", "cnt", "row_share")


@query(
    "extract_metrics_whole_text",
    """WITH s AS (SELECT user_id, string_agg(event_type || ' took ' || CAST(floor(value) AS BIGINT) || '%', '. ' ORDER BY event_id) AS t FROM events GROUP BY 1),
      v AS (SELECT user_id, list_filter(regexp_extract_all(t, '(\\w+ took \\d+)%', 1), lambda x: CAST(string_split(x, ' ')[3] AS DOUBLE) BETWEEN 0.1 AND 100) AS f FROM s)
      SELECT user_id AS text_id, CAST(i AS INT) AS ordinal, CAST(string_split(f[i], ' ')[3] AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM v)""",
)
def _(t):
    told = F.concat("event_type", F.lit(" took "), F.floor("value").cast("string"), F.lit("%"))
    texts = t.events.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", told.alias("w")))), lambda x: x["w"]), ". ").alias("t")
    )
    return fi.extract_metrics(texts, "user_id", "t").where("kind = 'percentage'").select("text_id", "ordinal", "value")


@query(
    "extract_metrics_context",
    """SELECT event_id AS text_id, 'percentage' AS kind, event_type || ' took' AS context FROM events WHERE floor(value) BETWEEN 1 AND 100
      UNION ALL SELECT event_id, 'comparison', 'units' FROM events""",
)
def _(t):
    words = F.concat("event_type", F.lit(" took "), F.floor("value").cast("string"), F.lit("% of "), F.col("user_id").cast("string"), F.lit(" units compared to 7 before"))
    found = fi.extract_metrics(t.events.select("event_id", words.alias("t")), "event_id", "t")
    return found.where("kind <> 'correlation'").select("text_id", "kind", "context")


SHIFT = 1 << 60


@query(
    "profile_of_large_keys",
    f"""SELECT "column", count(v) AS n, count(DISTINCT v) AS unique_count FROM (SELECT 'key' AS "column", p_partkey + {SHIFT} AS v FROM part
      UNION ALL SELECT 'size', p_size FROM part) GROUP BY 1""",
)
def _(t):
    df = t.part.select((F.col("p_partkey") + F.lit(SHIFT)).alias("key"), F.col("p_size").alias("size"))
    return fo.numeric_profile(df, ["key", "size"]).select("column", "n", "unique_count")


@query(
    "percentile_rank_of_large_keys",
    "SELECT p_partkey, round(row_number() OVER (ORDER BY p_partkey) / count(*) OVER (), 4) AS pct_rank FROM part",
)
def _(t):
    df = t.part.select("p_partkey", (F.col("p_partkey") + F.lit(SHIFT)).alias("key"))
    return rk.with_percentile_rank(df, "key").select("p_partkey", "pct_rank")


_NUMBERS = {"p_size": "p_size", "p_retailprice": "p_retailprice", "lane": "(p_size * 7) % 11", "row": "p_partkey % 13"}
_LABELS = ["p_name", "p_brand", "p_type"]
_ENDS = " UNION ".join(
    f"SELECT arg_min(p_partkey, ({e}, p_partkey)) AS k FROM part UNION SELECT arg_min(p_partkey, (-({e}), p_partkey)) FROM part" for e in _NUMBERS.values()
)
_FIRST = " UNION ".join(
    f"SELECT k FROM (SELECT min(p_partkey) AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM part GROUP BY {c}) WHERE r <= 3" for c in _LABELS
)


@query(
    "representative_rows_large_keys",
    f"""WITH keys AS ({_ENDS} UNION {_FIRST} UNION SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part)
      WHERE p = (SELECT count(*) // 2 FROM part)) SELECT CAST(p_partkey + {SHIFT} AS VARCHAR) AS key, p_name FROM part WHERE p_partkey IN (SELECT k FROM keys)""",
)
def _(t):
    df = t.part.withColumns({"key": F.col("p_partkey") + F.lit(SHIFT), "lane": (F.col("p_size") * 7) % 11, "row": F.col("p_partkey") % 13})
    return representative_rows(df, "key", list(_NUMBERS), _LABELS, k=40).select("key", "p_name")


@query(
    "isolation_forest_invariants",
    """SELECT count(*) AS n, true AS at_most_a_twentieth, true AS some, true AS same_in_other_partitions, true AS scores_in_range FROM lineitem""",
)
def _(t):
    """The forest is the same however the rows are dealt, and flags at most the share asked for."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = t.lineitem
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("anomaly_score", 9))
    facts = []
    for i, frame in enumerate((df, df.repartition("l_partkey"))):
        scored = an.isolation_forest(frame, cols)
        facts.append(
            scored.agg(
                F.count("*").alias(f"n{i}"),
                F.count_if("is_anomaly").alias(f"k{i}"),
                F.sum(F.when(F.col("is_anomaly"), F.shiftright(key, 24))).alias(f"h{i}"),
                F.min("anomaly_score").alias(f"a{i}"),
                F.max("anomaly_score").alias(f"b{i}"),
            )
        )
    both = facts[0].crossJoin(F.broadcast(facts[1]))
    return both.select(
        F.col("n0").alias("n"),
        (F.col("k0") <= F.col("n0") * 0.05).alias("at_most_a_twentieth"),
        (F.col("k0") > 0).alias("some"),
        ((F.col("k0") == F.col("k1")) & (F.col("h0") == F.col("h1"))).alias("same_in_other_partitions"),
        ((F.col("a0") > 0) & (F.col("b0") < 1)).alias("scores_in_range"),
    )


_EVENT_ROWS = """s AS (SELECT 'value' AS metric, row_number() OVER (ORDER BY ts, event_id, value) - 1 AS idx, count(*) OVER () AS n, value FROM events)"""


@query("cycles_rows_events", f"WITH {_EVENT_ROWS} {_CYCLE}")
def _(t):
    return ts.long_cycles(row_series(t.events, "ts", ["value"], ["event_id"]))


@query(
    "candidates_orders",
    """WITH u AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, count(DISTINCT o_totalprice) AS p, count(DISTINCT o_custkey) AS c FROM orders)
      SELECT 'question' AS kind, 'What does each row represent?' AS label, CAST(0.85 AS DOUBLE) AS confidence FROM u WHERE k / n > 0.95
      UNION ALL SELECT 'technique', 'Cohort & retention analysis', 0.8 FROM u WHERE k / n > 0.95
      UNION ALL SELECT 'technique', 'Segment analysis', 0.85 FROM u WHERE c / n <= 0.95
      UNION ALL SELECT 'technique', 'Aggregation & grouping analysis', 0.8 FROM u WHERE 6 / n <= 0.5
      UNION ALL SELECT 'question', 'Does ''o_totalprice'' ever repeat intentionally?', 0.75 FROM u WHERE p < n AND p / n > 0.95""",
)
def _(t):
    roles = fo.infer_roles(t.orders)
    parts = [
        ca.from_entity_type(st.entity_type(roles)),
        ca.from_column_roles(st.column_roles(roles)),
        ca.from_shape(st.dataset_shape(t.orders)),
        ca.from_id_columns(st.id_columns(roles)),
    ]
    return ca.pool(parts).select("kind", "label", "confidence")


def t_tail_sql(source: str, keep: str) -> str:
    """Two-sided tail of the t law with n - 2 degrees of freedom for a correlation, by its finite sums.

    ``source`` has the columns of ``keep``, n and r. With the angle a, tan(a) = t / sqrt(v), the probability inside is
    sin(a) times a sum of cos(a) ** 2k for even v, and 2 / pi (a + sin(a) cos(a) times another) for odd v.
    """
    return f"""WITH f AS ({source}), a AS (SELECT *, n - 2 AS v, atan(abs(r) / sqrt(1 - r * r)) AS a FROM f),
      k AS (SELECT *, unnest(range(0, CASE WHEN v % 2 = 0 THEN v // 2 ELSE greatest((v - 1) // 2, 1) END)) AS k FROM a),
      s AS (SELECT {keep}, v, a, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5 * ln(pi()) + 2 * k * ln(cos(a)))
        WHEN v > 1 THEN exp(lgamma(k + 1.0) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + 2 * k * ln(cos(a))) ELSE 0 END) AS t FROM k GROUP BY ALL)
      SELECT {keep}, round(1 - CASE WHEN v % 2 = 0 THEN sin(a) * t ELSE 2 / pi() * (a + sin(a) * cos(a) * t) END, 4) AS p_value FROM s"""


@query("trend_p_values_daily", t_tail_sql(f"WITH {DAYS} SELECT metric, count(*) AS n, corr(value, pos) AS r FROM s GROUP BY 1", "metric"))
def _(t):
    return ts.trend(calendar_series(t.lineitem, "l_shipdate", SERIES)).select("metric", "p_value")


@query(
    "trend_p_values_by_user",
    t_tail_sql(f"WITH {USERS} SELECT user_id, count(*) AS n, corr(value, pos) AS r FROM s GROUP BY 1 HAVING count(*) >= 4", "user_id"),
)
def _(t):
    return ts.trend(calendar_series(t.events, "ts", ["value"], keys=["user_id"]), ["user_id"]).select("user_id", "p_value")


@query(
    "regression_p_values",
    t_tail_sql(
        """SELECT 'p_size' AS col_a, 'p_retailprice' AS col_b, count(*) AS n, corr(p_size, p_retailprice) AS r FROM part
        UNION ALL SELECT 'p_partkey', 'p_size', count(*), corr(p_partkey, p_size) FROM part""",
        "col_a, col_b",
    ),
)
def _(t):
    pairs = [("p_size", "p_retailprice"), ("p_partkey", "p_size")]
    return ex.pairwise_regression(t.part, pairs).select("col_a", "col_b", "p_value")
