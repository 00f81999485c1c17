"""Threshold findings over operator results, and figures read back out of finding texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import union_all


@dataclass(frozen=True)
class Rule:
    """Rows passing ``when`` become findings about ``subject``, ordered by ``rank``, at most ``top`` of them."""

    when: str
    subject: str
    metric: str
    text: str
    rank: str = "1"
    top: int | None = None


# The thresholds above which a result is worth telling.
RULES: dict[str, list[Rule]] = {
    "field_profile": [
        Rule("null_rate > 0.1 and kind = 'numeric'", "column", "null_rate", "format_string('%s: %.1f%% missing', column, null_rate * 100)"),
        Rule("abs(cv) > 1.5", "column", "cv", "format_string('%s varies strongly (cv %.2f)', column, cv)"),
        Rule("unique_count = 1 and kind = 'categorical'", "column", "1.0", "format_string('%s holds one value only', column)"),
    ],
    "data_quality": [
        Rule("overall_null_rate > 0.05", "'table'", "overall_null_rate", "format_string('%.1f%% of all cells are null', overall_null_rate * 100)"),
        Rule("high_null_columns > 0", "'table'", "high_null_columns", "format_string('%d columns are over 20%% null', high_null_columns)"),
        Rule("duplicate_rate > 0.01", "'table'", "duplicate_rate", "format_string('%d rows are copies (%.1f%%)', duplicate_count, duplicate_rate * 100)"),
        Rule("case_issue_columns > 0", "'table'", "case_issue_columns", "format_string('%d columns mix letter cases', case_issue_columns)"),
    ],
    "distribution": [Rule("abs(skewness) > 1.5", "column", "skewness", "format_string('%s is strongly %s (skewness %.2f)', column, shape, skewness)")],
    "outliers": [Rule("iqr_outlier_count > 0", "column", "iqr_outlier_pct", "format_string('%s: %d values (%.1f%%) outside [%.2f, %.2f]', column, iqr_outlier_count, iqr_outlier_pct * 100, lower_fence, upper_fence)")],
    "normality": [
        Rule("p_value < 0.001", "column", "p_value", "format_string('%s is not normal (p %.4f)', column, p_value)"),
        Rule("is_normal", "column", "p_value", "format_string('%s passes as normal (p %.4f)', column, p_value)"),
    ],
    "correlation": [Rule("true", "concat(col_a, ' ~ ', col_b)", "pearson", "format_string('%s and %s: %s %s correlation (r %.2f)', col_a, col_b, if(abs(pearson) > 0.7, 'strong', 'moderate'), if(pearson > 0, 'positive', 'negative'), pearson)", "-abs(pearson)", 5)],
    "pairwise_regression": [Rule("p_value < 0.01 and r2 > 0.1", "concat(col_a, ' ~ ', col_b)", "r2", "format_string('%s explains %.1f%% of the variance of %s', col_a, r2 * 100, col_b)")],
    "vif": [Rule("vif > 5", "column", "vif", "format_string('%s is nearly a combination of the other columns (VIF %.1f)', column, vif)", "-vif", 5)],
    "partial_correlation": [Rule("true", "concat(col_a, ' ~ ', col_b)", "partial_r", "format_string('%s and %s: partial correlation %.2f', col_a, col_b, partial_r)", "-abs(partial_r)", 4)],
    "frequency_summary": [
        Rule("top_value_share > 0.8", "column", "top_value_share", "format_string('%s: one value fills %.1f%%', column, top_value_share * 100)"),
        Rule("long_tail_count > 5", "column", "long_tail_count", "format_string('%s has %d rare values', column, long_tail_count)"),
    ],
    "cardinality": [
        Rule("label = 'near-unique'", "column", "cardinality_ratio", "format_string('%s is near-unique (%d values)', column, unique_count)"),
        Rule("label = 'high'", "column", "cardinality_ratio", "format_string('%s has many values (%d)', column, unique_count)"),
    ],
    "crosstab_summary": [Rule("max_deviation > 0.2", "concat(col_a, ' ~ ', col_b)", "max_deviation", "format_string('%s shifts the shares of %s by up to %.2f', col_a, col_b, max_deviation)")],
    "segment_spread": [Rule("relative_spread > 0.3", "metric_col", "relative_spread", "format_string('%s differs by %s: %s highest, %s lowest (%.0f%% of the mean)', metric_col, segment_col, top_group, bottom_group, relative_spread * 100)")],
    "interaction_spread": [Rule("spread > 0.3", "concat(col_a, ' ~ ', col_b)", "spread", "format_string('correlation of %s and %s depends on %s (spread %.2f)', col_a, col_b, segment_col, spread)")],
    "levene": [Rule("not equal_variance", "metric_col", "p_value", "format_string('%s: variances differ between groups (p %.4f)', metric_col, p_value)")],
    "anova": [Rule("significant", "metric_col", "p_value", "format_string('%s: means differ between groups (F %.2f, p %.4f)', metric_col, f_statistic, p_value)")],
    "chi_square": [Rule("significant and cramers_v > 0.1", "concat(col_a, ' ~ ', col_b)", "cramers_v", "format_string('%s and %s are dependent (V %.2f, p %.4f)', col_a, col_b, cramers_v, p_value)")],
    "trend": [Rule("p_value < 0.05 and abs(total_pct_change) > 5", "metric", "total_pct_change", "format_string('%s trends %s (%+.1f%% in all)', metric, direction, total_pct_change)")],
    "growth_rate": [Rule("abs(total_pct_change) > 10", "metric", "total_pct_change", "format_string('%s changed by %+.1f%%', metric, total_pct_change)")],
    "rolling_volatility": [Rule("vol_ratio > 2", "metric", "vol_ratio", "format_string('%s: volatility varies %.1f-fold', metric, vol_ratio)")],
    "peaks_valleys": [Rule("swing_pct > 30", "metric", "swing_pct", "format_string('%s swings by %.0f%% of its mean', metric, swing_pct)")],
    "stationarity": [Rule("not likely_stationary", "metric", "mean_shift_ratio", "format_string('%s looks non-stationary (mean shift %.2f)', metric, mean_shift_ratio)")],
    "seasonality": [Rule("monthly_cv > 0.1", "metric", "monthly_cv", "format_string('%s is seasonal: peak month %d, trough month %d', metric, peak_month, trough_month)")],
    "changepoints": [Rule("true", "metric", "pct_shift", "format_string('%s shifts on %s: mean %.2f before, %.2f after', metric, date_format(cp_date, 'yyyy-MM-dd'), before_mean, after_mean)", "cp_index")],
    "lag_correlation": [Rule("true", "concat(col_a, ' ~ ', col_b)", "r", "format_string('%s leads %s by %d steps (r %.2f)', leader, col_a, best_lag, r)")],
    "cycles": [Rule("dominant_period >= 2 and dominant_period <= n div 2", "metric", "dominant_period", "format_string('%s repeats about every %d steps', metric, dominant_period)")],
    "forecast_baseline": [Rule("best_method is not null", "metric", "next_period_forecast", "format_string('%s: best baseline is %s, next value about %.2f', metric, best_method, next_period_forecast)")],
    "category_drift": [Rule("true", "concat(column, ' = ', category)", "delta", "format_string('%s = %s went from %.1f%% to %.1f%%', column, category, early_share * 100, late_share * 100)", "-abs(delta)")],
    "composite_score": [Rule("n > 0", "'table'", "p90_threshold", "format_string('composite score: top tenth starts at %.2f (%d rows)', p90_threshold, top_10pct_count)")],
    "percentile_ranking": [Rule("true", "column", "p90_threshold", "format_string('%s: top tenth from %.2f, bottom tenth to %.2f', column, p90_threshold, p10_threshold)")],
    "top_bottom": [Rule("abs(ratio - 1) > 0.3", "concat(by_col, ' ~ ', other_col)", "ratio", "format_string('top tenth by %s has %.2f times the %s of the bottom tenth', by_col, ratio, other_col)")],
    "tiers": [Rule("true", "column", "high_threshold", "format_string('%s: low below %.2f, high from %.2f', column, low_threshold, high_threshold)")],
    "winners_losers": [Rule("verdict <> 'neutral'", "metric", "total_pct_change", "format_string('%s: %s (%+.1f%%)', verdict, metric, total_pct_change)", "rank")],
    "pareto": [Rule("top_20pct_share > 0.6", "column", "top_20pct_share", "format_string('%s: a fifth of the rows holds %.1f%%', column, top_20pct_share * 100)")],
    "concentration": [Rule("hhi > 0.15", "column", "hhi", "format_string('%s is %s (HHI %.4f)', column, hhi_label, hhi)")],
    "cohorts": [Rule("true", "cohort", "cnt", "format_string('largest cohort: %s with %d rows', cohort, cnt)", "-cnt", 1)],
    "retention": [Rule("true", "cohort", "retention_rate", "format_string('final cohort %s: %.1f%% of the largest', cohort, retention_rate * 100)", "-int(replace(cohort, '-', ''))", 1)],
    "ltv": [Rule("true", "'table'", "ltv_estimate", "format_string('value over %d periods: %.2f', periods_used, ltv_estimate)")],
    "funnel": [Rule("drop_off > 0.3", "stage", "drop_off", "format_string('%s loses %.1f%%', stage, drop_off * 100)", "-cnt")],
    "decompose": [Rule("true", "'table'", "delta_metric", "format_string('change %+.2f: volume %+.2f, rate %+.2f, %s', delta_metric, volume_effect, rate_effect, dominant)")],
    "benchmark": [
        Rule("above_2std_count > 0", "column", "above_2std_count", "format_string('%s: %d values two deviations above the mean', column, above_2std_count)"),
        Rule("below_2std_count > 0", "column", "below_2std_count", "format_string('%s: %d values two deviations below the mean', column, below_2std_count)"),
    ],
    "pattern_counts": [Rule("match_count > 0", "column", "match_pct", "format_string('%s: %d values hold a %s (%.1f%%)', column, match_count, pattern, match_pct * 100)")],
    "near_duplicate_values": [Rule("true", "column", "similarity", "format_string('%s: %s and %s may be the same', column, value_a, value_b)", "-similarity", 6)],
    "co_occurrence": [Rule("true", "concat(col_a, ' ~ ', col_b)", "pct", "format_string('%s = %s with %s = %s in %.1f%% of rows', col_a, val_a, col_b, val_b, pct * 100)", "-cnt", 8)],
    "anomaly_score": [Rule("true", "'table'", "anomaly_rate", "format_string('%d unusual rows (%.1f%%) by %s', anomaly_count, anomaly_rate * 100, method)")],
    "duplicates": [
        Rule("exact_duplicate_count > 0", "'table'", "exact_duplicate_rate", "format_string('%d exact copies (%.1f%%)', exact_duplicate_count, exact_duplicate_rate * 100)"),
        Rule("near_duplicate_count > exact_duplicate_count", "'table'", "near_duplicate_rate", "format_string('%d near copies (%.1f%%)', near_duplicate_count, near_duplicate_rate * 100)"),
    ],
    "co_missing": [Rule("pct > 0.05", "concat(col_a, ' ~ ', col_b)", "pct", "format_string('%s and %s are missing together in %.1f%% of rows', col_a, col_b, pct * 100)")],
    "missing_rows": [Rule("rows_mostly_null > 0", "'table'", "rows_mostly_null", "format_string('%d rows are at least half null', rows_mostly_null)")],
}

SCHEMA = "operator string, rank int, subject string, metric double, finding string"


def findings_of(operator: str, result: DataFrame) -> DataFrame:
    """``operator, rank, subject, metric, finding``; one neutral row when nothing passes a threshold.

    Results have a row per column, pair, group or month, so ordering them is small work.
    """
    parts = []
    for i, rule in enumerate(RULES.get(operator, [])):
        rows = result.where(F.expr(rule.when)).select(
            F.lit(i).alias("_i"),
            F.expr(rule.rank).cast("double").alias("_o"),
            F.expr(rule.subject).alias("subject"),
            F.expr(rule.metric).cast("double").alias("metric"),
            F.expr(rule.text).alias("finding"),
        )
        parts.append(rows.orderBy("_o", "subject").limit(rule.top) if rule.top else rows)
    spark = result.sparkSession
    neutral = spark.createDataFrame([(operator, 1, "table", None, "nothing stands out")], SCHEMA)
    if not parts:
        return neutral
    found = union_all(parts)
    ranked = found.select(
        F.lit(operator).alias("operator"),
        F.row_number().over(Window.orderBy("_i", "_o", "subject", "finding")).alias("rank"),
        "subject",
        "metric",
        "finding",
    )
    empty = found.agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == 0).drop("_k")
    return ranked.unionByName(neutral.crossJoin(F.broadcast(empty)))


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` findings of each operator."""
    order = Window.partitionBy("operator").orderBy("rank", "finding")
    return findings.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


# How figures are written in finding texts.
PERCENT = r"(\d+(?:\.\d+)?)\s*%"
COMPARISON = r"(?i)(\d+(?:\.\d+)?)\s+([\w\s]{0,40}?)(?:compared to|versus|vs\.?)\s+(\d+(?:\.\d+)?)"
R_VALUE = r"(?i)r(?:[=\s\-](?:value)?(?:\s+of)?(?:\s*[:=])?\s*)(\d+(?:\.\d+)?)"


# How many figures of a kind a finding shows.
SHOWN = {"percentage": 6, "comparison": 3, "correlation": 5}


def _matches(text: Column, pattern: str) -> Column:
    """Array of ``at (s, e), v`` for each match: zero-based offsets and the number. The text is searched twice, for the
    matches and for what lies between; the number is then read from the match, which is short."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})" if "(?i)" not in pattern else f"(?i)({pattern[4:]})"), F.lit(1))
    zipped = F.arrays_zip(whole.alias("w"), F.split(text, pattern).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:struct<s:int,e:int>,v:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.coalesce(F.length(x["b"]), F.lit(0))
        end = begin + F.length(x["w"])
        number = F.regexp_extract(x["w"], pattern, 1).cast("double")
        found = F.struct(F.struct(begin.alias("s"), end.alias("e")).alias("at"), number.alias("v"))
        # Behind the last match there is text and no match.
        return F.when(x["w"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], found).alias("out")))

    return F.aggregate(zipped, start, step)["out"]


def extract_metrics(texts: DataFrame, text_id: str, text: str, most: dict[str, int] | None = None) -> DataFrame:
    """``text_id, kind, ordinal, value, value_b, context`` of figures in each whole text.

    Percentages from 0.1 to 100, pairs compared with each other, correlations from 0 to 1, in the order of the text;
    all of them, or the first ``most`` of a kind, as ``SHOWN`` has them for a display.
    """
    first = lambda found, kind: F.slice(found, 1, most[kind]) if most and kind in most else found
    t = F.coalesce(F.col("_t"), F.lit(""))
    base = texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    before = lambda m: F.trim(F.regexp_replace(F.substring(t, F.greatest(m["at"]["s"] - 50, F.lit(0)) + 1, F.least(m["at"]["s"], F.lit(50))), r"\s+", " "))
    words = lambda m: F.split(before(m), " ")
    last_four = lambda m: F.array_join(F.slice(words(m), F.greatest(F.size(words(m)) - 3, F.lit(1)), 4), " ")
    percents = first(F.filter(_matches(t, PERCENT), lambda m: (m["v"] >= 0.1) & (m["v"] <= 100)), "percentage")
    percents = F.transform(
        percents,
        lambda m: F.struct(
            m["v"].alias("value"),
            F.lit(None).cast("double").alias("value_b"),
            F.when(F.length(before(m)) > 0, last_four(m)).otherwise(F.concat(m["v"].cast("string"), F.lit("%"))).alias("context"),
        ),
    )
    rs = first(F.filter(_matches(t, R_VALUE), lambda m: (m["v"] >= 0) & (m["v"] <= 1)), "correlation")
    rs = F.transform(
        rs,
        lambda m: F.struct(
            m["v"].alias("value"),
            F.lit(None).cast("double").alias("value_b"),
            F.left(
                F.trim(F.substring(t, F.greatest(m["at"]["s"] - 30, F.lit(0)) + 1, m["at"]["e"] + 30 - F.greatest(m["at"]["s"] - 30, F.lit(0)))),
                F.lit(40),
            ).alias("context"),
        ),
    )
    # The text is searched for whole matches only; their parts are read from the match, which holds them in the same places.
    part = lambda m, i: F.regexp_extract(m, COMPARISON, i)
    pairs = F.transform(
        first(F.regexp_extract_all(t, F.lit(COMPARISON), F.lit(0)), "comparison"),
        lambda m: F.struct(
            part(m, 1).cast("double").alias("value"),
            part(m, 3).cast("double").alias("value_b"),
            F.when(F.length(F.trim(part(m, 2))) > 0, F.left(F.trim(part(m, 2)), F.lit(24))).otherwise(F.lit("Group A")).alias("context"),
        ),
    )
    groups = F.array(
        F.struct(F.lit("percentage").alias("kind"), percents.alias("found")),
        F.struct(F.lit("comparison").alias("kind"), pairs.alias("found")),
        F.struct(F.lit("correlation").alias("kind"), rs.alias("found")),
    )
    return (
        base.select("text_id", F.inline(groups))
        .select("text_id", "kind", F.posexplode("found").alias("_p", "_f"))
        .select("text_id", "kind", (F.col("_p") + 1).alias("ordinal"), "_f.value", "_f.value_b", "_f.context")
    )


def classify_findings(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``text_id, chart_type``: correlation, comparison, percentage or text, by the first kind of figure present."""
    t = F.coalesce(F.col(text), F.lit(""))
    numbers = lambda pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: v.cast("double"))
    kind = (
        F.when(F.exists(numbers(R_VALUE), lambda v: (v >= 0) & (v <= 1)), "correlation")
        .when(t.rlike(COMPARISON), "comparison")
        .when(F.exists(numbers(PERCENT), lambda v: (v >= 0.1) & (v <= 100)), "percentage")
        .when(F.contains(F.lower(t), F.lit("correlat")) | F.contains(F.lower(t), F.lit("r=")), "correlation")
        .otherwise("text")
    )
    return texts.select(F.col(text_id).alias("text_id"), kind.alias("chart_type"))
