"""Suggested questions and techniques: one row each, made by rules over screen results.

Columns: ``kind, source, source_order, label, description, confidence``. Labels and confidences are
fixed values; equal labels from different sources merge, keeping the most confident.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import union_all
from tablescout.plans.counts import category_counts

# Words that mark a control group or a target column.
CONTROL_KEYWORDS = (
    "control", "baseline", "benchmark", "reference", "standard",
    "default", "organic", "untreated", "before", "pre",
)
TARGET_KEYWORDS = ("target", "goal", "budget", "plan", "forecast", "expected")

WORDS_PER_ARRAY = 200
BROADCAST_WORDS = 10_000

SCHEMA = "kind string, source string, source_order int, label string, description string, confidence double"

# The order in which sources are pooled, which settles equal confidences.
SOURCES = (
    "entity_type", "target_candidates", "column_roles", "dataset_shape", "join_keys", "boolean_disguise", "id_columns",
    "null_intent", "outlier_prevalence", "correlation_opportunity", "segment_variables", "temporal_coverage",
    "concentration_screen", "growth_signal", "anomaly_prevalence", "cardinality_screen",
    "analysis_hypotheses", "missing_analyses", "composite_opportunity", "benchmark_opportunity",
)


def _rule(rows: DataFrame, source: str, kind: str, label, text, confidence: float, when=None) -> DataFrame:
    rows = rows if when is None else rows.where(when)
    label = F.lit(label) if isinstance(label, str) else label
    text = F.lit(text) if isinstance(text, str) else text
    return rows.select(
        F.lit(kind).alias("kind"),
        F.lit(source).alias("source"),
        F.lit(SOURCES.index(source)).alias("source_order"),
        label.alias("label"),
        text.alias("description"),
        F.lit(confidence).alias("confidence"),
    )


def _best(rows: DataFrame, *order) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def _names(rows: DataFrame, column: str = "column") -> DataFrame:
    """One row with the sorted names of a per-column table."""
    return rows.agg(F.array_sort(F.collect_list(column)).alias("names")).where(F.size("names") > 0)


def _list(column: str = "names") -> Column:
    return F.array_join(column, ", ")


def from_entity_type(entity: DataFrame) -> DataFrame:
    s = "entity_type"
    has_id, has_date = F.col("id_col").isNotNull(), F.col("date_col").isNotNull()
    return union_all(
        [
            _rule(entity, s, "question", "What does each row represent?",
                  F.format_string("%s has %d distinct values in %d rows: %s.", "id_col", "unique_count", "n_rows", "guess"), 0.85, has_id),
            _rule(entity, s, "question", "Is this time series or snapshot data?",
                  F.format_string("There is a date (%s) but no identifier.", "date_col"), 0.75, ~has_id & has_date),
            _rule(entity, s, "question", "What does each row represent?", "There is neither an identifier nor a date.", 0.9, ~has_id & ~has_date),
            _rule(entity, s, "technique", "Cohort & retention analysis", "An identifier and a date allow cohorts.", 0.8, has_id & has_date),
        ]
    )


def from_targets(targets: DataFrame) -> DataFrame:
    named = targets.agg(F.array_sort(F.collect_list(F.struct("rank", "column")))["column"].alias("names")).where(F.size("names") > 0)
    s = "target_candidates"
    return union_all(
        [
            _rule(named, s, "question", "Which column are you trying to analyze or predict?",
                  F.concat(F.lit("Likely outcomes: "), _list()), 0.9),
            _rule(named, s, "technique", "Feature importance analysis",
                  F.concat(F.lit("Rank the columns that predict "), F.element_at("names", 1)), 0.75, F.size("names") >= 2),
        ]
    )


def from_column_roles(named_roles: DataFrame) -> DataFrame:
    s = "column_roles"
    unknown = named_roles.where(F.col("role") == "unknown").agg(F.min_by("column", "ordinal").alias("c")).where(F.col("c").isNotNull())
    sizes = named_roles.agg(F.count_if(F.col("role") == "metric").alias("m"), F.count_if(F.col("role") == "dimension").alias("d"))
    return union_all(
        [
            _rule(unknown, s, "question", F.format_string("What is the role of '%s'?", "c"), "Its type fits no role.", 0.8),
            _rule(sizes, s, "technique", "Segment analysis",
                  F.format_string("%d metrics can be compared across %d dimensions.", "m", "d"), 0.85, (F.col("m") > 0) & (F.col("d") > 0)),
        ]
    )


def from_shape(shape: DataFrame) -> DataFrame:
    s, wide = "dataset_shape", F.col("shape") == "wide"
    size = F.format_string("%d rows by %d columns.", "n_rows", "n_cols")
    return union_all(
        [
            _rule(shape, s, "question", "Is this pre-aggregated summary data?", size, 0.75, wide),
            _rule(shape, s, "technique", "Multicollinearity check", size, 0.7, wide),
            _rule(shape, s, "technique", "Aggregation & grouping analysis", size, 0.8, ~wide),
        ]
    )


def from_join_keys(keys: DataFrame) -> DataFrame:
    return _rule(_names(keys), "join_keys", "question", "Do you have related tables to join?",
                 F.concat(F.lit("Possible foreign keys: "), _list()), 0.65)


def from_boolean_disguise(flags: DataFrame) -> DataFrame:
    return _rule(_names(flags), "boolean_disguise", "technique", "Binary segment comparison",
                 F.concat(F.lit("Two-valued columns: "), _list()), 0.85)


def from_id_columns(ids: DataFrame) -> DataFrame:
    s = "id_columns"
    return union_all(
        [
            _rule(ids, s, "question", F.format_string("Does '%s' ever repeat intentionally?", "column"),
                  "A few identifier values repeat.", 0.75, F.col("verdict") == "near-unique"),
            _rule(ids, s, "question", F.format_string("Is '%s' a customer ID or transaction ID?", "column"),
                  F.format_string("Each value appears about %d times.", "average_repeats"), 0.85, F.col("verdict") == "overloaded key"),
        ]
    )


def from_null_intent(flagged: DataFrame) -> DataFrame:
    s = "null_intent"
    return union_all(
        [
            _rule(flagged, s, "question", F.format_string("Why is '%s' missing for %.0f%% of rows?", F.col("column"), F.bround(F.col("null_rate") * 100)),
                  F.concat(F.lit("The nulls look "), F.col("pattern")), 0.85, F.col("null_rate") > 0.1),
            _rule(_names(flagged), s, "technique", "Missing value pattern analysis", F.concat(F.lit("Columns with nulls: "), _list()), 0.8),
        ]
    )


def from_outliers(screened: DataFrame) -> DataFrame:
    s, high = "outlier_prevalence", F.col("extreme_pct") > 0.02
    return union_all(
        [
            _rule(screened, s, "question", F.format_string("Are extreme values in '%s' real or errors?", "column"),
                  F.format_string("%.1f%% lie beyond three deviations.", F.col("extreme_pct") * 100), 0.85, high),
            _rule(_names(screened.where(F.round("extreme_pct", 3) > 0.02)), s, "technique", "Outlier investigation", F.concat(F.lit("Columns: "), _list()), 0.8),
        ]
    )


def from_correlations(pairs: DataFrame) -> DataFrame:
    s = "correlation_opportunity"
    best = _best(pairs, F.abs(F.round("r", 3)).desc(), "col_a", "col_b")
    many = pairs.agg(F.count(F.lit(1)).alias("k"))
    return union_all(
        [
            _rule(best, s, "technique", F.format_string("Correlation deep-dive: %s vs %s", "col_a", "col_b"), F.format_string("r = %.3f", "r"), 0.9),
            _rule(many, s, "technique", "Full correlation matrix", F.format_string("%d strong pairs.", "k"), 0.85, F.col("k") >= 3),
        ]
    )


def from_segments(segments: DataFrame, roles: DataFrame) -> DataFrame:
    s = "segment_variables"
    placed = segments.join(roles.select(F.col("column").alias("segment_col"), "ordinal"), "segment_col")
    wide = roles.agg(F.count_if(F.col("role") == "categorical").alias("k"))
    return union_all(
        [
            _rule(_best(placed, "ordinal"), s, "technique", F.format_string("Segment analysis by '%s'", "segment_col"),
                  F.format_string("Mean %s spreads by %.3f of its average.", "metric_col", "relative_spread"), 0.88),
            _rule(wide, s, "question", "Which dimensions matter most for your analysis?", F.format_string("%d categorical columns.", "k"), 0.7, F.col("k") > 5),
        ]
    )


def from_temporal_coverage(coverage: DataFrame) -> DataFrame:
    s = "temporal_coverage"
    return union_all(
        [
            _rule(coverage, s, "technique", "Trend & seasonality analysis",
                  F.format_string("%s to %s, %s steps.", "date_min", "date_max", "granularity"), 0.9),
            _rule(coverage, s, "question", "Are there data gaps intentional?", F.format_string("%d unusually long gaps.", "gap_count"), 0.8, F.col("gap_count") > 0),
        ]
    )


def from_concentration(screened: DataFrame) -> DataFrame:
    best = _best(screened, F.round("gini", 3).desc(), "column")
    return _rule(best, "concentration_screen", "technique", F.format_string("Pareto / concentration analysis on '%s'", "column"),
                 F.format_string("Gini %.2f", "gini"), 0.88, F.round("gini", 3) > 0.4)


def from_growth(signals: DataFrame) -> DataFrame:
    best = _best(signals, F.abs(F.round("pct_change", 3)).desc(), "column")
    return _rule(best, "growth_signal", "technique", F.format_string("Trend analysis on '%s'", "column"),
                 F.format_string("Changed by %.3f from early to late.", "pct_change"), 0.85, F.abs(F.round("pct_change", 3)) > 0.1)


def from_anomalies(rate: DataFrame) -> DataFrame:
    s, high = "anomaly_prevalence", F.col("anomaly_rate") > 0.03
    text = F.format_string("%.1f%% of rows have an extreme metric.", F.col("anomaly_rate") * 100)
    return union_all(
        [
            _rule(rate, s, "question", "Are you interested in finding unusual records?", text, 0.8, high),
            _rule(rate, s, "technique", "Multi-dimensional anomaly scoring", text, 0.75, high),
        ]
    )


def from_cardinality(screen: DataFrame) -> DataFrame:
    s = "cardinality_screen"
    text = F.format_string("%d distinct values.", "unique_count")
    return union_all(
        [
            _rule(screen, s, "question", F.format_string("Is '%s' actually a category or an identifier?", "column"), text, 0.85, F.col("label") == "near-unique"),
            _rule(screen, s, "technique", F.format_string("Segment by '%s'", "column"), text, 0.8, F.col("label") == "low cardinality"),
        ]
    )


def analysis_hypotheses(entity: DataFrame, concentration=None, growth=None, correlations=None, segments=None, anomaly=None, roles=None) -> DataFrame:
    """Techniques suggested by the strongest signals; absent screens suggest nothing."""
    s, parts = "analysis_hypotheses", []
    if concentration is not None:
        top = _best(concentration, F.round("gini", 3).desc(), "column")
        parts.append(_rule(top, s, "technique", "Pareto concentration deep-dive", F.format_string("Gini %.2f on %s.", "gini", "column"), 0.92, F.round("gini", 3) > 0.4))
    if growth is not None:
        top = _best(growth, F.abs(F.round("pct_change", 3)).desc(), "column")
        way = F.when(F.round("pct_change", 3) > 0, "growth").otherwise("decline")
        parts.append(_rule(top, s, "technique", F.format_string("Time series %s analysis", way), F.concat(F.lit("Strongest change: "), F.col("column")), 0.9, F.abs(F.round("pct_change", 3)) > 0.15))
    if correlations is not None:
        top = _best(correlations, F.abs(F.round("r", 3)).desc(), "col_a", "col_b")
        parts.append(_rule(top, s, "technique", "Regression & causality analysis", F.format_string("%s and %s move together.", "col_a", "col_b"), 0.88))
    if segments is not None:
        placed = segments
        order = ["segment_col"]
        if roles is not None:
            placed = segments.join(roles.select(F.col("column").alias("segment_col"), "ordinal"), "segment_col")
            order = ["ordinal"]
        parts.append(_rule(_best(placed, *order), s, "technique", "Statistical segment comparison", F.format_string("%s differs by %s.", "metric_col", "segment_col"), 0.87))
    parts.append(_rule(entity, s, "technique", "Cohort & retention analysis", "An identifier and a date allow cohorts.", 0.82, F.col("id_col").isNotNull() & F.col("date_col").isNotNull()))
    if anomaly is not None:
        parts.append(_rule(anomaly, s, "technique", "Anomaly detection sweep", F.format_string("%.1f%% of rows look unusual.", F.col("anomaly_rate") * 100), 0.8, F.round("anomaly_rate", 4) > 0.03))
    return union_all(parts)


def missing_analyses(entity: DataFrame, targets: DataFrame) -> DataFrame:
    """Questions about what the table cannot say by itself."""
    s = "missing_analyses"
    named = targets.agg(F.array_sort(F.collect_list(F.struct("rank", "column")))["column"].alias("names"))
    return union_all(
        [
            _rule(named, s, "question", "Which metric should we optimize or predict?", F.concat(F.lit("Candidates: "), _list()), 0.9, F.size("names") > 1),
            _rule(entity, s, "question", "Is there a target period or baseline to compare against?", "A baseline makes change meaningful.", 0.75, F.col("date_col").isNotNull()),
            _rule(entity, s, "question", "Is there external context we should factor in?", "Outside events may explain breaks.", 0.65),
        ]
    )


def composite_opportunity(correlations: DataFrame, roles: DataFrame, named: int | None = None) -> DataFrame:
    """One technique when moderately related columns could form an index (four numeric columns or more).

    The description lists all of them, or the first ``named``.
    """
    moderate = correlations.where((F.abs(F.round("r", 3)) > 0.3) & (F.abs(F.round("r", 3)) < 0.85))
    names = moderate.select(F.explode(F.array("col_a", "col_b")).alias("column")).agg(
        (F.slice(F.array_sort(F.collect_set("column")), 1, named) if named else F.array_sort(F.collect_set("column"))).alias("names")
    )
    numeric = roles.agg(F.count_if(F.col("role") == "numeric").alias("k"))
    joined = names.crossJoin(F.broadcast(numeric))
    return _rule(joined, "composite_opportunity", "technique", "Composite score index", F.concat(F.lit("Related columns: "), _list()), 0.75, (F.size("names") > 0) & (F.col("k") >= 4))


def benchmark_opportunity(df: DataFrame, categorical=(), numeric=()) -> DataFrame:
    """A comparison suggested by control-like values, or else by a target-like column name."""
    s = "benchmark_opportunity"
    categorical, numeric = list(categorical), list(numeric)
    target = next((c for c in numeric if any(k in c.lower() for k in TARGET_KEYWORDS)), None)
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(categorical)], "ordinal int, column string")
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("value"), F.lit(k)) for k in CONTROL_KEYWORDS])
    found = (
        category_counts(df, categorical).where(hit).join(F.broadcast(names), "column")
        .agg(F.min_by("column", "ordinal").alias("c"))
    )
    parts = [
        _rule(found, s, "question", F.format_string("Is '%s' a treatment/control split?", "c"), "Some values name a control group.", 0.85, F.col("c").isNotNull()),
        _rule(found, s, "technique", "A/B or pre/post comparison", F.concat(F.lit("Split by "), F.col("c")), 0.85, F.col("c").isNotNull()),
    ]
    if target:
        parts.append(_rule(found, s, "technique", f"Actuals vs target analysis on '{target}'", "The name suggests a target.", 0.8, F.col("c").isNull()))
    return union_all(parts)


def pool(candidates: list[DataFrame], by=()) -> DataFrame:
    """All candidates, one per kind and label, and per table if ``by`` names its column: the most confident, the earliest
    source among equals."""
    best = Window.partitionBy(*by, "kind", "label").orderBy(F.col("confidence").desc(), "source_order", "description")
    ranked = union_all(candidates).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")
    return ranked.orderBy(*by, "kind", F.col("confidence").desc(), "source_order", "label")


def next_page(candidates: DataFrame, known_labels: DataFrame, page: int = 1, size: int = 3) -> DataFrame:
    """The candidates of one page per kind whose label neither contains nor is contained in a known label.

    ``known_labels`` (column ``label``) is the short list of what a user already has. ``has_more`` tells
    whether a kind continues after this page.
    """
    mine, theirs = F.lower(F.col("c.label")), F.lower(F.col("k.label"))
    known = known_labels.where(F.col("label").isNotNull()).select("label")
    fresh = candidates.alias("c").join(F.broadcast(known).alias("k"), F.contains(mine, theirs) | F.contains(theirs, mine), "left_anti")
    order = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), "source_order", "label")
    start = (page - 1) * size
    return (
        fresh.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= start + size + 1)
        .withColumn("has_more", F.max("position").over(Window.partitionBy("kind")) > start + size)
        .where((F.col("position") > start) & (F.col("position") <= start + size))
    )


def match_frameworks(texts: DataFrame, text_id: str, text: str, frameworks: DataFrame, top: int = 3) -> DataFrame:
    """``text_id, framework, score, rank``: frameworks whose words occur in each text.

    ``frameworks`` (``framework, ordinal, word, weight``) is a dictionary, one row per word; its distinct
    words are looked for in each whole text, some hundred to a pass over the row.
    """
    words = [r["word"] for r in frameworks.select("word").distinct().orderBy("word").collect()]
    lowered = texts.select(F.col(text_id).alias("text_id"), F.lower(text).alias("_t"))
    held = [
        F.array_compact(F.array(*[F.when(F.contains(F.col("_t"), F.lit(w)), F.lit(w)) for w in words[i : i + WORDS_PER_ARRAY]]))
        for i in range(0, len(words), WORDS_PER_ARRAY)
    ]
    found = F.concat(*held) if held else F.array().cast("array<string>")
    hits = lowered.select("text_id", F.explode(found).alias("word"))
    best = Window.partitionBy("text_id").orderBy(F.col("score").desc(), "ordinal")
    few = len(words) <= BROADCAST_WORDS
    return (
        hits.join(F.broadcast(frameworks) if few else frameworks, "word")
        .groupBy("text_id", "framework", "ordinal")
        .agg(F.sum("weight").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("text_id", "framework", "score", "rank")
    )


def ground_columns(texts: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Add ``low_confidence``: does the text fail to name any known column?"""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    if not columns:
        return texts.withColumn("low_confidence", F.lit(False))
    named = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(c.lower())) for c in columns])
    return texts.withColumn("low_confidence", ~named)


def unique_edges(edges: DataFrame, source: str, target: str, order) -> DataFrame:
    """The first edge, by ``order``, of each unordered pair of ends.

    An aggregate per pair, so repeated edges combine before the shuffle.
    """
    keep = F.min_by(F.struct(*edges.columns), F.struct(*order)).alias("_first")
    return edges.groupBy(F.least(source, target).alias("_a"), F.greatest(source, target).alias("_b")).agg(keep).select("_first.*")
