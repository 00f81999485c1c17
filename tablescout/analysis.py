"""Whole-table entry points: run groups of operators with columns chosen from their roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import union_all
from tablescout.operators import anomaly, business, candidates, exploratory, findings, foundation, ranking, signals, structure, text, timeseries
from tablescout.operators.foundation import Roles
from tablescout.operators.sampling import representative_rows
from tablescout.plans.sequence import row_series

MODULES = ("exploratory", "time_series", "ranking", "business", "text", "anomaly")


@dataclass
class Table:
    """A table with what the operators need to choose columns: names and distinct counts, never rows."""

    df: DataFrame
    role_table: DataFrame
    roles: Roles
    unique: dict[str, int]
    tie_breakers: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, tie_breakers=(), mode: str = "reference", exact: bool = True) -> "Table":
        inferred = foundation.infer_roles(df, mode=mode, exact=exact)
        rows = inferred.orderBy("ordinal").collect()
        facts = df.sparkSession.createDataFrame(rows, inferred.schema)
        return cls(df, facts, foundation.collect_roles(facts), {r["column"]: r["unique_count"] for r in rows}, list(tie_breakers))

    def categories(self, low: int, high: int) -> list[str]:
        """Categorical columns with a number of distinct values in the range."""
        return [c for c in self.roles.categorical if low <= self.unique[c] <= high]

    @cached_property
    def series(self) -> DataFrame:
        """The ordered row series of the first numeric columns, laid out once for all analyses."""
        return row_series(self.df, self.ts, self.roles.numeric[:5], self.tie_breakers)

    def series_of(self, count: int) -> DataFrame:
        return self.series.where(F.col("metric").isin(self.roles.numeric[:count]))

    @property
    def ts(self) -> str | None:
        return self.roles.datetime[0] if self.roles.datetime else None


@dataclass
class Analysis:
    """Results by operator, their findings, and the columns that stopped the run, if any."""

    results: dict[str, DataFrame]
    findings: DataFrame | None
    blocked: list[tuple[str, float]]


def _foundation(t: Table) -> dict[str, DataFrame]:
    out = {"infer_roles": t.role_table, "data_quality": foundation.data_quality(t.df, t.roles.categorical)}
    if t.roles.numeric or t.roles.categorical:
        out["field_profile"] = foundation.field_profile(t.df, t.roles.numeric, t.roles.categorical)
    return out


def _exploratory(t: Table) -> dict[str, DataFrame]:
    df, num, cats = t.df, t.roles.numeric, t.roles.categorical
    out: dict[str, DataFrame] = {}
    if num:
        out["distribution"] = exploratory.distribution(df, num)
        out["outliers"] = exploratory.outliers(df, num)
        out["normality"] = exploratory.normality(df, num)
    pairs = []
    if len(num) >= 2:
        pairs = exploratory.strongest_pairs(df, num, top=10)
        out["correlation"] = exploratory.correlation(df, num, top=20)
    if pairs:
        out["pairwise_regression"] = exploratory.pairwise_regression(df, pairs)
    varied = [c for c in num if t.unique[c] > 1]
    if len(varied) >= 3:
        out["vif"] = exploratory.vif(df, varied)
    if len(num) >= 3:
        out["partial_correlation"] = exploratory.partial_correlation(df, num[:10], top=15)
    if cats:
        out["frequency"] = exploratory.frequency(df, cats)
        out["frequency_summary"] = exploratory.frequency_summary(df, cats)
        out["cardinality"] = exploratory.cardinality(df, cats)
    lowest = sorted(cats, key=lambda c: t.unique[c])[:3]
    crossed = [(a, b) for i, a in enumerate(lowest) for b in lowest[i + 1 :] if max(t.unique[a], t.unique[b]) <= 20]
    if crossed:
        out["crosstab"] = exploratory.crosstab(df, crossed)
        out["crosstab_summary"] = exploratory.crosstab_summary(df, crossed)
    segment = next(iter(t.categories(2, 10)), None)
    if segment and num:
        out["segment_comparison"] = exploratory.segment_comparison(df, segment, num[:4])
        out["segment_spread"] = exploratory.segment_spread(df, segment, num[:4])
        out["levene"] = exploratory.levene(df, segment, num[:5])
        out["anova"] = exploratory.anova(df, segment, num[:5])
        if pairs:
            out["interaction"] = exploratory.interaction(df, segment, pairs[:4])
            out["interaction_spread"] = exploratory.interaction_spread(df, segment, pairs[:4])
    tested = t.categories(2, 20)[:4]
    if len(tested) >= 2:
        out["chi_square"] = exploratory.chi_square(df, tested)
    return out


def _time_series(t: Table) -> dict[str, DataFrame]:
    if t.ts is None:
        return {}
    df, num, out = t.df, t.roles.numeric, {}
    if num:
        of = t.series_of
        out["trend"] = timeseries.trend(of(5))
        out["growth_rate"] = timeseries.growth_rate(of(4))
        out["rolling_volatility"] = timeseries.rolling_volatility(of(4))
        out["peaks_valleys"] = timeseries.peaks_valleys(of(3))
        out["stationarity"] = timeseries.stationarity(of(4))
        out["seasonality"] = timeseries.seasonality(df, t.ts, num[:3])
        out["changepoints"] = timeseries.changepoints(of(3), top=3)
        out["cycles"] = timeseries.long_cycles(of(3))
        out["forecast_baseline"] = timeseries.forecast_baseline(of(3))
    if len(num) >= 2:
        out["lag_correlation"] = timeseries.lag_correlation(df, t.ts, num[:4], t.tie_breakers)
    drifting = [c for c in t.roles.categorical[:3] if t.unique[c] <= 20]
    if drifting:
        out["category_drift"] = timeseries.category_drift(df, t.ts, drifting, t.tie_breakers, top=5)
    return {k: v for k, v in out.items() if v is not None}


def _ranking(t: Table) -> dict[str, DataFrame]:
    df, num, out = t.df, t.roles.numeric, {}
    if num:
        out["percentile_ranking"] = ranking.percentile_ranking(df, num[:6])
        out["tiers"] = ranking.tiers(df, num[:4])
    if len(num) >= 2:
        out["composite_score"] = ranking.composite_score(df, num[:6])
        out["top_bottom"] = ranking.top_bottom(df, num[:3], num)
    if t.ts and num:
        growth = timeseries.growth_rate(t.series_of(4))
        out["winners_losers"] = ranking.winners_losers(growth)
    return out


def _business(t: Table) -> dict[str, DataFrame]:
    df, num, out = t.df, t.roles.numeric, {}
    if num:
        out["pareto"] = business.pareto(df, num[:3])
        out["concentration"] = business.concentration(df, num[:3])
        out["benchmark"] = business.benchmark(df, num[:3])
    stage = next(iter(t.categories(2, 8)), None)
    if stage:
        out["funnel"] = business.funnel(df, stage)
    if t.ts and num:
        cohorts = business.cohorts(df, t.ts, num[0])
        out["cohorts"] = cohorts
        out["retention"] = business.retention(cohorts)
        out["ltv"] = business.ltv(cohorts, business.retention(cohorts))
    if t.ts and len(num) >= 2:
        out["decompose"] = business.decompose(df, t.ts, num[0], num[1])
    return out


def _text(t: Table) -> dict[str, DataFrame]:
    out = {}
    words = (t.roles.text + t.roles.categorical)[:5]
    if words:
        out["pattern_counts"] = text.pattern_counts(t.df, words)
    alike = t.categories(5, 100)[:3]
    if alike:
        out["near_duplicate_values"] = text.near_duplicate_values(t.df, alike)
    labels = t.categories(0, 30)[:3]
    if len(labels) >= 2:
        out["co_occurrence"] = text.co_occurrence(t.df, labels, per_pair=3, top=20)
    return out


def _anomaly(t: Table) -> dict[str, DataFrame]:
    out = {
        "duplicates": anomaly.duplicates(t.df, t.roles.id, t.roles.datetime, near_cols=10),
        "co_missing": anomaly.co_missing(t.df),
        "missing_rows": anomaly.missing_rows(t.df),
    }
    if len(t.roles.numeric) >= 2:
        out["anomaly_score"] = anomaly.anomaly_score(t.df, t.roles.numeric[:8])
    return out


_RUNNERS: dict[str, Callable[[Table], dict[str, DataFrame]]] = {
    "exploratory": _exploratory,
    "time_series": _time_series,
    "ranking": _ranking,
    "business": _business,
    "text": _text,
    "anomaly": _anomaly,
}


def analyze(
    df: DataFrame, modules=("exploratory",), tie_breakers=(), mode: str = "reference", max_null: float = 0.85
) -> Analysis:
    """Run the foundation and the named modules on one table.

    A column emptier than ``max_null`` stops the run after the foundation, as results would mislead.
    """
    unknown = set(modules) - set(MODULES)
    if unknown:
        raise ValueError(f"unknown modules: {sorted(unknown)}")
    table = Table.of(df, tie_breakers, mode)
    results = _foundation(table)
    blocked = [(r["column"], r["null_rate"]) for r in foundation.quality_gate(df, max_null).orderBy("ordinal").collect()]
    if not blocked:
        for name in modules:
            results.update(_RUNNERS[name](table))
    # Results are small; cached ones serve the caller and the findings with one computation.
    results = {name: frame.persist() for name, frame in results.items()}
    told = [findings.findings_of(name, frame) for name, frame in results.items() if name in findings.RULES]
    return Analysis(results, union_all(told) if told else None, blocked)


@dataclass
class Exploration:
    """Suggested questions and techniques, the table summary and a few telling rows."""

    screens: dict[str, DataFrame]
    candidates: DataFrame
    summary: DataFrame
    sample_rows: DataFrame | None


def explore(df: DataFrame, tie_breakers=(), order_by: str | None = None, mode: str = "reference") -> Exploration:
    """Screen one table and pool the questions and techniques that its signals suggest."""
    t = Table.of(df, tie_breakers, mode)
    num, cats, roles = t.roles.numeric, t.roles.categorical, t.role_table
    # Each screen is small and feeds several rules, so it is cached when added.
    s: dict[str, DataFrame] = {
        "entity_type": structure.entity_type(roles).persist(),
        "column_roles": structure.column_roles(roles).persist(),
        "dataset_shape": structure.dataset_shape(df).persist(),
        "join_keys": structure.join_keys(roles, top=5).persist(),
        "id_columns": structure.id_columns(roles).persist(),
        "null_intent": signals.null_intent(df, num).persist(),
    }
    pooled = [
        candidates.from_entity_type(s["entity_type"]),
        candidates.from_column_roles(s["column_roles"]),
        candidates.from_shape(s["dataset_shape"]),
        candidates.from_join_keys(s["join_keys"]),
        candidates.from_id_columns(s["id_columns"]),
        candidates.from_null_intent(s["null_intent"]),
    ]
    if num:
        s["target_candidates"] = structure.target_candidates(roles, foundation.numeric_profile(df, num)).persist()
        s["outlier_prevalence"] = signals.outlier_prevalence(df, num).persist()
        s["concentration_screen"] = signals.concentration_screen(df, num[:5]).persist()
        pooled += [
            candidates.from_targets(s["target_candidates"]),
            candidates.from_outliers(s["outlier_prevalence"]),
            candidates.from_concentration(s["concentration_screen"]),
        ]
    # Asked of every table; without numbers there are no targets to name.
    targets = s.get("target_candidates", df.sparkSession.createDataFrame([], "rank int, column string"))
    pooled.append(candidates.missing_analyses(s["entity_type"], targets))
    if num or cats:
        s["boolean_disguise"] = structure.boolean_disguise(df, num, cats).persist()
        pooled.append(candidates.from_boolean_disguise(s["boolean_disguise"]))
    if len(num) >= 2:
        s["correlation_opportunity"] = signals.correlation_opportunity(df, num, top=5).persist()
        s["anomaly_prevalence"] = signals.anomaly_prevalence(df, num[:8]).persist()
        pooled += [
            candidates.from_correlations(s["correlation_opportunity"]),
            candidates.from_anomalies(s["anomaly_prevalence"]),
            candidates.composite_opportunity(s["correlation_opportunity"], roles, named=4),
        ]
    if num and cats:
        s["segment_variables"] = signals.segment_variables(df, num[0], cats[:5]).persist()
        pooled.append(candidates.from_segments(s["segment_variables"], roles))
    if t.ts:
        s["temporal_coverage"] = signals.temporal_coverage(df, t.ts).persist()
        pooled.append(candidates.from_temporal_coverage(s["temporal_coverage"]))
    if t.ts and num:
        s["growth_signal"] = signals.growth_signal(df, t.ts, num[:5], tie_breakers).persist()
        pooled.append(candidates.from_growth(s["growth_signal"]))
    if cats:
        s["cardinality_screen"] = signals.cardinality_screen(df, cats).persist()
        pooled += [candidates.from_cardinality(s["cardinality_screen"]), candidates.benchmark_opportunity(df, cats, num)]
    pooled.append(
        candidates.analysis_hypotheses(
            s["entity_type"],
            s.get("concentration_screen"),
            s.get("growth_signal"),
            s.get("correlation_opportunity"),
            s.get("segment_variables"),
            s.get("anomaly_prevalence"),
            roles,
        )
    )
    sampled = foundation.infer_roles(df, mode=mode, samples=True)
    rows = representative_rows(df, order_by, num[:3], cats[:2]) if order_by else None
    return Exploration(s, candidates.pool(pooled), foundation.dataset_summary(df, sampled, num, cats), rows)


def explore_many(tables: dict[str, DataFrame], tie_breakers=(), mode: str = "reference") -> DataFrame:
    """Candidates of several tables as one frame, told apart by ``dataset_id``."""
    found = [explore(df, [c for c in tie_breakers if c in df.columns], mode=mode).candidates for df in tables.values()]
    named = [frame.withColumn("dataset_id", F.lit(name)) for name, frame in zip(tables, found)]
    return candidates.pool(named, by=["dataset_id"])
