"""Activity of entities by period, who falls silent, and a model of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio
from tablescout.plans.gram import features, gram, number_rows


def _period_number(time: Column, period: str) -> Column:
    """Days, Monday weeks or months since a fixed one."""
    if period == "month":
        return (F.year(time) * 12 + F.month(time) - 1).cast("int")
    days = F.datediff(time, F.lit("1970-01-05").cast("date"))
    if period == "day":
        return days.cast("int")
    if period == "week":
        return F.floor(days / 7).cast("int")
    raise ValueError(f"period is day, week or month, not {period}")


def activity_panel(df: DataFrame, entity: str, time: str, period: str = "week", value: str | None = None, silent: int = 1) -> DataFrame:
    """A row for each entity and period from its first one to the last of the table, also without activity.

    ``period`` counts from 0, the first of the table. ``events`` and ``value_sum`` are of the period, ``age`` the periods
    since the entity's first one, ``recency`` those since its last active one, ``events_so_far`` all up to now.
    ``churned`` says that the next ``silent`` periods have no event; it is null where the table ends before, as nobody
    knows then (``censored``).

    Rows are counted by entity and period before anything else, so an entity with a third of all rows is as many rows
    as there are periods; the windows run over those.
    """
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    counts = rows.groupBy(F.col(entity).alias("entity"), _period_number(F.col(time), period).alias("at"))
    counts = counts.agg(F.count(F.lit(1)).alias("events"), F.sum(amount).alias("value_sum"))
    edges = counts.agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    spans = counts.groupBy("entity").agg(F.min("at").alias("_start")).crossJoin(F.broadcast(edges))
    dense = spans.select("entity", "_first", "_last", F.explode(F.sequence("_start", "_last")).alias("at"), "_start")
    panel = dense.join(counts, ["entity", "at"], "left").fillna({"events": 0, "value_sum": 0.0})
    past = W.partitionBy("entity").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("entity").orderBy("at").rowsBetween(1, silent)
    known = F.col("at") + silent <= F.col("_last")
    return panel.select(
        "entity",
        (F.col("at") - F.col("_first")).alias("period"),
        "events",
        "value_sum",
        (F.col("at") - F.col("_start")).alias("age"),
        (F.col("at") - F.max(F.when(F.col("events") > 0, F.col("at"))).over(past)).alias("recency"),
        F.sum("events").over(past).alias("events_so_far"),
        (~known).alias("censored"),
        F.when(known, F.coalesce(F.sum("events").over(ahead), F.lit(0)) == 0).alias("churned"),
    )


def churn_by_period(panel: DataFrame) -> DataFrame:
    """``period, entities, active, churned, censored, churn_rate``: of entities active in a period, those silent after it."""
    active = F.col("events") > 0
    return (
        panel.groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.count_if(active).alias("active"),
            F.count_if(active & F.col("churned")).alias("churned"),
            F.count_if(active & F.col("censored")).alias("censored"),
        )
        .withColumn("churn_rate", ratio(F.col("churned"), F.col("active") - F.col("censored")))
    )


@dataclass
class LogisticModel:
    """Log odds of the label as a sum over columns."""

    cols: list[str]
    n: int
    intercept: float
    coefficients: np.ndarray
    errors: np.ndarray
    log_likelihood: float
    rounds: int

    def table(self, df: DataFrame) -> DataFrame:
        """``term, coefficient, std_error, z``; the first row is the intercept."""
        values = zip(["intercept", *self.cols], [self.intercept, *self.coefficients], self.errors)
        rows = [(c, float(b), float(e), float(b / e) if e > 0 else None) for c, b, e in values]
        return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, z double")

    def probability(self, df: DataFrame, cols) -> Column:
        """An expression for the chance of the label; null where a column is missing."""
        named = features(df, cols).values()
        odds = sum((c.cast("double") * float(b) for c, b in zip(named, self.coefficients)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-odds))


def logistic_regression(df: DataFrame, cols, label: str, rounds: int = 30, ridge: float = 0.0, tolerance: float = 1e-10) -> LogisticModel:
    """Logistic regression of a boolean or 0/1 ``label`` on ``cols`` over complete rows, by Newton steps.

    A step is one scan: tasks add up gradient and curvature, numbers by the square of the columns, and the driver solves
    a small system. Columns are centred and scaled by one scan before, so that steps are well conditioned, and the
    coefficients are given in the columns' own units. ``ridge`` shrinks the coefficients of the scaled columns, which
    also keeps them finite where a column parts the labels. Constant columns get 0.
    """
    rows = df.where(F.col(label).isNotNull())
    found = gram(rows, cols)
    width = len(found.cols)
    usable = ~np.isnan(np.diag(found.correlation)) if found.n else np.zeros(width, bool)
    scale = np.where(usable, np.sqrt(np.nan_to_num(np.diag(found.covariance))), 1.0)
    centre = np.nan_to_num(found.mean)
    values = rows.select(
        *(c.cast("double").alias(f"x{i}") for i, c in enumerate(features(rows, cols).values())), F.col(label).cast("int").cast("double").alias("y")
    )
    d = width + 1

    def scan(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d + d * d)
            for batch in batches:
                for part in number_rows(batch):
                    x = np.concatenate([np.ones((len(part), 1)), np.where(usable, (part[:, :-1] - centre) / scale, 0.0)], axis=1)
                    y, odds = part[:, -1], x @ beta
                    p = 0.5 * (1 + np.tanh(odds / 2))
                    total[0] += float(np.sum(y * odds - np.logaddexp(0, odds)))
                    total[1 : 1 + d] += x.T @ (y - p)
                    total[1 + d :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

        total = np.zeros(1 + d + d * d)
        for r in values.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            total[r["at"]] = r["v"]
        return total[0], total[1 : 1 + d], total[1 + d :].reshape(d, d)

    shrink = np.diag([0.0] + [ridge] * width)
    idle = np.diag([0.0, *np.where(usable, 0.0, 1.0)])
    beta, used = np.zeros(d), 0
    goal = lambda b, likelihood: likelihood - 0.5 * float(b @ shrink @ b)
    likelihood, slope, curve = scan(beta)
    for used in range(1, rounds + 1):
        step = np.linalg.lstsq(curve + shrink + idle, slope - shrink @ beta, rcond=None)[0]
        following = scan(beta + step)
        # Half steps as long as a whole one goes too far.
        while goal(beta + step, following[0]) < goal(beta, likelihood) - 1e-9 * abs(likelihood) and np.abs(step).max() > tolerance:
            step = step / 2
            following = scan(beta + step)
        beta, (likelihood, slope, curve) = beta + step, following
        if np.abs(step).max() <= tolerance:
            break
    spread = np.linalg.pinv(curve + shrink + idle)
    own = np.where(usable, beta[1:] / scale, 0.0)
    # From centred and scaled columns back to the given ones.
    back = np.eye(d)
    back[0, 1:] = np.where(usable, -centre / scale, 0.0)
    back[1:, 1:] = np.diag(np.where(usable, 1 / scale, 0.0))
    errors = np.sqrt(np.maximum(np.diag(back @ spread @ back.T), 0))
    return LogisticModel(found.cols, found.n, float(beta[0] - own @ centre), own, errors, float(likelihood), used)
