"""Screens of a table's structure, derived from its role table.

The role table has one row per column, so these plans are small whatever the data's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio, union_all
from tablescout.plans.counts import category_counts

# Name parts of likely outcome columns and of likely join keys.
OUTCOME_KEYWORDS = (
    "revenue", "sales", "profit", "churn", "conversion", "score",
    "rate", "count", "amount", "value", "price", "spend", "cost",
    "return", "mrr", "arr", "ltv", "orders", "units",
)
JOIN_KEYWORDS = ("id", "code", "key", "ref", "num", "no", "number", "sku", "uuid")

# The two-word vocabularies of a yes/no column, each in sorted order.
BOOLEAN_WORDS = (
    ("no", "yes"),
    ("n", "y"),
    ("false", "true"),
    ("0", "1"),
    ("active", "inactive"),
    ("fail", "pass"),
)

# The analytical role of each column type.
ROLE_NAMES = {
    "id_col": "identifier",
    "datetime": "time axis",
    "numeric": "metric",
    "categorical": "dimension",
    "text": "free text",
}


def name_has(column: Column, words) -> Column:
    spaced = F.regexp_replace(F.lower(column), "_", " ")
    return reduce(lambda a, b: a | b, [F.contains(spaced, F.lit(w)) for w in words])


def _share() -> Column:
    return ratio(F.col("unique_count"), F.col("n_rows"))


def entity_type(roles: DataFrame) -> DataFrame:
    """One row, ``id_col, date_col, unique_count, n_rows, guess``: what a row of the table stands for."""
    first = lambda role, c: F.min_by(F.when(F.col("role") == role, F.col(c)), F.when(F.col("role") == role, F.col("ordinal")))
    facts = roles.agg(
        first("id_col", "column").alias("id_col"),
        first("datetime", "column").alias("date_col"),
        first("id_col", "unique_count").alias("unique_count"),
        F.max("n_rows").alias("n_rows"),
    )
    return facts.withColumn(
        "guess",
        F.when(
            F.col("id_col").isNotNull(),
            F.when(F.col("unique_count") == F.col("n_rows"), "one row per entity")
            .when(_share() < 0.1, "many rows per entity")
            .otherwise("some entities repeat"),
        )
        .when(F.col("date_col").isNotNull(), "time series or snapshot")
        .otherwise("unknown unit"),
    )


def target_candidates(roles: DataFrame, profile: DataFrame, top: int = 3) -> DataFrame:
    """``column, score, keyword_match, rank``: numeric columns that look like outcomes."""
    facts = profile.select("column", "cv", "null_rate")
    scored = (
        roles.where(F.col("role") == "numeric")
        .join(facts, "column", "left")
        .withColumn("keyword_match", name_has(F.col("column"), OUTCOME_KEYWORDS))
        .withColumn(
            "score",
            F.when(F.col("keyword_match"), 1.5).otherwise(0.0)
            + F.least(F.coalesce("cv", F.lit(0.0)), F.lit(3.0)) / 3
            - F.coalesce("null_rate", F.lit(0.0)),
        )
    )
    best = Window.orderBy(F.col("score").desc(), "ordinal")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("column", "score", "keyword_match", "rank")
    )


def column_roles(roles: DataFrame) -> DataFrame:
    """``column, ordinal, role`` in analysts' terms."""
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return roles.select("column", "ordinal", F.coalesce(F.try_element_at(names, F.col("role")), F.lit("unknown")).alias("role"))


def dataset_shape(df: DataFrame) -> DataFrame:
    """One row, ``shape, n_rows, n_cols, col_row_ratio``."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))
    share = F.col("n_cols") / F.greatest(F.col("n_rows"), F.lit(1))
    return counted.select(
        F.when(share > 0.5, "wide").otherwise("long").alias("shape"), "n_rows", "n_cols", share.alias("col_row_ratio")
    )


def id_columns(roles: DataFrame) -> DataFrame:
    """``column, unique_count, unique_ratio, verdict, average_repeats`` for identifier columns."""
    return roles.where(F.col("role") == "id_col").select(
        "column",
        "unique_count",
        _share().alias("unique_ratio"),
        F.when(_share() == 1, "true unique ID").when(_share() > 0.95, "near-unique").otherwise("overloaded key").alias("verdict"),
        F.floor(ratio(F.col("n_rows"), F.col("unique_count"))).alias("average_repeats"),
    )


def join_keys(roles: DataFrame, top: int | None = None) -> DataFrame:
    """``column, unique_count, unique_ratio``: key-like names with a middling share of distinct values."""
    wanted = roles.where(F.col("role").isin("id_col", "categorical") & name_has(F.col("column"), JOIN_KEYWORDS))
    keys = (
        wanted.withColumn("unique_ratio", _share())
        .where((F.col("unique_ratio") > 0.01) & (F.col("unique_ratio") < 0.95))
        .orderBy(F.when(F.col("role") == "id_col", 0).otherwise(1), "ordinal")
    )
    return (keys.limit(top) if top else keys).select("column", "unique_count", "unique_ratio")


def boolean_disguise(df: DataFrame, numeric=(), categorical=()) -> DataFrame:
    """``column, disguised_as``: 0/1 numbers and two-word categories that are really flags."""
    parts = []
    numeric, categorical = list(numeric), list(categorical)
    if numeric:
        wide = df.agg(*[F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(f"_{i}") for i, c in enumerate(numeric)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("_yes")) for i, c in enumerate(numeric)]
        parts.append(
            wide.select(F.inline(F.array(*rows))).where("_yes").select("column", F.lit("numeric 0/1").alias("disguised_as"))
        )
    if categorical:
        folded = (
            category_counts(df, categorical)
            .groupBy("column", F.lower(F.trim("value")).alias("word"))
            .agg(F.lit(1).alias("_one"))
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("_k"), F.min("word").alias("_a"), F.max("word").alias("_b"))
        )
        known = reduce(lambda x, y: x | y, [(F.col("_a") == a) & (F.col("_b") == b) for a, b in BOOLEAN_WORDS])
        parts.append(
            folded.where((F.col("_k") == 2) & known).select("column", F.concat_ws("/", F.lit("string"), "_a", "_b").alias("disguised_as"))
        )
    return union_all(parts)
