"""Column roles, profiles and data quality: the base every other analysis builds on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio, union_all
from tablescout.plans.counts import category_counts, distinct_counts
from tablescout.plans.ranks import ranked_quantiles
from tablescout.plans.stats import column_moments
from tablescout.sources.tables import NESTED_TYPES, TIME_TYPES

# Name parts that mark a near-unique text column as an identifier.
ID_NAME_PARTS = ("id", "uuid", "key", "code", "ref", "sku")

INTEGRAL_TYPES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


@dataclass
class Roles:
    """Column names by role, in table order."""

    datetime: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    id: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that can be analysed: everything but nested and binary ones."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def infer_roles(df: DataFrame, mode: str = "reference", exact: bool = True, samples: bool = False) -> DataFrame:
    """``column, ordinal, spark_type, role, n_rows, null_count, unique_count, avg_len`` (and ``sample_values``).

    ``mode="strict"`` lets only integral and text columns be identifiers, so near-unique continuous
    measures stay numeric. ``exact=False`` replaces the distinct counts by sketches.
    """
    cols = plain_columns(df)
    fields = [df.schema[c] for c in cols]
    kinds = []
    for f in fields:
        if isinstance(f.dataType, TIME_TYPES):
            kinds.append("time")
        elif isinstance(f.dataType, T.BooleanType):
            kinds.append("bool")
        elif isinstance(f.dataType, T.NumericType):
            integral = isinstance(f.dataType, INTEGRAL_TYPES)
            kinds.append("number" if integral or mode == "reference" else "measure")
        else:
            kinds.append("string" if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)) else "other")
    facts = df.sparkSession.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), k, any(p in f.name.lower() for p in ID_NAME_PARTS))
            for i, (f, k) in enumerate(zip(fields, kinds))
        ],
        "ordinal int, column string, spark_type string, kind string, id_name boolean",
    )
    share = F.col("unique_count") / F.greatest(F.col("n_rows"), F.lit(1))
    role = (
        F.when(F.col("kind") == "time", "datetime")
        .when(F.col("kind") == "bool", "boolean")
        .when(F.col("kind") == "measure", "numeric")
        .when(F.col("kind") == "number", F.when((share > 0.95) & (F.col("unique_count") > 50), "id_col").otherwise("numeric"))
        .when(F.col("kind") == "other", "categorical")
        .when(F.col("dated") > 0.8, "datetime")
        .when((share > 0.5) & (F.col("avg_len") > 30), "text")
        .when((share > 0.9) & F.col("id_name"), "id_col")
        .otherwise("categorical")
    )
    counted = distinct_counts(df, cols, exact)
    out = counted.join(F.broadcast(facts), "column").select(
        "column",
        "ordinal",
        "spark_type",
        role.alias("role"),
        "n_rows",
        (F.col("n_rows") - F.col("n")).alias("null_count"),
        "unique_count",
        "avg_len",
    )
    if samples:
        smallest = Window.partitionBy("column").orderBy("value")
        five = (
            category_counts(df, cols)
            .withColumn("_r", F.row_number().over(smallest))
            .where(F.col("_r") <= 5)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
        )
        out = out.join(five, "column", "left")
    return out


def collect_roles(roles: DataFrame) -> Roles:
    """Bring the role of each column (names only) to the driver."""
    names = {"datetime": "datetime", "numeric": "numeric", "categorical": "categorical", "text": "text", "id_col": "id", "boolean": "boolean"}
    out = Roles()
    for row in roles.select("column", "role", "ordinal").orderBy("ordinal").collect():
        getattr(out, names[row["role"]]).append(row["column"])
    return out


def detect(df: DataFrame, **options) -> Roles:
    return collect_roles(infer_roles(df, **options))


def numeric_profile(df: DataFrame, cols) -> DataFrame:
    """``column, n, mean, std, min, max, p25, p50, p75, null_rate, unique_count, range, cv``; all-null columns are left out."""
    moments = column_moments(df, cols)
    points = ranked_quantiles(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return moments.join(F.broadcast(points), "column").select(
        "column",
        "n",
        "mean",
        "std",
        "min",
        "max",
        "p25",
        "p50",
        "p75",
        (1 - ratio(F.col("n"), F.col("n_rows"))).alias("null_rate"),
        "unique_count",
        (F.col("max") - F.col("min")).alias("range"),
        ratio(F.col("std"), F.col("mean")).alias("cv"),
    )


def categorical_profile(df: DataFrame, cols) -> DataFrame:
    """``column, n, top_value, top_freq, unique_count, null_rate``; equal counts resolve to the smaller value."""
    cols = list(cols)
    per_column = (
        category_counts(df, cols)
        .groupBy("column")
        .agg(
            F.sum("cnt").alias("n"),
            F.count(F.lit(1)).alias("unique_count"),
            F.max("cnt").alias("_top"),
            F.min(F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("value")))["value"].alias("top_value"),
        )
    )
    named = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        F.broadcast(named)
        .join(per_column, "column", "left")
        .crossJoin(F.broadcast(rows))
        .select(
            "column",
            F.coalesce("n", F.lit(0)).alias("n"),
            "top_value",
            (F.col("_top") / F.col("n")).alias("top_freq"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            (1 - ratio(F.coalesce("n", F.lit(0)), F.col("n_rows"))).alias("null_rate"),
        )
    )


PROFILE = (
    "column string, n bigint, mean double, std double, min double, max double, p25 double, p50 double, p75 double, "
    "null_rate double, unique_count bigint, range double, cv double, kind string, top_value string, top_freq double"
)


def field_profile(df: DataFrame, numeric=(), categorical=()) -> DataFrame:
    """One row per column: numeric statistics or the dominant category; one schema whichever kinds there are."""
    parts = []
    if numeric:
        parts.append(numeric_profile(df, numeric).withColumn("kind", F.lit("numeric")))
    if categorical:
        parts.append(categorical_profile(df, categorical).withColumn("kind", F.lit("categorical")))
    out = union_all(parts) if parts else df.sparkSession.createDataFrame([], PROFILE)
    fields = [f.split() for f in PROFILE.split(", ")]
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None).cast(t)).alias(c) for c, t in fields])


def duplicate_count(df: DataFrame, cols, name: str = "duplicate_count") -> DataFrame:
    """Rows beyond the first of each distinct combination; nulls equal each other.

    Rows are compared by a 128-bit digest, so 16 bytes of a row are shuffled.
    """
    copies = df.select(row_digest(cols).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_k"))
    return copies.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias(name))


def row_digest(cols) -> Column:
    """128 bits of a row's values; a null is told from every value and every place."""
    parts = [x for c in cols for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def null_rates(df: DataFrame) -> DataFrame:
    """``column, ordinal, null_rate`` over all plain columns, in one pass."""
    cols = plain_columns(df)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(i).alias("ordinal"),
                        (1 - ratio(F.col(f"_n{i}"), F.col("_rows"))).alias("null_rate"),
                    )
                    for i, c in enumerate(cols)
                ]
            )
        )
    )


def case_issues(df: DataFrame, categorical) -> DataFrame:
    """``column, raw_values, folded_values``: categories that differ only by letter case."""
    return (
        category_counts(df, categorical)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("raw_values"), F.countDistinct(F.lower("value")).alias("folded_values"))
        .where(F.col("folded_values") < F.col("raw_values"))
    )


def data_quality(df: DataFrame, categorical=()) -> DataFrame:
    """One summary row: rows, columns, overall null rate, columns with nulls, duplicates, case issues."""
    cols = plain_columns(df)
    rates = null_rates(df).agg(
        F.coalesce(F.avg("null_rate"), F.lit(0.0)).alias("overall_null_rate"),
        F.count_if(F.col("null_rate") > 0).alias("columns_with_nulls"),
        F.count_if(F.col("null_rate") > 0.2).alias("high_null_columns"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("col_count", F.lit(len(cols)).cast("long"))
    out = rows.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(duplicate_count(df, cols)))
    out = out.withColumn("duplicate_rate", F.col("duplicate_count") / F.greatest(F.col("row_count"), F.lit(1)))
    if categorical:
        issues = case_issues(df, categorical).agg(F.count(F.lit(1)).alias("case_issue_columns"))
        return out.crossJoin(F.broadcast(issues))
    return out.withColumn("case_issue_columns", F.lit(0).cast("long"))


def quality_gate(df: DataFrame, max_null: float = 0.85) -> DataFrame:
    """Columns too empty to analyse, first in table order; no row means the table passes."""
    return null_rates(df).where(F.col("null_rate") > max_null).select("column", "ordinal", "null_rate")


def dataset_summary(df: DataFrame, roles: DataFrame, numeric=(), categorical=()) -> DataFrame:
    """Roles, null and distinct counts, samples if the roles have them, profile, table shape and table quality; one row
    per column."""
    shape = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("col_count", F.lit(len(df.columns)).cast("long"))
    out = roles
    if numeric or categorical:
        profile = field_profile(df, numeric, categorical).drop("unique_count", "kind")
        out = roles.join(F.broadcast(profile), "column", "left")
    quality = data_quality(df, categorical).select("overall_null_rate", "columns_with_nulls", "duplicate_count", "duplicate_rate")
    return out.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(quality))
