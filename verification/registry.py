"""Every operator as a query over the driver tables, next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.columns import rounded
from tablescout.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a query under ``name``; floats are rounded as the SQL rounds them."""

    def wrap(function):
        QUERIES[name] = lambda spark, folder: rounded(function(Tables(spark, folder)), digits)
        if sql is not None:
            SQL[name] = sql
        return function

    return wrap


class Tables:
    """``tables.lineitem`` reads that table of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def gappy(self) -> DataFrame:
        """Line items with zero discounts and taxes, and the quantities of returned items, taken as missing."""
        blank = lambda c, when: F.when(~when, F.col(c))
        df = self.lineitem
        return df.select(
            *LINE_ORDER,
            "l_shipdate",
            "l_returnflag",
            blank("l_quantity", F.col("l_returnflag") == "R").alias("quantity"),
            "l_extendedprice",
            blank("l_discount", F.col("l_discount") == 0).alias("discount"),
            blank("l_tax", F.col("l_tax") == 0).alias("tax"),
        )


GAPPY = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity, l_extendedprice,
  CASE WHEN l_discount <> 0 THEN l_discount END AS discount,
  CASE WHEN l_tax <> 0 THEN l_tax END AS tax FROM lineitem)"""


def long_sql(table: str, cols, extra: str = "") -> str:
    """A subquery ``"column", v`` of several numeric columns."""
    return "(" + " UNION ALL ".join(f"""SELECT {extra}'{c}' AS "column", CAST({c} AS DOUBLE) AS v FROM {table}""" for c in cols) + ")"


def text_sql(table: str, cols, extra: str = "") -> str:
    return "(" + " UNION ALL ".join(f"""SELECT {extra}'{c}' AS "column", CAST({c} AS VARCHAR) AS v FROM {table}""" for c in cols) + ")"
