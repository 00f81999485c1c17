"""Reading, settling and batching shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablescout.session import ensure_checkpoint_dir

#: Rows that an operator works on at once; with texts of some kilobytes they have a few megabytes.
BATCH_ROWS = 400

#: Rows of some tens of bytes that may go to all tasks.
BROADCAST_ROWS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, folder)`` as the query ``name``, with the SQL of the same rows if there is one."""

    def wrap(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_batches(run, rows: int = BATCH_ROWS):
    """``run`` for mapInArrow, which gets at most so many rows at once.

    Spark's batches hold up to 10,000 rows or 64 megabytes; cutting them in the worker leaves the session as it is.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))

    return each


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Later plans read the same rows after any retry, without computing them again. The folder goes when the
    application ends. The rows are counted as they are written, so no later job has to: ``settled_rows``. Each job
    leaves something in the driver's memory.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    settled = spark.read.schema(df.schema).parquet(folder)
    settled.settled_in, settled.settled_rows = folder, written.get["rows"]
    return settled


def forget(settled: DataFrame) -> None:
    """Delete a table of :func:`settle` that nothing reads any more."""
    context = settled.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(settled.settled_in)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, all of them narrow; else as it is."""
    known = getattr(df, "settled_rows", None)
    return F.broadcast(df) if (df.limit(rows + 1).count() if known is None else known) <= rows else df


def id_text(doc_id: str | Column) -> Column:
    """An identifier as text; a missing one counts as empty."""
    return F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the identifier's text modulo ``divisor``."""
    return F.crc32(id_text(doc_id).cast("binary")) % divisor


def field(value: str | Column) -> Column:
    """A value as text that tells where it ends: its bytes, a colon and itself; ``-`` if it is missing."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_key() -> Column:
    """128 bits of a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(field("doc_id"), field("text")).cast("binary")))
