"""Exact copies by a tree merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import query, settle, table

#: How many runs one round merges into one, and hexadecimal digits of the digest by which every merge is cut into ranges.
FAN_IN, CUT_DIGITS = 16, 2

DIGEST = ["digest", "check", "n_bytes"]


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``: digests of its text without white space, its length, and its run, which is the
    partition that read it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.char_length(whole).cast("long").alias("n_points"),
        F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "").alias("plain"),
    )
    return rows.select(
        "doc_id",
        "n_points",
        F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"),
        # A second digest and the length verify the first: texts meet only if all three agree.
        F.xxhash64("plain").alias("check"),
        F.octet_length("plain").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """Every ``fan_in`` neighbouring runs become one; each text keeps its best row and the number of its rows.

    The runs of a merge meet range by range of the digest, are sorted by it, and equal digests that follow each other
    are verified and become one row, so that a merge is the work of as many tasks as there are ranges.
    """
    dealt = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("cut", "run")
    return dealt.sortWithinPartitions("cut", "run", *DIGEST).groupBy("cut", "run", *DIGEST).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group rows whose texts are identical without their white space.

    Each partition of the table becomes a run: one row for each digest with its best row and count, combined where the
    rows are read. In rounds every 16 neighbouring runs are merged into one, range by range of the digest, until one
    is left, so a text with any number of copies is at most 16 rows in any merge. The survivors then go down to their
    runs and from there to their rows. Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.

    Null and empty texts are equal to each other and to blank texts. Missing identifiers come after all others, and
    of rows repeated with one identifier one is kept. Further columns of ``docs`` are not looked at.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = settle(digest_rows(docs, doc_id, text))
    best = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    cut = F.substring(F.hex("digest"), 1, CUT_DIGITS).alias("cut")
    runs = settle(rows.groupBy(*DIGEST, cut, "run").agg(F.min(best).alias("best"), F.count("*").alias("n")))
    merged, left = runs, (runs.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        merged, left = merge_runs(merged, FAN_IN), -(-left // FAN_IN)
    merged = settle(merged.select(*DIGEST, "best", "n"))
    by_run = settle(runs.select(*DIGEST, "run").join(merged, DIGEST))
    found = rows.join(by_run, [*DIGEST, "run"])
    return found.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))
