"""Patterns, near-duplicate values and co-occurring labels in string columns."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescout.functions.columns import ratio
from tablescout.plans.counts import category_counts, pair_counts
from tablescout.session import materialize

# The text patterns looked for, by name.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\+?[\d\s\-\(\)]{7,15}",
    "url": r"https?://\S+",
    "date_string": r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}",
    "currency": r"[\$€£¥]\s?\d+[\d,.]*",
    "postal_code": r"\b\d{5}(-\d{4})?\b",
}

_BLANKS = " \t\n\r\f\x0b"


def pattern_counts(df: DataFrame, cols) -> DataFrame:
    """``column, pattern, match_count, match_pct`` of values holding each pattern; one scan, no shuffle of text."""
    cols = list(cols)
    counts = [F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)]
    rows = []
    for i, c in enumerate(cols):
        for name, pattern in PATTERNS.items():
            counts.append(F.count_if(F.col(c).cast("string").rlike(pattern)).alias(f"_{name}{i}"))
            rows.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(name).alias("pattern"),
                    F.col(f"_{name}{i}").alias("match_count"),
                    ratio(F.col(f"_{name}{i}"), F.col(f"_n{i}")).alias("match_pct"),
                )
            )
    return df.agg(*counts).select(F.inline(F.array(*rows))).where(F.col("match_count") > 0)


def _slack(length, min_sim: float):
    """Edits allowed for a longer string of this length; the tiny addition undoes float loss in the product."""
    return F.floor(length * F.lit(1.0 - min_sim) + F.lit(1e-9)).cast("int")


# Most shortened forms of one value that are made; longer values meet by pieces instead.
SHORTENED = 2_000
# An odd number and its inverse in arithmetic modulo 2**64, for hashes of shortened forms.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _edits(length: int, min_sim: float) -> int:
    return math.floor(length * (1.0 - min_sim) + 1e-9)


def _shortened_limit(min_sim: float) -> int:
    """The longest length whose values, shortened by as many characters as they may have edits, have few enough forms."""
    length = 0
    while length < SHORTENED and sum(math.comb(length + 1, r) for r in range(_edits(length + 1, min_sim) + 1)) <= SHORTENED:
        length += 1
    return length


def _shortened(texts: list[str], edits: int) -> np.ndarray:
    """Hashes of all forms of equally long texts without up to ``edits`` of their characters, a row each.

    A form is hashed as a polynomial of its characters; what lies behind r left-out ones is r powers too high.
    """
    size = len(texts[0])
    codes = np.array([[ord(c) for c in t] for t in texts], np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    powers = np.array([pow(_BASE, i, 1 << 64) for i in range(size)], np.uint64)
    sums = np.zeros((len(texts), size + 1), np.uint64)
    sums[:, 1:] = np.cumsum(codes * powers, axis=1, dtype=np.uint64)
    out = []
    for r in range(min(edits, size) + 1):
        gone = np.array(list(itertools.combinations(range(size), r)), np.int64).reshape(math.comb(size, r), r)
        total = np.zeros((len(texts), len(gone)), np.uint64)
        for i in range(r + 1):
            start = gone[:, i - 1] + 1 if i else np.zeros(len(gone), np.int64)
            stop = gone[:, i] if i < r else np.full(len(gone), size)
            total += (sums[:, stop] - sums[:, start]) * np.uint64(pow(_INVERSE, i, 1 << 64))
        out.append(total)
    return np.concatenate(out, axis=1)


def shortened_forms(values: DataFrame, min_sim: float) -> DataFrame:
    """``_id, _form`` from ``_id, key``: hashes of each key without as many characters as it may have edits, or fewer."""

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, alike in frame.groupby(frame["key"].map(len)):
                for at in range(0, len(alike), 1_000):
                    part = alike.iloc[at : at + 1_000]
                    found = _shortened(part["key"].tolist(), _edits(int(size), min_sim))
                    yield pd.DataFrame({"_id": np.repeat(part["_id"].to_numpy(), found.shape[1]), "_form": found.ravel().view(np.int64)})

    return values.select("_id", "key").mapInPandas(forms, "_id long, _form long")


def _meet_shortened(values: DataFrame, min_sim: float) -> DataFrame:
    """``_a, _b``: different values that are equal without as many characters as they may have edits, each pair once.

    An edit leaves out a character of one or of both strings, so strings within their edits have a form in common. What
    many values share, as a host or an ending, is no meeting place, so values of one host are not compared pair by pair.
    """
    forms = shortened_forms(values, min_sim)
    own = forms.select("_form", F.col("_id").alias("_a"))
    return own.join(forms.select("_form", F.col("_id").alias("_b")), "_form").where("_a < _b").select("_a", "_b").distinct()


def near_duplicate_values(df: DataFrame, cols, min_sim: float = 0.8) -> DataFrame:
    """``column, value_a, value_b, similarity``: different values at least ``min_sim`` alike by edit distance.

    Exact without comparing all pairs. Values that have at most ``SHORTENED`` forms without as many characters as they may
    have edits meet by equality of forms. Of longer ones, the longer string is cut into one more piece than it may have
    edits, and one piece must survive, nearly in place, in the shorter string; pieces are joined on equality. Only pairs that
    share a form or a piece are measured.
    """
    values = (
        category_counts(df, cols)
        .select("column", "value", F.lower(F.btrim("value", F.lit(_BLANKS))).alias("key"))
        .withColumn("len", F.length("key"))
        .where(F.col("len") > 0)
    )
    # A value is short and its forms are many, so the values are dealt over all tasks.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = materialize(values.repartition(tasks, "value").withColumn("_id", F.monotonically_increasing_id()))
    limit = _shortened_limit(min_sim)
    side = lambda name: values.select(F.col("_id").alias(f"_{name}"), *[F.col(c).alias(f"_{c}_{name}") for c in ("column", "value", "key", "len")])
    pairs = _meet_shortened(values.where(F.col("len") <= limit), min_sim).join(side("a"), "_a").join(side("b"), "_b")
    a_longer = F.col("_len_a") >= F.col("_len_b")
    by_forms = pairs.where((F.col("_column_a") == F.col("_column_b")) & (F.col("_key_a") != F.col("_key_b"))).select(
        F.col("_column_a").alias("column"),
        F.when(a_longer, F.col("_value_a")).otherwise(F.col("_value_b")).alias("long_value"),
        F.when(a_longer, F.col("_value_b")).otherwise(F.col("_value_a")).alias("short_value"),
        F.when(a_longer, F.col("_key_a")).otherwise(F.col("_key_b")).alias("long_key"),
        F.when(a_longer, F.col("_key_b")).otherwise(F.col("_key_a")).alias("short_key"),
        F.greatest("_len_a", "_len_b").alias("long_len"),
        _slack(F.greatest("_len_a", "_len_b"), min_sim).alias("_k"),
    )
    k = _slack(F.col("len"), min_sim)
    pieces = (
        values.withColumn("_k", k)
        .where((F.col("_k") >= 1) & (F.col("len") > limit))
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
        .withColumn("_from", F.floor(F.col("_i") * F.col("len") / (F.col("_k") + 1)).cast("int"))
        .withColumn("_to", F.floor((F.col("_i") + 1) * F.col("len") / (F.col("_k") + 1)).cast("int"))
        .select(
            "column",
            F.col("value").alias("long_value"),
            F.col("key").alias("long_key"),
            F.col("len").alias("long_len"),
            "_k",
            "_i",
            F.expr("substring(key, _from + 1, _to - _from)").alias("piece"),
        )
    )
    longest = F.floor(F.col("len") / F.lit(min_sim) + F.lit(1e-9)).cast("int")
    probes = (
        values.where(longest > limit)
        .withColumn("long_len", F.explode(F.sequence(F.greatest(F.col("len"), F.lit(limit + 1)), longest)))
        .withColumn("_k", _slack(F.col("long_len"), min_sim))
        .where(F.col("_k") >= 1)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
        .withColumn("_from", F.floor(F.col("_i") * F.col("long_len") / (F.col("_k") + 1)).cast("int"))
        .withColumn("_to", F.floor((F.col("_i") + 1) * F.col("long_len") / (F.col("_k") + 1)).cast("int"))
        .withColumn("_last", F.least(F.col("_from") + F.col("_k"), F.col("len") - (F.col("_to") - F.col("_from"))))
        .withColumn("_first", F.greatest(F.lit(0), F.col("_from") - F.col("_k")))
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("_at", F.explode(F.sequence("_first", "_last")))
        .select(
            "column",
            "long_len",
            "_i",
            F.expr("substring(key, _at + 1, _to - _from)").alias("piece"),
            F.col("value").alias("short_value"),
            F.col("key").alias("short_key"),
            F.col("len").alias("short_len"),
        )
        .distinct()
    )
    met = pieces.join(probes, ["column", "long_len", "_i", "piece"]).where(
        (F.col("long_key") != F.col("short_key"))
        & ((F.col("short_len") < F.col("long_len")) | (F.col("short_value") < F.col("long_value")))
    )
    met = met.select(by_forms.columns).unionByName(by_forms)
    measured = met.withColumn("_d", F.expr("levenshtein(long_key, short_key, _k)")).where(F.col("_d") >= 0)
    return (
        measured.select(
            "column",
            F.least("long_value", "short_value").alias("value_a"),
            F.greatest("long_value", "short_value").alias("value_b"),
            (1 - F.col("_d") / F.col("long_len")).alias("similarity"),
        )
        .distinct()
    )


def co_occurrence(df: DataFrame, cols, per_pair: int | None = None, min_pct: float = 0.05, top: int | None = None) -> DataFrame:
    """``col_a, val_a, col_b, val_b, cnt, pct`` of each column pair's frequent combinations, all or the first."""
    best = Window.partitionBy("pair_order").orderBy(F.col("cnt").desc(), "val_a", "val_b")
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    # At most 1 / min_pct combinations of a pair are frequent enough, so the order is among few rows.
    frequent = (
        pair_counts(df, cols)
        .crossJoin(F.broadcast(rows))
        .withColumn("pct", F.col("cnt") / F.col("_rows"))
        .where(F.col("pct") > min_pct)
        .withColumn("_r", F.row_number().over(best))
    )
    if per_pair:
        frequent = frequent.where(F.col("_r") <= per_pair)
    frequent = frequent.orderBy("pair_order", "_r")
    return (frequent.limit(top) if top else frequent).select("col_a", "val_a", "col_b", "val_b", "cnt", "pct")
