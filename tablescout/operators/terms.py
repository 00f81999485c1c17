"""Words of texts: how many texts hold them, how much they say of a text, and what sets groups of texts apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.session import materialize

#: A term is a run of letters and digits, lower-cased.
TERM = r"[\p{L}\p{N}]+"


#: Most terms whose numbers go to all tasks, some 50 MB; more meet the rows of texts in a shuffle by term.
VOCABULARY = 500_000


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n``: how often each text has each of its terms; a text with one word a million times is one row."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(words).alias("term"))
    return rows.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``term, documents, occurrences``."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


def term_weights(df: DataFrame, key: str, text: str, min_documents: int = 2, max_share: float = 0.5) -> DataFrame:
    """``key, term, n, weight``: sparse rows of unit length, n ln(N / documents) over the norm of the text.

    N counts the texts that have terms. Terms of fewer than ``min_documents`` texts, or of more than ``max_share`` of them,
    are left out. Those in most texts, few by number as texts have so many terms only, go to all tasks and are dropped
    before anything is shuffled by term, so that what is shuffled has no term of more than that share. Up to ``VOCABULARY``
    terms go to all tasks, and nothing is shuffled by term.
    """
    counts = materialize(term_counts(df, key, text))
    # Texts that have a term are seen without their counts.
    total = df.where(F.col(key).isNotNull() & F.col(text).rlike(TERM)).agg(F.count_distinct(key).alias("texts"))
    n = total.first()["texts"]
    found = materialize(document_frequencies(counts))
    common = found.where(F.col("documents") > max_share * n).select("term")
    kept = found.where((F.col("documents") >= min_documents) & (F.col("documents") <= max_share * n))
    kept = kept.select("term", F.log(F.lit(float(max(n, 1))) / F.col("documents")).alias("_says"))
    if kept.count() <= VOCABULARY:
        rows = counts.join(F.broadcast(kept), "term")
    else:
        # Terms of more than a share s of the texts number 1 / s times the mean number of terms in a text at most.
        rows = counts.join(F.broadcast(common), "term", "left_anti").join(kept, "term")
    rows = rows.withColumn("_w", F.col("n") * F.col("_says"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("key")))
    return rows.select("key", "term", "n", F.when(norm > 0, F.col("_w") / norm).otherwise(0.0).alias("weight"))


def top_terms(weights: DataFrame, count: int = 5) -> DataFrame:
    """``key, rank, term, weight``: the terms that say most of each text; equal ones in their order."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("weight"), "term"))
    return weights.select("key", rank.alias("rank"), "term", "weight").where(F.col("rank") <= count)


def group_terms(weights: DataFrame, groups: DataFrame, key: str, group: str, count: int = 5) -> DataFrame:
    """``group, rank, term, weight, similarity``: terms by the mean weight in the texts of a group, and how near a term's row
    of groups is to that of the group alone (1: in no other)."""
    named = groups.select(F.col(key).alias("key"), F.col(group).alias("group")).where("key IS NOT NULL AND group IS NOT NULL")
    sizes = named.groupBy("group").agg(F.count(F.lit(1)).alias("_size"))
    sums = weights.join(named, "key").groupBy("group", "term").agg(F.sum("weight").alias("_sum"))
    means = sums.join(sizes, "group").select("group", "term", (F.col("_sum") / F.col("_size")).alias("weight"))
    means = materialize(means)
    norms = means.groupBy("term").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("weight"), "term"))
    best = means.withColumn("rank", rank).where(F.col("rank") <= count)
    return best.join(norms, "term").select("group", "rank", "term", "weight", F.when(F.col("_norm") > 0, F.col("weight") / F.col("_norm")).alias("similarity"))


def text_similarity(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, similarity``: cosine of the weights of given pairs of texts, 0 if they share no term."""
    rows = pairs.select("a", "b").distinct()
    of_a = rows.join(weights.select(F.col("key").alias("a"), "term", F.col("weight").alias("_x")), "a")
    both = of_a.join(weights.select(F.col("key").alias("b"), "term", F.col("weight").alias("_y")), ["b", "term"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_dot"))
    return rows.join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("_dot", F.lit(0.0)).alias("similarity"))
