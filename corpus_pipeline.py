"""From raw documents to packed training rows, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import settle, table
from tablescout.llm.decontamination import clean_documents
from tablescout.llm.mixing import mix
from tablescout.llm.packing import pack, written_place
from tablescout.llm.quality import good_documents
from tablescout.llm.shingles import keep_one_of_near_copies
from tablescout.llm.simhash import near_fingerprints


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more, all columns as they are."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are joined by near copies the one with the smallest doc_id.

    Near copies are documents whose SimHash fingerprints link, and, as fingerprints of two bits leave copies in that
    have more changes, those with a Jaccard similarity of 5-word shingles of 0.8 or more. Links of both kinds make one
    graph: a copy that goes by its fingerprint still joins those that are like it by their shingles.
    """
    return keep_one_of_near_copies(docs, near_fingerprints(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets, in training order; a document is there once for each pass that takes words.

    A copy that a target ends in is cut after its last word, and its n_chars, if there are any, are counted anew.
    """
    names = list(docs.columns)
    # Other columns go through under names that the mix does not use itself.
    other = {c: f"c{i}" for i, c in enumerate(names) if c not in ("doc_id", "source", "text")}
    mixed = mix(docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(o) for c, o in other.items())))
    out = {c: F.col(other.get(c, c)) for c in names}
    if "n_chars" in other:
        anew = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("whole"), out["n_chars"]).otherwise(anew)
    return mixed.select(*(c.alias(name) for name, c in out.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of all documents, packed into rows of one length; shards are numbered in training order."""
    return pack(docs, place=written_place(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID packing", packing),
]

#: Learned scores and token identifiers are nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
