"""Near copies by SimHash fingerprints, with pigeonring filtering of the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.common import if_small, in_batches, query, row_key, settle, table
from tablescout.llm.components import representatives

#: Bits at which linked fingerprints may differ.
RADIUS = 2
#: The segments of the ring: first bit and number of bits. One more than the radius, so one segment always agrees.
RING = [(0, 21), (21, 21), (42, 22)]
#: Fingerprints with one value of a segment that are compared pair by pair; more are linked through midpoints.
SEGMENT_ROWS = 16
#: A full segment's rows are spread over so many tasks.
SALTS = 32
#: Shingles whose bits are counted at once.
BLOCK = 65_536
SHINGLE_WORDS, SEED = 3, 42


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of a text in UTF-8; 0 without words.

    bytes.lower() changes A-Z alone, and bytes.split() cuts at the six characters of ASCII white space.
    """
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(plain, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    first, last = starts[:-SHINGLE_WORDS].tolist(), (starts[SHINGLE_WORDS:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(plain[i:j], SEED) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its fingerprint ``fp``, the 64 bits as a long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(in_batches(run), f"doc_id {kind}, fp long")


def differing(a: str, b: str, bits: int | None = None) -> Column:
    """Number of differing bits, of those in the mask if one is given."""
    both = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(both if bits is None else both.bitwiseAND(F.lit(signed(bits))))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def mask(part: int) -> int:
    start, width = RING[part % len(RING)]
    return ((1 << width) - 1) << start


def linked_pairs(nodes: DataFrame) -> DataFrame:
    """Links a, b that join all of the distinct fingerprints ``fp`` within the radius, directly or through others.

    Pigeonring: two fingerprints that differ in at most 2 of 64 bits have a segment of the three in a ring from which
    the differences of the chain that starts there stay, for every length l, within 2 * l / 3: none in the first
    segment, at most one in the first two, two in all. So candidates are fingerprints that agree in a segment, those
    whose chain leaves its budget go, and the rest is checked over all bits.

    A segment value that more than 16 fingerprints share would make a list of all pairs. Its fingerprints are instead
    each sent to themselves and to all values one bit away outside the segment. Fingerprints that meet are within two
    bits of each other, and any two within two bits meet, so linking all that meet to the smallest loses no link, at
    44 rows for a fingerprint.
    """
    ring = nodes.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask(i)))).alias("segment"))
                    for i in range(len(RING))
                )
            )
        ).alias("s"),
    ).select("fp", "s.*")
    sizes = ring.groupBy("part", "segment").agg(F.count("*").alias("n"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    full = settle(sizes.where(F.col("n") > SEGMENT_ROWS).select("part", "segment", F.lit(True).alias("full"), spread))
    ring = ring.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    ring = settle(ring.join(full, ["part", "segment", "salt"], "left"))

    groups = ring.where("full IS NULL").groupBy("part", "segment").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    groups = groups.where(F.size("fps") > 1)
    pairs = groups.select("part", F.posexplode("fps").alias("at", "a"), "fps").select(
        "part", "a", F.explode(F.slice("fps", F.col("at") + 2, SEGMENT_ROWS)).alias("b")
    )
    in_budget = F.lit(False)
    for i in range(len(RING)):
        chain, fits = mask(i), F.col("part") == i
        for length in range(2, len(RING) + 1):
            chain |= mask(i + length - 1)
            fits &= differing("a", "b", chain) <= RADIUS * length // len(RING)
        in_budget |= fits
    close = pairs.where(in_budget).where(differing("a", "b") <= RADIUS).select("a", "b")

    def midpoints(part: int) -> Column:
        start, width = RING[part]
        flips = [0] + [signed(1 << i) for i in range(64) if not start <= i < start + width]
        return F.transform(F.array(*map(F.lit, flips)), lambda flip: F.col("fp").bitwiseXOR(flip))

    meet = F.when(F.col("part") == 0, midpoints(0)).when(F.col("part") == 1, midpoints(1)).otherwise(midpoints(2))
    met = ring.where("full").select("part", "fp", F.explode(meet).alias("middle"))
    met = met.groupBy("part", "middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    through = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return close.union(through).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each document and the smallest doc_id that its links reach.

    Texts are reduced to fingerprints where they are read; links are found between distinct fingerprints, so copies
    cost nothing, and the groups are connected by contraction. Null, empty and blank texts have fingerprint zero, and
    are linked like any other. Repeated rows are returned as often as they occur; a group whose identifiers are all
    missing has no component_id. Further columns are not looked at.

    Returns doc_id, fp (long), component_id.
    """
    members = settle(fingerprints(docs, doc_id, text))
    nodes = settle(members.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = representatives(linked_pairs(nodes))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = settle(named.select("fp", "first_id", F.coalesce("label", "fp").alias("label")))
    groups = settle(named.groupBy("label").agg(F.min("first_id").alias("component_id")))
    named = settle(named.select("fp", "label").join(groups, "label").select("fp", "component_id"))
    return members.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document that gives each group of near copies its component_id; repeated rows of it stay once.

    Groups without any identifier keep all their rows, as none of them can be named. Columns are those of ``docs``.
    """
    found = near_groups(docs)
    kept = settle(found.where("doc_id = component_id").select("doc_id").distinct())
    numbered = docs.join(kept, "doc_id", "left_semi").select(
        *(docs[c] for c in docs.columns),
        F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY text)").alias("__nth"),
    )
    return numbered.where("__nth = 1").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """Keys ``k`` of rows that :func:`near_groups` links to one before them, and the key ``of`` of the first in their group.

    That is the row with the smallest doc_id, then the smallest key of doc_id and text; rows without doc_id come last.
    """
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), row_key().alias("k"))
    found = near_groups(docs.select(order.alias("row"), "text"), "row")
    return settle(found.where("doc_id <> component_id").select("doc_id.k", F.col("component_id.k").alias("of")).distinct())


def keep_one_of_near_fingerprints(docs: DataFrame) -> DataFrame:
    """Of the rows that :func:`near_groups` links, the first one as in :func:`near_fingerprints`.

    A repeated row stays as often as it is there. Columns are those of ``docs``, whatever their names. Texts do not
    move: what goes is told by the keys of rows.
    """
    goes = if_small(near_fingerprints(docs)).select("k")
    names = list(docs.columns)
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), row_key().alias("k"))
    return own.join(goes, "k", "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
