"""Mixing sources to target weights along a curriculum that changes with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.llm.common import id_text, query, settle, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix over words of all documents, and how often a source may be used up.
SHARE, MOST = 1.5, 2
#: A source's share of the mix while training goes from 0 to 1: (start, end), by place in WEIGHTS. The heavy sources
#: come early, the light ones late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Leading hexadecimal digits of the shuffled order by which a source is cut into blocks.
BLOCK_DIGITS = 3
#: Columns that the mix adds.
MIXED = ("position", "pass", "words", "whole")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """Words to take from each source: one row per source from rows of source and size.

    Sources share ``share`` of all words by weight, no source gives more than ``most`` times its words, and what is
    over goes to the others by weight. With sources in the order of that limit over their weight, the level at which
    the rest fits is found by running totals instead of rounds. Only the table of sources passes through one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sources.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") + 1).cast("int"))
    )
    limit = (F.col("source_size") * most).cast("double")
    by_level = W.orderBy("room", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumns({"limit": limit, "room": limit / F.col("weight")})
    ranked = ranked.withColumns(
        {
            "level": (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        }
    )
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least("limit", level * F.col("weight"))).select(
        "source", "place", "source_size", F.coalesce("target", F.lit(0.0)).alias("target")
    )


def with_passes(docs: DataFrame, passes: int = MOST) -> DataFrame:
    """Add source_size, target, place, ``start`` (words of the source before this document) and ``takes``, the words
    that each pass over the source takes from the document. ``docs`` needs doc_id, source and size.

    Each source is shuffled by the md5 of the doc_id. Its first digits cut the source into blocks, so the words before
    a document are those of earlier blocks, a running total over a small table, and those before it in its block: a
    source that holds most rows is worked on by as many tasks as it has blocks.
    """
    order = F.md5(id_text("doc_id").cast("binary"))
    sized = docs.withColumns({"order": order, "block": F.substring(order, 1, BLOCK_DIGITS)})
    # One text for source and block: a pair would be cast before the join where one side may be null, and moved again.
    cell = F.concat("block", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    blocks = settle(sized.groupBy("source", "block").agg(F.sum("size").alias("size")))
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("earlier", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    targets = source_targets(blocks).withColumnRenamed("source", "of")
    blocks = blocks.join(targets, F.col("source").eqNullSafe(F.col("of")))
    blocks = settle(blocks.select(cell.alias("cell"), "earlier", "place", "source_size", "target"))

    within = W.partitionBy("cell").orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("cell", cell)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(blocks, "cell").withColumn("start", F.col("start") + F.col("earlier"))
    demand = F.floor("target")
    takes = [
        F.greatest(F.lit(0), F.least(F.col("size"), demand - F.col("start") - F.col("source_size") * turn))
        for turn in range(passes)
    ]
    return placed.withColumn("takes", F.array(*takes)).drop("cell", "order", "block", "earlier")


def position(turn: Column | int, takes: Column, schedules=SCHEDULES) -> Column:
    """Time between 0 and 1 at which the middle of a document's words is due.

    A source's weight goes from a to b in a straight line, so by time t it has been asked for the share
    (a t + (b - a) t^2 / 2) / ((a + b) / 2) of its target. The inverse of that at the words before is the time.
    """
    middle = F.col("start") + F.col("source_size") * turn + takes / F.lit(2.0)
    due = middle / F.col("target")
    a, b = (F.element_at(F.array(*(F.lit(s[i]) for s in schedules)), (F.col("place") + 1).cast("int")) for i in (0, 1))
    area = due * (a + b) / 2
    # The root of a t + (b - a) t^2 / 2 = area in the form that also holds for a constant weight.
    return F.when(takes > 0, (area * 2) / (a + F.sqrt(a * a + (b - a) * area * 2)))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus, in training order: rows of ``docs`` with ``position``, ``pass``, the ``words`` taken and
    whether those are the ``whole`` document.

    Needs doc_id, source and text. A document is there once for each pass that takes words from it; where a source's
    target ends inside a document, the copy ends after the words taken. Documents without words, null texts among
    them, give nothing to take. A null source is a source, the last; repeated rows are documents of their own;
    further columns are kept.
    """
    names = list(docs.columns)
    own = {c: f"c{i}" for i, c in enumerate(names)}
    inner = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in own.items()), "doc_id", "source", word_count("text").alias("size"))
    copies = with_passes(inner).select("*", F.posexplode("takes").alias("pass", "words")).where("words > 0")
    text, whole = own["text"], F.col("words") == F.col("size")
    copies = copies.withColumns(
        {
            "position": position(F.col("pass"), F.col("words")),
            "whole": whole,
            text: F.when(whole, F.col(text)).otherwise(first_words(text, "words")),
        }
    )
    copies = copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return copies.select(*(F.col(o).alias(c) for c, o in own.items() if c not in MIXED), *MIXED)


def first_words(text: str, n: str) -> Column:
    """The text up to the end of its n-th word, white space as it was."""
    ends = F.expr(rf"slice(regexp_extract_all({text}, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, int({n}))")
    return F.array_join(ends, "")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][place + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
q AS (SELECT *, cap / weight AS room FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM q)::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM q)
      - coalesce(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM q),
t AS (SELECT *, least(cap, weight * (SELECT arg_min(level, room) FROM l WHERE level <= room)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.place, floor(t.target)::BIGINT AS demand,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, greatest(0, least(size, demand - start)) AS one, greatest(0, least(size, demand - start - source_size)) AS two,
    [1.5::DOUBLE, 1.0, 0.5][place + 1] AS a, [0.5::DOUBLE, 1.0, 1.5][place + 1] AS b FROM p),
v AS (SELECT *, CASE WHEN one > 0 THEN (start + one / 2.0::DOUBLE) / target * (a + b) / 2 END AS area,
    CASE WHEN two > 0 THEN (start + source_size + two / 2.0::DOUBLE) / target * (a + b) / 2 END AS later FROM u)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  round(area * 2 / (a + sqrt(a * a + (b - a) * area * 2)), 6) AS first_position,
  round(later * 2 / (a + sqrt(a * a + (b - a) * later * 2)), 6) AS second_position FROM v
"""


@query("op5_mixing", MIX_SQL)
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    placed = with_passes(settle(docs.select("doc_id", "source", word_count("text").alias("size"))))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, b: a + b)
    first, second = (position(turn, F.col("takes")[turn]) for turn in range(MOST))
    # In training order of the documents, those that are not taken at last.
    ordered = placed.withColumns({"first_position": first, "second_position": second, "taken": taken, "due": F.coalesce(first, F.lit(2.0))})
    ordered = ordered.repartitionByRange("due", "doc_id").sortWithinPartitions("due", "doc_id")
    rounded = [F.round(c, 6).alias(c) for c in ("first_position", "second_position")]
    return ordered.select("doc_id", "size", "source_size", "target", "taken", *rounded)
