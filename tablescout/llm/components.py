"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import settle


def representatives(edges: DataFrame) -> DataFrame:
    """Representative of each node that has a link: ``node``, ``label``, both long; ``edges`` has a and b.

    Contraction: in every round each node joins that of its neighbours, or itself, which is first in an order of the
    round, and links between joined nodes become links of their representatives. Every other round, the first one
    too, goes by the number of links, most first, which makes one node of a star; the others go by an order drawn
    anew. Whatever the shape of the graph, a drawn order leaves a constant share of the nodes at most, so rounds grow
    with the logarithm. Labels are then handed back through the rounds. Nothing of the graph goes to the driver but
    the number of links in a round.
    """
    links = settle(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    )
    rounds: list[DataFrame] = []
    while links.settled_rows:
        turn = F.lit(len(rounds))
        order = lambda c, few: F.struct(few, F.xxhash64(F.col(c), turn).alias("h"), F.col(c).alias("v"))
        if len(rounds) % 2:
            none = F.lit(0).cast("long").alias("few")
            least = links.groupBy("a").agg(F.min(order("b", none)).alias("least"), F.first(none).alias("few"))
        else:
            degrees = settle(links.groupBy("a").agg((-F.count(F.lit(1))).alias("few")))
            of_b = degrees.withColumnRenamed("a", "b")
            least = links.join(of_b, "b").groupBy("a").agg(F.min(order("b", F.col("few"))).alias("least"))
            least = least.join(degrees, "a")
        joined = settle(
            least.select(F.col("a").alias("node"), F.least("least", order("a", F.col("few")))["v"].alias("label"))
        )
        rounds.append(joined)
        half = links.join(joined, links.a == joined.node).select(F.col("label").alias("a"), "b")
        half = half.distinct()
        links = settle(
            half.join(joined, half.b == joined.node).select("a", F.col("label").alias("b")).where("a != b").distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = settle(
            rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        )
    return labels
