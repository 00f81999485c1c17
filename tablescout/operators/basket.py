"""Itemsets that often occur together, and rules between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.columns import ratio, union_all
from tablescout.session import materialize


def itemsets(df: DataFrame, basket: str, item: str, min_count: int = 2, max_size: int = 3) -> DataFrame:
    """``items, size, support_count, support, n_baskets`` of all sets of up to ``max_size`` items that occur together in
    ``min_count`` baskets or more; ``items`` is sorted.

    Each basket becomes its items of ``min_count`` rows or more in one order, rarest first, and equal baskets become one row
    with their number; baskets of rarer items only are counted with no items. Sets grow by one item a round: a row holds a
    set and what follows it in a basket, rows that agree in both are merged, and sets below ``min_count`` end. As an item is
    only followed by more frequent ones, an item in most baskets has next to nothing behind it, and the many rows of a
    frequent set are counted where they lie, so no set or item is the work of one task.

    Rows without basket or item are left out; an item that is repeated in a basket counts once.
    """
    pairs = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    # Rows of an item bound its baskets from above; they only set the order and leave out items that cannot be frequent.
    heads = materialize(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    ranked = pairs.join(heads, "item", "left").select("basket", F.when(F.col("n").isNotNull(), F.struct("n", "item")).alias("_held"))
    rows = ranked.groupBy("basket").agg(F.sort_array(F.collect_set("_held")).alias("_set"))
    rows = materialize(rows.groupBy("_set").agg(F.count(F.lit(1)).alias("times")))
    total = rows.agg(F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("n_baskets"))
    rows = rows.select(F.expr("slice(array(_set[0].item), 1, 0)").alias("items"), F.col("_set").alias("rest"), "times")
    found = []
    for size in range(1, max_size + 1):
        grown = rows.select("items", F.posexplode("rest").alias("at", "next"), "rest", "times").select(
            F.concat("items", F.array("next.item")).alias("items"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
            "times",
        )
        frequent = materialize(
            grown.groupBy("items").agg(F.sum("times").alias("support_count")).where(F.col("support_count") >= min_count)
        )
        found.append(frequent)
        if size == max_size or frequent.isEmpty():
            break
        ongoing = grown.where(F.size("rest") > 0)
        # Where no item is repeated in a basket, all items that are left are frequent.
        if size > 1 or frequent.count() < heads.count():
            ongoing = ongoing.join(frequent.select("items"), "items", "left_semi")
        rows = materialize(ongoing.groupBy("items", "rest").agg(F.sum("times").alias("times")))
    sets = union_all(found).select(F.array_sort("items").alias("items"), F.size("items").alias("size"), "support_count")
    sets = sets.crossJoin(F.broadcast(total)).withColumn("support", F.col("support_count") / F.col("n_baskets"))
    return sets.select("items", "size", "support_count", "support", "n_baskets")


def association_rules(sets: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """``antecedent, consequent, support_count, support, confidence, lift, leverage`` of the itemsets of
    :func:`itemsets`: every item of a set as consequent of the others.

    Counts of antecedents and consequents are sets themselves and meet the rules by equality.
    """
    counts = sets.select("items", "support_count")
    rules = sets.where("size > 1").select("*", F.explode("items").alias("consequent")).withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    rules = rules.join(counts.select(F.col("items").alias("antecedent"), F.col("support_count").alias("_a")), "antecedent")
    singles = counts.where(F.size("items") == 1).select(F.element_at("items", 1).alias("consequent"), F.col("support_count").alias("_c"))
    rules = rules.join(singles, "consequent")
    confidence = ratio(F.col("support_count"), F.col("_a"))
    rules = rules.withColumns(
        {
            "confidence": confidence,
            "lift": ratio(confidence * F.col("n_baskets"), F.col("_c")),
            "leverage": F.col("support") - F.col("_a") / F.col("n_baskets") * F.col("_c") / F.col("n_baskets"),
        }
    )
    rules = rules.where(F.col("confidence") >= min_confidence)
    return rules.select("antecedent", "consequent", "support_count", "support", "confidence", "lift", "leverage")
