"""Splits of a corpus that keep groups whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Shares of the splits.
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


#: Pieces into which the groups' order is cut; steps of the golden ratio fill the unit interval most evenly.
PIECES, GOLDEN = 64, 0.6180339887498949


def split_groups(rows: DataFrame, group: str, tier: str) -> DataFrame:
    """(group, split): no group is in two splits, and every tier is dealt in the ratios.

    A greedy fill one group after another would need all groups in one place. Here
    groups of the same make-up (their tiers, the most frequent first) and of like size
    stand next to each other, and each takes the split in whose part of the unit
    interval its number's multiple of the golden ratio falls: of any run of groups, and
    so of the rows of each tier, the splits get their shares to within a group or two.
    The order is cut into pieces by ranges of it, whose counts are settled first, so
    that each piece goes on where the one before it ends and no task sees all groups.
    """
    counts = rows.groupBy(group, tier).agg(F.count("*").alias("n"))
    each = F.sort_array(F.collect_list(F.struct(F.col("n").alias("many"), F.col(tier).alias("of"))), asc=False)
    main = counts.groupBy(group).agg(each.alias("tiers"), F.sum("n").alias("n")).withColumn("make", F.transform("tiers", lambda x: x["of"].cast("string")))
    order = ["make", F.desc("n"), "deal", group]
    dealt = main.withColumn("deal", F.xxhash64(F.lit("deal"), group)).repartitionByRange(PIECES, *order).sortWithinPartitions(*order)
    # After the sort the id is the piece above the group's number in it.
    dealt = settle(dealt.select(group, F.monotonically_increasing_id().alias("id"))).withColumns({"piece": F.shiftright("id", 33), "inner": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    pieces = dealt.groupBy("piece").agg(F.count("*").alias("many"))
    ahead = F.sum("many").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))  # a row for each piece
    placed = dealt.join(pieces.select("piece", F.coalesce(ahead, F.lit(0)).alias("ahead")), "piece")
    at = F.pmod((F.col("ahead") + F.col("inner")) * F.lit(GOLDEN), F.lit(1.0))
    split, upto = F.lit(list(RATIOS)[-1]), 1.0
    for name in reversed(list(RATIOS)[:-1]):
        upto = sum(v for k, v in RATIOS.items() if list(RATIOS).index(k) <= list(RATIOS).index(name))
        split = F.when(at < upto, name).otherwise(split)
    return placed.select(group, split.alias("split"))
