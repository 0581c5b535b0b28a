"""Joins of boxes on the plane by a quadtree that follows the data.

Cells of level n have sides of unit * 2 ** n. A cell that holds more than MOST centres
of boxes that would fit its quarters is split, from the top level down, so crowded
places have small cells and empty ones large cells, and each leaf is a join key of
bounded size. The split cells are counted from the finest ones upwards: their number
is at most the levels times the rows over MOST, and they are a settled table, which
Spark sends to all tasks while it is small and shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_meet
from ..sources.shared import settle

MOST, LEVELS = 256, 16


def _cell(value: Column, level: Column | int, unit: float) -> Column:
    """Number of the cell of a level that holds the value."""
    return F.shiftright(F.floor(value / unit).cast("long"), level) if isinstance(level, int) else F.call_function("shiftright", F.floor(value / unit).cast("long"), level)


def split_cells(boxes: DataFrame, keys: list[str], unit: float, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """(keys, level, cx, cy) of the cells that are split; box is a struct x1, y1, x2, y2 of boxes(keys, box)."""
    box = F.col("box")
    longest = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"], F.lit(unit) / 2)
    fits = F.ceil(F.log2(2 * longest / unit)).cast("int")
    centres = boxes.select(
        *keys,
        F.greatest(fits, F.lit(1)).alias("least"),
        _cell((box["x1"] + box["x2"]) / 2, 0, unit).alias("x"),
        _cell((box["y1"] + box["y2"]) / 2, 0, unit).alias("y"),
    )
    counted = centres.groupBy(*keys, "least", "x", "y").agg(F.count("*").alias("many")).where(F.col("least") <= levels)
    every = counted.withColumn("level", F.explode(F.sequence("least", F.lit(levels))))
    at = [F.call_function("shiftright", F.col(c), F.col("level")).alias(f"c{c}") for c in "xy"]
    return settle(every.groupBy(*keys, "level", *at).agg(F.sum("many").alias("many")).where(F.col("many") > most).drop("many"))


def in_leaves(boxes: DataFrame, keys: list[str], unit: float, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """The boxes, a row for each leaf that they meet, with its level, cx and cy."""
    split = split_cells(boxes, keys, unit, most, levels)
    box = F.col("box")

    def span(a: str, b: str, level: int) -> Column:
        return F.sequence(_cell(box[a], level, unit), _cell(box[b], level, unit))

    # A number for each level, sixteen at most. Above the first level with more split cells the tree does not branch.
    many = {r.level: r.many for r in split.groupBy("level").agg(F.count("*").alias("many")).collect()}
    top, low = max(many, default=levels), min(many, default=levels + 1)
    while many.get(top - 1, 0) == many.get(top):
        top -= 1
    rows = boxes.withColumn("level", F.lit(top)).withColumn("cx", F.explode(span("x1", "x2", top))).withColumn("cy", F.explode(span("y1", "y2", top)))
    for level in range(top, low - 1, -1):
        cut = split.where(F.col("level") == level).withColumn("cut", F.lit(True))
        # The quarters of a split cell that the box meets.
        quarters = F.flatten(
            F.transform(
                F.filter(span("x1", "x2", level - 1), lambda x: F.shiftright(x, 1) == F.col("cx")),
                lambda x: F.transform(
                    F.filter(span("y1", "y2", level - 1), lambda y: F.shiftright(y, 1) == F.col("cy")),
                    lambda y: F.struct(F.lit(level - 1).alias("level"), x.alias("cx"), y.alias("cy")),
                ),
            )
        )
        own = F.array(F.struct("level", "cx", "cy"))
        rows = rows.join(cut, [*keys, "level", "cx", "cy"], "left").withColumn("leaf", F.explode(F.when(F.col("cut"), quarters).otherwise(own)))
        rows = rows.select(*boxes.columns, "leaf.*")
    return rows


def meeting_boxes(boxes: DataFrame, keys: list[str], unit: float, carried: list[str], most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """Pairs of boxes(keys, id, box, carried) of equal keys whose boxes meet, each once: (keys, one, two, carried of both, the other's with a 2 behind)."""
    leaves = settle(in_leaves(boxes.select(*keys, "id", "box", *carried), keys, unit, most, levels))
    at = [*keys, "level", "cx", "cy"]
    right = leaves.select(*at, F.col("id").alias("two"), F.col("box").alias("box2"), *[F.col(c).alias(f"{c}2") for c in carried])
    pairs = leaves.withColumnRenamed("id", "one").join(right, at).where((F.col("one") < F.col("two")) & boxes_meet(F.col("box"), F.col("box2")))
    # The leaf that holds the lower left corner of the common box counts.
    corner = [_cell(F.greatest(f"box.{c}", f"box2.{c}"), F.col("level"), unit) for c in ("x1", "y1")]
    first = pairs.where((F.col("cx") == corner[0]) & (F.col("cy") == corner[1]))
    return first.select(*keys, "one", "two", *carried, *[f"{c}2" for c in carried])
