"""Ownership spans: closed validity intervals, checks of their sequence, eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shares import common_multiple, limbs_are, share_texts, unit_limbs
from ..sources.shared import settle


def as_of(date: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """The span covers the date; both ends count, an open end is unlimited."""
    return (F.col(start) <= date) & (F.col(end).isNull() | (F.col(end) >= date))


def current(end: str = "valid_to") -> Column:
    """The span has no end, whatever today is."""
    return F.col(end).isNull()


def closed_by_next(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Spans (valid_from, valid_to): each event's span ends the day before the next one's."""
    own = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.date_sub(F.lead(at).over(own), 1))


def sequence_faults(spans: DataFrame, key: str) -> DataFrame:
    """(key, valid_from, fault): GAP or OVERLAP between a distinct span and its successor, INVERTED spans."""
    own = Window.partitionBy(key).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    rows = spans.select(key, "valid_from", "valid_to").distinct().withColumn("next", F.lead("valid_from").over(own))
    fault = (
        F.when(F.col("valid_to") < F.col("valid_from"), "INVERTED")
        .when(F.col("next").isNull(), None)
        .when(F.col("valid_to").isNull() | (F.col("next") <= F.col("valid_to")), "OVERLAP")
        .when(F.col("next") > F.date_add("valid_to", 1), "GAP")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select(key, "valid_from", "fault")


def latest(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key in the order given; it should end with a unique column."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def out_of_order(rows: DataFrame, key: str, sequence: str, at: str) -> DataFrame:
    """Rows whose date is before that of the row recorded before them."""
    own = Window.partitionBy(key).orderBy(sequence)
    return rows.withColumn("_before", F.lag(at).over(own)).where(F.col(at) < F.col("_before")).drop("_before")


def islands(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Rows numbered by the run they are in; a run begins where starts holds."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(starts.cast("int")).over(own))


def legal_transitions(history: DataFrame, edges: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Transitions of the history that edges(source, target) doesn't have."""
    own = Window.partitionBy(key).orderBy(order)
    steps = history.select(key, order, F.lag(state).over(own).alias("source"), F.col(state).alias("target")).where("source is not null and source != target")
    return steps.join(F.broadcast(edges), ["source", "target"], "left_anti")  # a state machine's edges, some dozens


def whole_at_pivots(spans: DataFrame, key: str, share: str) -> DataFrame:
    """(key, pivot, whole): whether the shares held on each day on which a span begins add up to exactly one.

    Shares become whole multiples of one over the key's common denominator, of any
    size, as limbs. What begins is added and what has ended is taken away along the
    days, limb by limb, so no span meets another and a day counts once.
    """
    num, den = share_texts(F.col(share))
    good = spans.select(key, "valid_from", "valid_to", num.alias("num"), den.alias("den")).where("num is not null and den is not null")
    good = good.where("valid_to is null or valid_to >= valid_from")
    common = good.groupBy(key).agg(F.collect_set("den").alias("dens"), F.max(F.length("num")).alias("digits"))
    common = settle(common.select(F.col(key).alias("of"), common_multiple("dens").alias("common"), "digits"))
    good = good.join(common, F.col(key) == F.col("of")).withColumn("limbs", unit_limbs("num", "den", "common", "digits"))
    good = good.select(key, "common", "valid_from", "valid_to", F.posexplode("limbs").alias("limb", "units"))
    begins = good.select(key, "common", "limb", F.col("valid_from").alias("day"), "units", F.lit(1).alias("pivot"))
    ends = good.where("valid_to is not null").select(key, "common", "limb", F.date_add("valid_to", 1).alias("day"), (-F.col("units")).alias("units"), F.lit(0).alias("pivot"))
    days = begins.unionByName(ends).groupBy(key, "common", "limb", "day").agg(F.sum("units").alias("units"), F.max("pivot").alias("pivot"))
    held = F.sum("units").over(Window.partitionBy(key, "limb").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("held", held).where("pivot = 1").groupBy(key, "common", "day").agg(F.sort_array(F.collect_list(F.struct("limb", "held"))).alias("held"))
    return days.select(key, F.col("day").alias("pivot"), limbs_are("held.held", "common").alias("whole"))
