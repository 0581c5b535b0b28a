"""Evaluation analytics: confusion counts, calibration, percentiles, skylines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(truth: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, tp, fp, fn) of two sets of rows with the same keys, group among them."""
    both = truth.select(*keys).distinct().withColumn("_t", F.lit(1)).join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full_outer")
    return both.groupBy(group).agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"),
        F.count_if(F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_f").isNull()).alias("fn"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (tp, fp, fn); 0 where undefined."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero))


def calibration_error(rows: DataFrame, probability: Column, label: Column, bins: int = 8) -> DataFrame:
    """(ece, brier, n) over equal bins, the last one closed."""
    cells = rows.select(probability.alias("p"), label.cast("double").alias("y")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    cells = cells.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"))
    return cells.agg(
        (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        F.sum("n").alias("n"),
    )


def grouped_calibration(rows: DataFrame, group: str, probability: Column, label: Column, bins: int = 8) -> DataFrame:
    """(worst, gap, brier, accuracy): the worst group's calibration error and the distance to the best one's, and two figures over all rows."""
    p = rows.select(group, probability.alias("p"), label.cast("double").alias("y"))
    cells = p.groupBy(group, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"),
        F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"), F.count_if((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("right"),
    )
    groups = cells.groupBy(group).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), *[F.sum(c).alias(c) for c in ("n", "sq", "right")])
    return groups.agg(
        F.max("ece").alias("worst"), (F.max("ece") - F.min("ece")).alias("gap"),
        (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("right") / F.sum("n")).alias("accuracy"),
    )


def skyline(rows: DataFrame, high: str, low: str, ranges: int = 64) -> DataFrame:
    """Rows that no other beats with more of `high` and no more of `low`, or as much of `high` and less of `low`.

    A row stays if it has more of high than all rows with less of low. Equal
    values of low are grouped first; the rest is compared inside ranges of low,
    and with the best of the ranges before, of which there are few.
    """
    best = rows.groupBy(low).agg(F.max(high).alias("_high"))
    bounds = best.approxQuantile(low, [k / ranges for k in range(1, ranges)], 0.01) if not best.isEmpty() else []
    place = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]), lambda b: b <= F.col(low)))
    best = best.withColumn("_range", place)
    tops = best.groupBy("_range").agg(F.max("_high").alias("_top"))
    tops = tops.withColumn("_above", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("_range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("_best", F.max("_high").over(before)).join(tops.select("_range", "_above"), "_range")
    kept = kept.where("coalesce(_high > _best, true) and coalesce(_high > _above, true)")
    return rows.join(kept.select(low, F.col("_high").alias(high)), [low, high])


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """(key, share, value): percentiles with linear interpolation, for keys of any size.

    Equal values are counted first. Equal-width bins tell in which of them a rank
    lies, and only the values of those bins are put in order, each bin on its own.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    place = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    binned = counts.join(ends, key).withColumn("bin", F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int"))
    upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy(key, "bin").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    at = ends.select(key, "total", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", (F.col("total") - 1) * F.col("share"))
    ranks = at.select(key, "share", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    ranks = ranks.join(sums, key).where("rank >= before and rank < before + m").select(key, "share", "at", "rank", "bin", "before")
    inside = binned.join(ranks.select(key, "bin", "before").distinct(), [key, "bin"])
    own = Window.partitionBy(key, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0))).select(key, "bin", "v", "first", "n")
    found = ranks.drop("before").join(inside, [key, "bin"]).where("rank >= first and rank < first + n")
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return found.groupBy(key, "share").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("value"))


def nearest_rank(rows: DataFrame, value: str, share: float) -> DataFrame:
    """The value at place floor(share * (n - 1)) of the sorted values."""
    return rows.agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias(value))


#: Fixed value: what the first event of a log is chained to.
GENESIS = "0" * 64
#: Events of a chain that are looked at side by side.
CHAIN_RUN = 1 << 16


def chained(events: DataFrame, chain: str, sequence: str, payload: str) -> DataFrame:
    """The events with the hash before them and their own, appended in the order of sequence.

    A chain can only be written one event after the other; chains are spread over tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, GENESIS
        for frame in frames:
            before, after = [], []
            for key, seq, text in frame[[chain, sequence, payload]].itertuples(index=False):
                last = last if key == now else GENESIS
                now = key
                before.append(last)
                last = hashlib.sha256(f"{last}|{seq}|{text}".encode()).hexdigest()
                after.append(last)
            yield frame.assign(previous=before, hashed=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", previous string, hashed string"
    return events.repartition(chain).sortWithinPartitions(chain, sequence).mapInPandas(run, schema)


def chain_problems(events: DataFrame, chain: str, sequence: str, payload: str) -> DataFrame:
    """(chain, sequence, problem) of events with previous and hashed: sequence_gap, broken_link, hash_mismatch, each on its own.

    An event is compared with the one before it that exists, the first with the start
    of the log. Runs of CHAIN_RUN numbers are ordered on their own, and the last
    events of the runs once more, so a chain of any length is checked in parallel.
    """
    run = F.floor(F.col(sequence) / CHAIN_RUN)
    rows = events.withColumn("run", run)
    own = Window.partitionBy(chain, "run").orderBy(sequence)
    rows = rows.withColumn("s", F.lag(sequence).over(own)).withColumn("h", F.lag("hashed").over(own))
    last = rows.groupBy(chain, "run").agg(F.max_by(F.struct(F.col(sequence).alias("s"), F.col("hashed").alias("h")), sequence).alias("tail"))
    last = last.withColumn("tail", F.lag("tail").over(Window.partitionBy(chain).orderBy("run"))).where("tail is not null")
    rows = rows.join(last, [chain, "run"], "left")
    s, h = F.coalesce("s", "tail.s", F.lit(0)), F.coalesce("h", "tail.h", F.lit(GENESIS))
    want = F.sha2(F.concat_ws("|", "previous", sequence, payload), 256)
    found = F.array(
        F.when(F.col(sequence) != s + 1, "sequence_gap"), F.when(F.col("previous") != h, "broken_link"), F.when(want != F.col("hashed"), "hash_mismatch")
    )
    return rows.select(chain, sequence, F.explode(F.array_compact(found)).alias("problem"))


def leaked(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
