"""What is known of a parcel, its feature vector, and the rules on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import comparison_key
from .rules import anomaly_signals

#: Thresholds of the rules.
AREA_JUMP, MUTATION_RATE, SHARE_TOLERANCE = 3.0, 1.0, 0.01
DOCUMENT_DEPENDENT = ("LOCATION_MISMATCH", "AREA_JUMP")
FEATURES = (
    "area", "area_change_ratio", "mutation_count", "mutations_per_year", "owner_count",
    "ownership_changes", "correction_count", "mean_confidence", "lowest_confidence", "record_age",
)


def share_value(share: Column) -> Column:
    """A share "a/b" as a number; 0 if malformed."""
    both = F.split(share, "/")
    return F.coalesce(F.try_divide(F.get(both, F.lit(0)).try_cast("double"), F.get(both, F.lit(1)).try_cast("double")), F.lit(0.0))


def area_ratio(a: Column, b: Column) -> Column:
    """Larger over smaller; 1 where one is missing or not positive."""
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b)).otherwise(1.0)


def parcel_records(
    parcels: DataFrame, holdings: DataFrame, mutations: DataFrame, deeds: DataFrame, readings: DataFrame, corrections: DataFrame, year: int
) -> DataFrame:
    """One row a parcel with all that the features and rules need.

    Every table is grouped by parcel on its own before the joins, so nothing is multiplied.
    """
    spans = holdings.groupBy("parcel_id").agg(
        F.count("*").alias("span_count"),
        F.countDistinct("owner_id").alias("owner_count"),
        F.greatest(F.countDistinct("valid_from") - 1, F.lit(0)).alias("ownership_changes"),
        F.round(F.coalesce(F.sum(F.when(F.col("valid_to").isNull(), share_value(F.col("share")))), F.lit(0.0)), 4).alias("share_total"),
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("inverted"),
    )
    own = Window.partitionBy("parcel_id").orderBy("mutation_id")
    steps = mutations.withColumn("before", F.lag("effective_date").over(own)).groupBy("parcel_id").agg(
        F.count("*").alias("mutation_count"), F.count_if(F.col("effective_date") < F.col("before")).alias("backwards")
    )
    of = deeds.where("parcel_id is not null")
    newest = of.groupBy("parcel_id").agg(
        F.max_by("village_id", "deed_id").alias("document_village"), F.min(F.year("created_at")).alias("first_year"), F.count("*").alias("document_count")
    )
    area = F.when(F.col("field") == "AREA", F.col("value").try_cast("double"))
    read = of.select("deed_id", "parcel_id").join(readings, "deed_id").groupBy("parcel_id").agg(
        F.max(area).alias("previous_area"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("lowest_confidence")
    )
    fixed = of.select("deed_id", "parcel_id").join(corrections.groupBy("deed_id").agg(F.count("*").alias("n")), "deed_id")
    fixed = fixed.groupBy("parcel_id").agg(F.sum("n").alias("correction_count"))
    rows = parcels.withColumn("key", comparison_key(F.col("khasra")))
    twins = rows.groupBy("village_id", "key").agg((F.count("*") - 1).alias("twins"))
    rows = rows.join(twins, ["village_id", "key"])
    for part in (spans, steps, newest, read, fixed):
        rows = rows.join(part, "parcel_id", "left")
    zero = ("span_count", "owner_count", "ownership_changes", "inverted", "mutation_count", "backwards", "document_count", "correction_count")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero} | {"share_total": F.coalesce("share_total", F.lit(0.0))})
    age = F.greatest(F.coalesce(F.lit(year) - F.col("first_year"), F.lit(0)), F.lit(0)).cast("double")
    rows = rows.withColumn("record_age", age).withColumn("area", F.col("area_value"))
    return rows.withColumns(
        {
            "area_change_ratio": area_ratio(F.col("area_value"), F.col("previous_area")),
            "mutations_per_year": F.when(F.col("record_age") >= 1, F.col("mutation_count") / F.col("record_age")).otherwise(F.col("mutation_count").cast("double")),
            "mean_confidence": F.coalesce("mean_confidence", F.lit(1.0)),
            "lowest_confidence": F.coalesce("lowest_confidence", F.lit(1.0)),
        }
    )


def feature_rows(records: DataFrame) -> DataFrame:
    """(parcel_id, the ten FEATURES as doubles)."""
    return records.select("parcel_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def parcel_signals(records: DataFrame) -> DataFrame:
    """(parcel_id, anomaly, score) of the seven rules."""
    c = F.col
    unexplained = c("ownership_changes") - c("mutation_count")
    off = F.abs(c("share_total") - 1.0)
    one = F.lit(1.0)
    rules = [
        ("INVALID_CHRONOLOGY", (c("backwards") > 0) | (c("inverted") > 0), one),
        ("DUPLICATE_PARCEL", c("twins") > 0, one),
        ("AREA_JUMP", c("area_change_ratio") >= AREA_JUMP, F.least(c("area_change_ratio") / (4 * AREA_JUMP), one)),
        ("MISSING_MUTATION", (c("ownership_changes") > 0) & (unexplained > 0), F.least(unexplained / 3, one)),
        ("LOCATION_MISMATCH", c("document_village") != c("village_id"), F.lit(0.8)),
        ("REPEATED_MODIFICATION", (c("mutations_per_year") > MUTATION_RATE) & (c("mutation_count") >= 3), F.least(c("mutations_per_year") / (3 * MUTATION_RATE), one)),
        ("UNUSUAL_OWNERSHIP_CHANGE", (c("span_count") > 0) & (c("share_total") != 0) & (off > SHARE_TOLERANCE), F.least(off, one)),
    ]
    return anomaly_signals(records, ["parcel_id"], rules)


def evaluable(records: DataFrame) -> DataFrame:
    """(parcel_id, types): the types on which a verdict was possible; two need a document."""
    always = sorted({"INVALID_CHRONOLOGY", "DUPLICATE_PARCEL", "MISSING_MUTATION", "REPEATED_MODIFICATION", "UNUSUAL_OWNERSHIP_CHANGE"})
    every = F.array(*map(F.lit, sorted([*always, *DOCUMENT_DEPENDENT])))
    return records.select("parcel_id", F.when(F.col("document_count") > 0, every).otherwise(F.array(*map(F.lit, always))).alias("types"))
