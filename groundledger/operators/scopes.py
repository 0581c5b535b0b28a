"""Row security: what an officer of a jurisdiction, or a citizen, may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import as_of


def within(rows: DataFrame, arms: dict[str, DataFrame]) -> DataFrame:
    """Rows whose columns named in arms are each null or among the ids of their frame, and not all of them null.

    An empty frame allows nothing; ids are distinct, so no row is multiplied.
    """
    out = rows
    for k, (name, ids) in enumerate(arms.items()):
        out = out.join(ids.select(F.col("id").alias(name), F.lit(True).alias(f"__in{k}")).distinct(), name, "left")
    fine = [F.col(n).isNull() | F.col(f"__in{k}").isNotNull() for k, n in enumerate(arms)]
    some = [F.col(n).isNotNull() for n in arms]
    return out.where(reduce(Column.__and__, fine) & reduce(Column.__or__, some)).select(*rows.columns)


def parcels_within(parcels: DataFrame, scope: DataFrame) -> DataFrame:
    """(id) of the parcels of the scope's villages."""
    return parcels.join(scope.select(F.col("id").alias("village_id")), "village_id", "left_semi").select(F.col("parcel_id").alias("id"))


def deeds_within(deeds: DataFrame, parcels: DataFrame, scope: DataFrame) -> DataFrame:
    """Documents by village and by parcel; one that has neither is nobody's."""
    return within(deeds, {"village_id": scope, "parcel_id": parcels_within(parcels, scope)})


def flags_within(flags: DataFrame, deeds: DataFrame, parcels: DataFrame, scope: DataFrame) -> DataFrame:
    """Flags by document and by parcel."""
    seen = deeds_within(deeds, parcels, scope).select(F.col("deed_id").alias("id"))
    return within(flags, {"deed_id": seen, "parcel_id": parcels_within(parcels, scope)})


def grievances_within(grievances: DataFrame, parcels: DataFrame, holdings: DataFrame, scope: DataFrame) -> DataFrame:
    """Complaints about a parcel of the scope, and those about none by somebody who held one there."""
    own = parcels_within(parcels, scope)
    citizens = holdings.join(own.withColumnRenamed("id", "parcel_id"), "parcel_id", "left_semi").select(F.col("owner_id").alias("raised_by"))
    about = grievances.join(own.withColumnRenamed("id", "parcel_id"), "parcel_id", "left_semi").select(*grievances.columns)
    return about.unionByName(grievances.where("parcel_id is null").join(citizens, "raised_by", "left_semi").select(*grievances.columns))


def parcels_of(holdings: DataFrame, owner: Column, day: Column) -> DataFrame:
    """Distinct parcels that the owner holds on the day; no owner, no parcels."""
    return holdings.where((F.col("owner_id") == owner) & as_of(day)).select("parcel_id").distinct()
