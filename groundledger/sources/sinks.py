"""Sinks: CSV and JSON-lines exports, partition replacement, merges expressed as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import settle


def export_csv(rows: DataFrame, path: str) -> int:
    """Writes the rows under a header; returns how many were written, counted in the same pass."""
    written = Observation()
    rows.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(path)
    return written.get["rows"]


def export_splits(rows: DataFrame, path: str, split: str, order: str) -> None:
    """JSON lines, one folder for each split, ordered inside."""
    rows.repartition(split).sortWithinPartitions(split, order).write.mode("overwrite").partitionBy(split).json(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replaces the partitions that rows has, and leaves all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over those of old with the same key."""
    rest = old.join(new.select(key), key, "left_anti")
    return rest.unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old doesn't have."""
    return new.join(old.select(*keys), keys, "left_anti")


def first_stamp(old: Column, stamp: Column) -> Column:
    return F.coalesce(old, stamp)


def reconcile_flags(flags: DataFrame, signals: DataFrame, keys: list[str], evaluable: list[str]) -> DataFrame:
    """New status of flags(keys, status) after a run that raised signals(keys).

    Dismissed flags stay; signalled ones are open; open ones of an evaluable
    type that weren't signalled are resolved; new signals are inserted as open.
    """
    both = flags.withColumn("_old", F.lit(True)).join(signals.select(*keys).distinct().withColumn("_new", F.lit(True)), keys, "full_outer")
    closable = F.col(keys[-1]).isin(evaluable)
    return both.select(
        *keys,
        F.when(F.col("_old").isNull(), "OPEN")
        .when(F.col("status") == "DISMISSED", "DISMISSED")
        .when(F.col("_new"), "OPEN")
        .when((F.col("status") == "OPEN") & closable, "RESOLVED")
        .otherwise(F.col("status"))
        .alias("status"),
    )


def feature(geometry: Column, properties: Column) -> Column:
    """A GeoJSON feature of a geometry struct and a struct of properties."""
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))


def feature_collections(rows: DataFrame, key: str, order: list[str], geometry: Column, properties: Column) -> DataFrame:
    """(key, geojson): one FeatureCollection for each key, such as a village, its features in the order given."""
    own = rows.select(key, F.struct(*order, feature(geometry, properties).alias("_feature")).alias("_row"))
    listed = own.groupBy(key).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return listed.select(key, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("_rows._feature").alias("features"))).alias("geojson"))


def xml_records(rows: DataFrame, key: str, fields: list[str], tag: str = "RecordOfRights") -> DataFrame:
    """(key, xml): a flat XML element of the fields; nulls are empty elements."""
    flat = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])
    return rows.select(key, F.to_xml(flat, {"rowTag": tag}).alias("xml"))


def without_stale(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys came in; the others are stale."""
    return old.join(incoming.select(*keys), keys, "left_semi").select(*old.columns)


def changed_where(rows: DataFrame, when: Column, new: dict[str, Column]) -> DataFrame:
    """The rows with new values in the columns named, where the condition holds."""
    keep = F.coalesce(when, F.lit(False))
    # One projection, so that no condition sees a value changed by another.
    return rows.select(*[F.when(keep, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def highest_number(given: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row (most): the highest number among the ids of the prefix, 0 without any; other ids don't count."""
    number = F.regexp_extract(column, f"^{prefix}(\\d+)$", 1)
    return given.agg(F.coalesce(F.max(F.nullif(number, F.lit("")).cast("long")), F.lit(0)).alias("most"))


def numbered_ids(rows: DataFrame, key: str, taken: DataFrame, form: str) -> DataFrame:
    """(key, external_id): numbers after taken(most), one row, in the order of the key.

    Rows are sorted across partitions; a row's number is its place in its partition
    after the rows of the partitions before, which are summed on one row each.
    """
    # Settled, so that a task that runs again gives no row another number.
    placed = settle(rows.orderBy(key).withColumn("part", F.spark_partition_id()).withColumn("inner", F.monotonically_increasing_id() % F.lit(1 << 33)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = placed.join(sizes.select("part", ahead.alias("ahead")), "part").join(F.broadcast(taken))  # one row
    return nth.select(key, F.format_string(form, F.col("most") + F.col("ahead") + F.col("inner") + 1).alias("external_id"))
