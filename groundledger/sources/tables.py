"""Readers: Parquet tables, JSON documents, JSON lines, tab-separated labels, sniffed files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lists(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Rows of one list of a JSON document that holds several."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline(field))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) of lines cut at their first tab."""
    halves = F.split("value", "\t", 2)
    return spark.read.text(path).where("value != ''").select(halves[0].alias("name"), halves[1].alias("label"))


def mime_type(content: Column) -> Column:
    """Type by the first bytes of a binary column; null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("25504446"), "application/pdf")
    )


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, parent_id, level, name): regions, nations, and customers and suppliers as their leaves."""
    region = table(spark, folder, "region").select(F.format_string("R%d", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("REGION").alias("level"), F.col("r_name").alias("name"))
    nation = table(spark, folder, "nation").select(F.format_string("N%d", "n_nationkey").alias("id"), F.format_string("R%d", "n_regionkey").alias("parent_id"), F.lit("NATION").alias("level"), F.col("n_name").alias("name"))
    customer = table(spark, folder, "customer").select(F.format_string("C%d", "c_custkey").alias("id"), F.format_string("N%d", "c_nationkey").alias("parent_id"), F.lit("CUSTOMER").alias("level"), F.col("c_name").alias("name"))
    supplier = table(spark, folder, "supplier").select(F.format_string("S%d", "s_suppkey").alias("id"), F.format_string("N%d", "s_nationkey").alias("parent_id"), F.lit("SUPPLIER").alias("level"), F.col("s_name").alias("name"))
    return region.unionByName(nation).unionByName(customer).unionByName(supplier)


def with_sidecars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(stem, path, length, and a struct `truth`) of the images of a folder that have a JSON file of the same name beside them."""
    stem = F.regexp_replace("path", "\\.[^./]*$", "")
    files = spark.read.format("binaryFile").load(folder)
    images = files.where(F.lower("path").rlike("\\.(png|jpe?g)$")).select(stem.alias("stem"), "path", "length")
    texts = files.where(F.lower("path").endswith(".json")).select(stem.alias("stem"), F.from_json(F.decode("content", "UTF-8"), schema).alias("truth"))
    return images.join(texts, "stem")


def _dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG or JPEG; None if it isn't whole."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 else None
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0xFF, 0xD8, 0xD9):
            at += 1 if data[at] != 0xFF or data[at + 1] == 0xFF else 2
            continue
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2 or at + 2 + size > len(data):
            return None
        if kind in _FRAMES and size >= 7:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


#: JPEG markers of the frames that carry the picture's size.
_FRAMES = frozenset((*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)))


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_dimensions(bytes(x or b"")) or (None, None) for x in content], columns=["width", "height"])
