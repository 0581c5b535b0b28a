"""Pairs of 64-bit hashes a few bits apart, by an index of blocks of bits.

A hash is cut into BLOCKS blocks that take its bits in turn, so that blank regions of a
picture, which clear a run of bits, thin all blocks alike. Two hashes within the radius
differ in at most radius // BLOCKS bits of one block or more, so the asking side looks
up each of its blocks with all patterns of so few bits changed, and meets every hash
within the radius; the exact distance decides. A pair is taken in the first block that
brings it together, so no pair is made twice. Equal hashes are one in the index.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 4
#: Bits of each block: every fourth one.
MASKS = tuple(sum(1 << k for k in range(b, 64, BLOCKS)) for b in range(BLOCKS))


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _patterns(block: int, most: int) -> list[int]:
    """All ways of changing so few bits of a block."""
    bits = [1 << k for k in range(block, 64, BLOCKS)]
    return [_long(sum(some)) for n in range(most + 1) for some in combinations(bits, n)]


def hash_number(text: Column) -> Column:
    """A hash of 16 hexadecimal digits as a signed long; null if it is none."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("long"))


def near_hashes(rows: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(hash, near, distance): the distinct hashes of rows(hash) within the radius of those of queries(hash), both longs."""
    most = radius // BLOCKS
    blocks = [F.struct(F.lit(b).alias("block"), F.col("hash").bitwiseAND(F.lit(_long(m))).alias("bits")) for b, m in enumerate(MASKS)]
    indexed = rows.select("hash").where("hash is not null").distinct().select("hash", F.inline(F.array(*blocks)))
    asked = queries.select(F.col("hash").alias("near")).where("near is not null").distinct()
    patterns = [F.struct(F.lit(b).alias("block"), F.array(*[F.lit(p) for p in _patterns(b, most)]).alias("changed"), F.lit(_long(m)).alias("mask")) for b, m in enumerate(MASKS)]
    asked = asked.select("near", F.inline(F.array(*patterns))).select("near", "block", F.col("near").bitwiseAND(F.col("mask")).alias("own"), F.explode("changed").alias("change"))
    asked = asked.select("near", "block", F.col("own").bitwiseXOR(F.col("change")).alias("bits"))
    apart = F.col("hash").bitwiseXOR(F.col("near"))
    # Planned sizes don't count the patterns, so a small table would be sent whole to the driver with all of them.
    pairs = indexed.join(asked.hint("merge"), ["block", "bits"]).withColumn("distance", F.bit_count(apart).cast("int")).where(F.col("distance") <= radius)
    # Earlier blocks would have brought the pair together if they differed in so few bits.
    earlier = F.lit(False)
    for b in range(BLOCKS - 1):
        earlier = earlier | ((F.col("block") > b) & (F.bit_count(apart.bitwiseAND(F.lit(_long(MASKS[b])))) <= most))
    return pairs.where(~earlier).select("hash", "near", "distance")


def near_rows(rows: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(id, twin, distance) of rows(id, hash) and queries(id, hash), copies of a hash each for itself."""
    found = near_hashes(rows, queries, radius)
    twins = queries.select(F.col("id").alias("twin"), F.col("hash").alias("near"))
    return rows.select("id", "hash").hint("merge").join(found, "hash").join(twins.hint("merge"), "near").select("id", "twin", "distance")
