"""The index of hashes against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from groundledger.operators.near_hashes import hash_number, near_rows


def hashes(rng):
    base = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1, 0xFFFF]
    out = [rng.getrandbits(64) & 0xFFFFF for _ in range(60)]  # blank pictures: most bits are clear
    for h in base:
        for _ in range(6):
            near = h
            for bit in rng.sample(range(64), rng.randint(0, 14)):
                near ^= 1 << bit
            out.append(near)
    return out + out[:7]


@pytest.mark.parametrize("radius", [0, 3, 7, 10])
def test_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    own = hashes(rng)
    frame = spark.createDataFrame([(k, f"{h:016x}") for k, h in enumerate(own)] + [(-1, None), (-2, "xyz"), (-3, "0" * 15)], "id int, text string").repartition(3)
    rows = frame.select("id", hash_number(F.col("text")).alias("hash"))
    asked = rows.where("id % 3 = 0")
    found = sorted(map(tuple, near_rows(rows, asked, radius).collect()))
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(own) for j, b in enumerate(own) if j % 3 == 0 and (a ^ b).bit_count() <= radius)
    assert found == want


def test_no_side_goes_whole_to_the_driver(spark):
    """with all patterns, the asking side was broadcast, as its size was taken for the table's."""
    rows = spark.range(50).select("id", F.col("id").alias("hash"))
    plan = near_rows(rows, rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
