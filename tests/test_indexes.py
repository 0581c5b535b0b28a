"""Indexes for searches in numbers: trigrams against all pairs, cells of vectors against all vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundledger.operators.trigram_index import fuzzy_matches
from groundledger.operators.vector_index import cell_index, fit_cells, indexed_nearest, nearest


def grams(text):
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return {f"  {w} "[k : k + 3] for w in words for k in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_trigram_searches(spark, least):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ra", "mi", "po", "lu", "é", "x"]) for _ in range(rng.randint(1, 5)))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(250)] + ["", None, "-", "the same", "the same", "ab"]
    asked = [names[k] for k in range(0, 250, 10)] + ["", None, "the samé", "ab", "nothing like it"]
    frame = spark.createDataFrame(list(enumerate(names)), "id int, name string").repartition(3)
    searches = spark.createDataFrame(list(enumerate(asked)), "search int, asked string")
    found = {(r.search, r.id): r.similarity for r in fuzzy_matches(frame, searches, least).collect()}
    want = {}
    for s, q in enumerate(asked):
        for i, n in enumerate(names):
            a, b = grams(q or ""), grams(n or "")
            if a and b and len(a & b) / len(a | b) > least:
                want[s, i] = len(a & b) / len(a | b)
    assert found == pytest.approx(want) and len(want) > 25


def test_copies_of_a_name_are_compared_once(spark, monkeypatch):
    """candidates were pairs of rows, a copy of a name with each copy of a search."""
    from groundledger.operators import trigram_index

    sizes = []
    monkeypatch.setattr(trigram_index, "settle", lambda df: sizes.append(df.count()) or df)
    monkeypatch.setattr(trigram_index, "release", lambda *settled: None)
    names = spark.range(3000).select("id", F.concat(F.lit("large ring "), F.col("id") % 2).alias("name"))
    found = fuzzy_matches(names, names.where("id % 50 = 0").selectExpr("id as search", "name as asked"))
    assert found.count() == 60 * 3000 and max(sizes) < 100


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * 0.7).tolist(), int(rng.integers(0, 3)), "v1" if k % 4 else None) for k in range(3000)]
    rows += [(4000, [0.0] * 16, 0, "v1"), (4001, None, 0, "v1"), (4002, [], 0, "v1"), (4003, rows[7][1], rows[7][2], "v1"), (4004, rows[7][1], rows[7][2], "v1"), (4005, rows[3][1], 9, "rare")]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>, scope int, version string").repartition(4)


def brute(rows, searches, k):
    out = {}
    unit = {r[0]: np.array(r[1]) / (np.linalg.norm(r[1]) or 1) for r in rows if r[1]}
    for s in searches:
        near = sorted((-round(float(unit[s[0]] @ unit[r[0]]), 9), r[0]) for r in rows if r[1] and r[0] != s[0] and r[2:] == s[2:])
        out[s[0]] = [i for _, i in near[:k]]
    return out


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.search, r.place)):
        out.setdefault(r.search, []).append(r.id)
    return out


def test_exact_search_within_a_scope(spark, vectors):
    rows, frame = vectors
    asked = [r for r in rows if r[1] and (r[0] % 50 == 0 or r[0] >= 4000)]
    searches = spark.createDataFrame(asked, "search long, wanted array<double>, scope int, version string")
    found = listed(nearest(frame, searches, 10, ["scope", "version"]))
    assert found == {s: ids for s, ids in brute(rows, asked, 10).items() if ids} and 4005 not in found


def test_index_holds_all_and_finds_nine_in_ten(spark, vectors):
    rows, frame = vectors
    asked = [r for r in rows if r[1] and (r[0] % 50 == 0 or r[0] >= 4000)]
    searches = spark.createDataFrame(asked, "search long, wanted array<double>, scope int, version string")
    centroids = fit_cells(frame, 40, sample=1000)
    index = cell_index(frame, centroids)
    assert index.count() == sum(bool(r[1]) for r in rows) and centroids.shape == (40, 16)
    found, want = listed(indexed_nearest(index, centroids, searches, 10, ["scope", "version"])), brute(rows, asked, 10)
    assert {s for s, ids in want.items() if ids} == set(found) and all(len(found[s]) == len(ids) for s, ids in want.items() if ids)
    assert sum(len(set(found[s]) & set(ids)) for s, ids in want.items() if ids) >= 0.9 * sum(map(len, want.values()))
    every = listed(indexed_nearest(index, centroids, searches, 10, ["scope", "version"], probes=40))
    assert sum(every[s] == ids for s, ids in want.items() if ids) >= len(every) - 2  # rounding may swap equals


def test_a_slab_of_vectors_is_compared_at_a_time(spark, monkeypatch):
    """a whole batch met a whole block of searches, of all scopes; a task's rows are at most k a search."""
    from groundledger.operators import vector_index

    monkeypatch.setattr(vector_index, "_best", lambda rows, k: rows)
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(5000)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, scope int").coalesce(1)
    found = nearest(frame, frame.where("id % 50 = 0").selectExpr("id as search", "vector as wanted", "scope"), 10, ["scope"])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)  # more batches, no more rows
    try:
        assert vector_index.SLAB <= 1024 and found.count() == 100 * 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_found_pairs_are_shuffled_as_lists(spark):
    """each search was shuffled with each name like its own, SPREAD times; rows without an id count as well."""
    names = spark.range(2000).select(F.when(F.col("id") % 500 > 0, F.col("id")).alias("id"), F.concat(F.lit("large ring "), F.col("id") % 2).alias("name"))
    found = fuzzy_matches(names, names.where("id % 20 = 0").selectExpr("id as search", "name as asked"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Rows are written out above the last join.
    assert plan.index("explode(ids") < plan.index("Join") and plan.index("explode(searches") < plan.index("Join")
    assert found.count() == 96 * 2000 and found.where("id is null").count() == 96 * 4 and found.distinct().count() == 96 * 1997
